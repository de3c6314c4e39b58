"""Queries without a subset take every image and point."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from support import DATA

from rasterloom import catalog
from rasterloom.sources import rasters


@pytest.mark.parametrize("name,rows,images", [("r085_tile_preview", 9 * 64, 1), ("r112_hit_test", 64, 1), ("r104_cell_click", 64, 1), ("r007b_grid_cells", 1, 1)])
def test_all_images(spark, name, rows, images):
    ids = [r[0] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()]
    got = catalog.queries()[name](spark, DATA)
    if name == "r007b_grid_cells":
        want = {(v // 7, v % 7) for v in ids}
        assert want <= {(r[0], r[1]) for r in got.select("image_id", "ord").collect()}
    else:
        assert got.count() == rows * len(set(ids))
        assert {r[0] for r in got.select("image_id").distinct().collect()} == set(ids)


def test_all_frames_by_brute_force(spark):
    """Every pixel of every frame in its cell; the last sheet has fewer frames."""
    px = rasters.px_vectors(spark, DATA).collect()
    n = Counter(v // 7 for v in {p["image_id"] for p in px})
    side = {s: math.ceil(math.sqrt(k)) for s, k in n.items()}
    want = {(s, x, y): (0, 0, 0, 0) for s, k in n.items() for x in range(8 * side[s]) for y in range(8 * math.ceil(k / side[s]))}
    for p in px:
        s, o = divmod(p["image_id"], 7)
        want[s, p["x"] + 8 * (o % side[s]), p["y"] + 8 * (o // side[s])] = (p["r"], p["g"], p["b"], p["a"]) if p["a"] else (0, 0, 0, 0)
    got = catalog.queries()["r007_frames_to_grid"](spark, DATA).collect()
    assert len(got) == len(want) and {(r["image_id"], r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in got} == want
