"""Steps by image that take many small images, or tiles, in one call."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import DATA

from rasterloom import catalog
from rasterloom.operators import components, palette
from rasterloom.schema import by_groups, to_raster
from rasterloom.sources import images


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _px(spark, sizes):
    """Images of these (id, width, height), two colours each."""
    d = spark.createDataFrame(sizes, "image_id long, w int, h int").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    return d.select("image_id", "x", "y", F.expr("int((x + y) % 2 * 9) r"), F.expr("int(x % 256) g"), F.expr("int(y % 256) b"), F.expr("int(pmod(x * y, 256)) a"))


def test_groups_of_every_size_are_whole(spark):
    """Groups beyond what a task holds at once, small ones around them, and a null key."""
    rows = spark.range(400_000).select(F.expr("case when id < 300000 then 5 when id < 300010 then null else id % 997 + 10 end").cast("long").alias("k"), F.col("id").alias("v"))

    def kernel(t, cuts):
        import pyarrow as pa

        v = t.column("v").to_numpy()
        return pa.table({"k": t.column("k").take(pa.array(cuts[:-1])), "n": np.diff(cuts), "s": np.add.reduceat(v, cuts[:-1])})

    got = by_groups(rows, ["k"], kernel, "k long, n long, s long").collect()
    want = rows.groupBy("k").agg(F.count("*"), F.sum("v")).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert [tuple(r) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(want, key=key)]
    assert by_groups(rows.where("k = 1"), ["k"], kernel, "k long, n long, s long").collect() == []


def test_rasters_of_small_and_large_images(spark):
    px = _px(spark, [(1, 3, 2), (2, 400, 500), (3, 1, 1), (4, 7, 5)])
    got = {r["image_id"]: r for r in to_raster(px).collect()}
    assert {k: (r["width"], r["height"]) for k, r in got.items()} == {1: (3, 2), 2: (400, 500), 3: (1, 1), 4: (7, 5)}
    for r in got.values():
        y, x = np.divmod(np.arange(r["width"] * r["height"]), r["width"])
        want = np.stack([(x + y) % 2 * 9, x % 256, y % 256, x * y % 256], axis=1).astype(np.uint8)
        assert bytes(r["rgba"]) == want.tobytes()


def test_few_colours_never_reach_python(spark):
    """An image of at most k colours is its own palette, and no image has a call of its own."""
    px = spark.createDataFrame([(1, i, 0, *c, 255) for i, c in enumerate([(1, 2, 3), (9, 9, 9), (3, 2, 1), (1, 2, 3), (200, 0, 0)])] + [(2, 0, 0, 5, 5, 5, 0), (2, 1, 0, 7, 7, 7, 1)], "image_id long, x int, y int, r int, g int, b int, a int")
    for kind in ("wu", "octree"):
        own = palette.extract(px, 8, kind)
        assert "FlatMapGroupsInArrow" not in _plan(own)
        got = sorted((r["image_id"], r["idx"], r["r"], r["g"], r["b"]) for r in own.collect())
        assert got == [(1, 0, 200, 0, 0), (1, 1, 9, 9, 9), (1, 2, 3, 2, 1), (1, 3, 1, 2, 3), (2, 0, 7, 7, 7)]
    assert "FlatMapGroupsInArrow" not in _plan(images.encoded_auto(px, 8))


def test_vectors_are_dealt_once(spark):
    """The palette of a vector's image shuffles vectors, not their pixels."""
    plan = _plan(catalog.queries()["r059b_extract_octree"](spark, DATA))
    assert "Generate" not in [line.split("- ")[-1].split(" ")[0] for line, above in zip(plan.splitlines()[1:], plan.splitlines(), strict=False) if "Exchange" in above]
    assert "FlatMapGroupsInArrow" not in plan


@pytest.mark.parametrize("eight", [True, False])
@pytest.mark.parametrize("tile", [2, 3, 64])
def test_tiles_of_many_images_at_once(spark, px_of, eight, tile):
    rng = np.random.default_rng(tile)
    grids = []
    for h, w in [(1, 1), (7, 9), (8, 8), (3, 12), (5, 1)] * 3:
        g = np.zeros((h, w, 4), int)
        g[..., 3] = rng.integers(0, 2, (h, w)) * 255
        grids.append(g)
    px = px_of(*grids)
    d = components.labelled_by_tiles(px, F.col("a") > 0, eight, tile)
    assert "FlatMapGroupsInArrow" not in _plan(d)
    got = {(r["image_id"], r["x"], r["y"]): r["root"] for r in d.collect()}
    for i, g in enumerate(grids):
        want = components.label(g[..., 3] > 0, eight)
        for y in range(g.shape[0]):
            for x in range(g.shape[1]):
                assert got[i, x, y] == (int(want[y, x]) if want[y, x] >= 0 else None)
