"""Images by small tiles equal whole ones, in every operator that labels and in the pipelines."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import components, stencil
from rasterloom.plans import pipelines


@pytest.fixture(scope="module")
def images(px_of):
    """A spiral, a checkerboard (corners touch), noise of several densities, and lines one pixel wide."""
    r = np.random.default_rng(8)
    out = []
    for k, (h, w) in enumerate([(13, 17), (9, 9), (20, 11), (1, 30), (16, 3)]):
        g = r.choice([0, 60, 128, 200], (h, w, 4))
        g[..., 3] = np.where(r.random((h, w)) < [0.5, 0.6, 0.4, 0.7, 0.5][k], r.choice([90, 160, 255], (h, w)), 0)
        out.append(g)
    spiral = np.zeros((15, 15, 4), int)
    for i in range(0, 7, 2):
        spiral[i, i : 15 - i] = spiral[14 - i, i : 15 - i] = spiral[i : 15 - i, 14 - i] = spiral[i + 2 : 15 - i, i] = (9, 8, 7, 255)
    board = np.zeros((12, 14, 4), int)
    board[(np.add.outer(np.arange(12), np.arange(14)) % 2) == 0] = (0, 128, 0, 255)
    return px_of(*out, spiral, board).cache()


def rows(d):
    return sorted(map(str, d.collect()))


@pytest.mark.parametrize("tile", [1, 3, 7])
@pytest.mark.parametrize("eight", [True, False])
def test_labels(images, tile, eight):
    key = lambda d: rows(d.select("image_id", "x", "y", "root"))
    assert key(components.labelled(images, F.col("a") > 0, eight)) == key(components.labelled(images, F.col("a") > 0, eight, tile))


OPERATORS = {
    "isolate": lambda px, tile: components.isolate_background(px, (0, 128, 0), 60, 90, tile=tile),
    "islands": lambda px, tile: components.denoise_islands(px, 100, 4, eight=False, tile=tile),
    "isolated": lambda px, tile: components.remove_isolated(px, 6, tile=tile),
    "hysteresis": lambda px, tile: components.alpha_hysteresis(px, 80, 200, tile=tile),
    "slices": lambda px, tile: components.slice_components(px, 1, 3, 1, tile=tile),
    "pipeline": lambda px, tile: pipelines.run(px, pipelines.Options(tolerance=40, background=(0, 128, 0), quantize=False, majority=True, island_area=3, outline=True, alpha=120, tile=tile)).px,
    "wizard": lambda px, tile: pipelines.clean(px, pipelines.Cleanup(key=(0, 128, 0), tile=tile)).px,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_by_tiles(images, name):
    f = OPERATORS[name]
    assert rows(f(images, None)) == rows(f(images, 3))


def test_counted_pixels_choose(images, monkeypatch):
    assert components.tile_for(images) is None
    monkeypatch.setattr(components, "LARGE", 200)
    monkeypatch.setattr(components, "TILE", 5)
    assert components.tile_for(images) == 5
    plan = components.denoise_islands(images, 1, 3)
    assert "Window" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert rows(plan) == rows(components.denoise_islands(images, 1, 3, tile=None))


STENCILS = {
    "defringe": stencil.defringe,
    "outliers": lambda px, **how: stencil.remove_outliers(px, 40, **how),
    "median": stencil.median,
    "majority": stencil.majority_denoise,
    "erode": lambda px, **how: stencil.erode(px, 2, **how),
    "dilate": lambda px, **how: stencil.dilate(px, 2, **how),
    "opened": stencil.opened,
    "closed": stencil.closed,
    "outline": lambda px, **how: stencil.outline(px, (1, 2, 3, 4), True, **how),
    "sobel": lambda px, **how: stencil.sobel_edges(px, 90, **how),
}


@pytest.mark.parametrize("name", STENCILS)
def test_stencils_by_tiles(images, px_of, name):
    f = STENCILS[name]
    small = px_of(*[np.full((h, w, 4), 40 * h + w) + 60 * np.arange(w)[None, :, None] for h, w in ((1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 2), (3, 3), (4, 3))])
    for d in (images, small.withColumn("a", F.col("a") % 256)):
        whole = rows(f(d))
        assert rows(f(d, together=False, tile=3)) == whole == rows(f(d, together=False))
    if name in ("median", "outline"):
        assert rows(f(images, together=False, tile=1)) == rows(f(images))


def test_stencils_of_large_images_take_one_shuffle_and_no_window_by_image(images):
    for f in (stencil.defringe, stencil.median, stencil.majority_denoise):
        q = f(images, together=False)._jdf.queryExecution()
        assert all("__tx" in part.split("]")[0] for part in q.optimizedPlan().toString().split("windowspecdefinition(")[1:])
        assert q.executedPlan().toString().count("Exchange hashpartitioning") == 1


def interactive(g, key, tolerance, edge, alpha, seeds):
    """One image by the plain steps; what lies at the border is looked through by the operator itself."""
    out = components.isolate_background(g, key, tolerance, edge, seeds=seeds, tile=None)
    lost = pipelines.removed_counts(g, out).first()["removed"]
    return stencil.recolour(out, F.lit(True), a=F.when(F.col("a") > alpha, 255).otherwise(0)) if lost else out


@pytest.mark.parametrize("tile", [None, 4])
def test_interactive_removal_gives_each_image_its_own_key(images, spark, tile):
    from rasterloom.operators import aggregate

    seeds = spark.createDataFrame([(2, 4, 5), (6, 7, 7), (99, 0, 0)], "image_id long, x int, y int")
    images = images.where("image_id in (0, 2, 6)")
    got = pipelines.remove_background(images, (70, 70, 70), 25, 300, 400, seeds=seeds, tile=tile)  # 400 is taken as 254
    keys = {r["image_id"]: tuple(r)[1:] for r in aggregate.snap_key(images, (70, 70, 70)).collect()}
    assert len(set(keys.values())) > 1
    want = []
    for k, key in keys.items():
        want += rows(interactive(images.where(F.col("image_id") == k), key, 25, 300, 254, seeds))
    assert rows(got) == sorted(want)
