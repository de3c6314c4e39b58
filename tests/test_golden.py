"""Small images with known results."""

from __future__ import annotations

import numpy as np
import pytest
from support import solid
from pyspark.sql import functions as F

from rasterloom.functions import color, scalar
from rasterloom.operators import aggregate, cells, components, compose, generate, geometry, palette, pointwise, stencil, validate
from rasterloom.plans import pipelines, plugins
from rasterloom.schema import holes, images_of, to_px, to_raster
from rasterloom.streaming import temporal

GREEN, MAGENTA = (0, 255, 0), (255, 0, 255)


def one(grids_of, px):
    (g,) = grids_of(px).values()
    return g


def test_isolation_of_a_key_without_tolerance(px_of, grids_of):
    g = np.array([[[0, 255, 0, 255], [0, 0, 0, 255]]])
    assert one(grids_of, components.isolate_background(px_of(g), GREEN, 0, 0, use_lab=False, protect_edges=False))[0, :, 3].tolist() == [0, 255]


def test_isolation_stops_at_content(px_of, grids_of):
    g = solid(3, 3, (*MAGENTA, 255))
    g[1, 1] = (0, 0, 0, 255)
    out = one(grids_of, components.isolate_background(px_of(g), MAGENTA, 0, 0, use_lab=False))
    assert out[0, 0, 3] == 0 and out[1, 1, 3] == 255


def test_isolation_stops_at_edges(px_of, grids_of):
    g = solid(7, 7, (240, 240, 240, 255))
    g[2:5, 2:5] = (20, 20, 20, 255)
    out = one(grids_of, components.isolate_background(px_of(g), (240, 240, 240), 0, 48))
    assert out[0, 0, 3] == 0 and out[3, 3, 3] == 255


def test_a_second_isolation_goes_on_through_what_is_transparent(px_of, grids_of):
    g = solid(3, 5, (30, 30, 30, 255))
    g[:, 0], g[:, 1] = (10, 10, 10, 255), (20, 20, 20, 255)
    # the border holds other colours too: only the keyed column and what it lets through goes
    first = components.isolate_background(px_of(g), (10, 10, 10), 0, 0, use_lab=False, protect_edges=False)
    second = components.isolate_background(first, (20, 20, 20), 0, 0, use_lab=False, protect_edges=False)
    out = one(grids_of, second)
    assert (out[:, :2, 3] == 0).all() and out[1, 2, 3] == 255


def test_isolation_from_an_extra_seed(spark, px_of, grids_of):
    g = solid(5, 5, (0, 0, 0, 255))
    g[2, 2] = (*GREEN, 255)
    seeds = spark.createDataFrame([(0, 2, 2)], "image_id long, x int, y int")
    kw = {"use_lab": False, "protect_edges": False}
    assert one(grids_of, components.isolate_background(px_of(g), GREEN, 0, 0, **kw))[2, 2, 3] == 255
    assert one(grids_of, components.isolate_background(px_of(g), GREEN, 0, 0, seeds=seeds, **kw))[2, 2, 3] == 0


def test_key_snaps_to_a_near_border_colour(px_of):
    g = solid(3, 3, (190, 159, 135, 255))
    g[1, 1] = (20, 20, 20, 255)
    px = px_of(g)
    assert tuple(aggregate.snap_key(px, (193, 167, 144), 40).first())[1:] == (190, 159, 135)
    assert tuple(aggregate.snap_key(px, (193, 167, 144), -40).first())[1:] == (193, 167, 144)


def test_rgb_tolerance_is_inclusive(px_of, grids_of):
    a, b = np.array([[[3, 255, 4, 255]]]), np.array([[[6, 255, 0, 255]]])
    out = grids_of(components.isolate_background(px_of(a, b), GREEN, 5, 0, use_lab=False, protect_edges=False))
    assert out[0][0, 0, 3] == 0 and out[1][0, 0, 3] == 255


def test_snap_keeps_alpha(px_of, grids_of):
    assert one(grids_of, pointwise.snap_background(px_of(np.array([[[0, 250, 5, 200]]])), GREEN, 30))[0, 0].tolist() == [0, 255, 0, 200]


def test_alpha_threshold_is_strict_and_keeps_colours(px_of, grids_of):
    g = np.array([[[9, 8, 7, 200], [9, 8, 7, 128], [9, 8, 7, 50]]])
    out = one(grids_of, pointwise.alpha_threshold(px_of(g), 128))
    assert out[0, :, 3].tolist() == [255, 0, 0] and (out[..., :3] == (9, 8, 7)).all()


def test_hysteresis_keeps_what_touches_strong_alpha(px_of, grids_of):
    a, b = solid(1, 2, (5, 5, 5, 200)), solid(1, 3, (5, 5, 5, 30))
    a[0, 1, 3], b[0, 1, 3] = 100, 100
    out = grids_of(components.alpha_hysteresis(px_of(a, b), 160, 64))
    assert out[0][0, :, 3].tolist() == [255, 255] and out[1][0, 1, 3] == 0


def test_bleed_is_undone(px_of, grids_of):
    out = one(grids_of, pointwise.remove_bleed(px_of(np.array([[[100, 152, 25, 128]]])), GREEN))[0, 0]
    assert (np.abs(out[:3] - (200, 50, 50)) <= 5).all() and out[3] == 128


def test_median_removes_a_spike_and_keeps_an_edge(px_of, grids_of):
    a, b = solid(5, 5, (100, 100, 100, 255)), solid(6, 6, (0, 0, 0, 255))
    a[2, 2] = (255, 0, 0, 255)
    b[:, 3:] = (255, 255, 255, 255)
    out = grids_of(stencil.median(px_of(a, b)))
    assert out[0][2, 2].tolist() == [100, 100, 100, 255]
    assert out[1][3, 2].tolist() == [0, 0, 0, 255] and out[1][3, 3].tolist() == [255, 255, 255, 255]


@pytest.mark.parametrize("together", [True, False])
def test_stencils_do_not_depend_on_how_they_are_dealt(px_of, grids_of, together):
    r = np.random.default_rng(3)
    g = r.integers(0, 3, (6, 7, 4)) * 127
    base = grids_of(stencil.dilate(px_of(g)))[0]
    assert (grids_of(stencil.dilate(px_of(g), together=together))[0] == base).all()


def test_majority(px_of, grids_of):
    g = solid(3, 3, (10, 10, 10, 255))
    g[1, 1] = (99, 99, 99, 255)
    assert one(grids_of, stencil.majority_denoise(px_of(g), 2))[1, 1].tolist() == [10, 10, 10, 255]


def test_outline_by_four_and_eight(px_of, grids_of):
    g = solid(3, 3, (0, 0, 0, 0))
    g[0, 0] = (255, 0, 0, 255)
    assert one(grids_of, stencil.outline(px_of(g)))[1, 1, 3] == 0
    assert one(grids_of, stencil.outline(px_of(g), eight=True))[1, 1, 3] == 255


def test_box_and_islands_and_slices(px_of, grids_of):
    g = solid(10, 10, (0, 0, 0, 0))
    g[2:5, 3:6] = (255, 0, 0, 255)
    assert tuple(aggregate.opaque_box(px_of(g)).first()) == (0, 3, 2, 6, 5)
    assert tuple(aggregate.opaque_box(px_of(solid(2, 2, (1, 1, 1, 0)))).first()) == (0, 0, 0, 0, 0)
    h = solid(8, 8, (0, 0, 0, 0))
    h[1:4, 1:4], h[7, 7] = (0, 255, 0, 255), (255, 0, 0, 255)
    out = one(grids_of, components.denoise_islands(px_of(h), 1, 2, eight=False))
    assert out[7, 7].tolist() == [0, 0, 0, 0] and out[2, 2, 3] == 255
    k = solid(20, 20, (0, 0, 0, 0))
    k[0:3, 0:3] = k[10:13, 10:13] = (1, 2, 3, 255)
    assert [r["id"] for r in components.slice_components(px_of(k)).orderBy("ord").collect()] == ["c0", "c1"]


@pytest.mark.parametrize("eight", [True, False])
def test_labels_by_tiles_equal_labels_of_whole_images(px_of, eight):
    g = np.zeros((17, 23, 4), int)
    g[..., 3] = np.random.default_rng(5).integers(0, 2, (17, 23)) * 255
    px = px_of(g)
    key = lambda d: sorted((r["x"], r["y"], r["root"]) for r in d.where("root is not null").collect())
    assert key(components.labelled(px, F.col("a") > 0, eight)) == key(components.labelled_by_tiles(px, F.col("a") > 0, eight, tile=5))


def test_colours_and_validation(px_of):
    g = np.array([[[10, 20, 30, 0], [10, 20, 30, 255]]])
    assert aggregate.unique_colours(px_of(g)).first()["n"] == 1
    assert aggregate.unique_colours(px_of(g), False).first()["n"] == 2
    v = validate.validate(px_of(solid(4, 3, (1, 1, 1, 255))), validate.Rules(power_of_two=True)).first()
    assert not v["valid"] and v["issues"] == ["WIDTH_NOT_POW2"]
    v = validate.validate(px_of(np.array([[[0, 255, 0, 255], [255, 0, 0, 255]]])), validate.Rules(background=GREEN, max_mismatch=0.2)).first()
    assert v["issues"] == ["BACKGROUND_MISMATCH"]
    assert validate.validate(px_of(g), validate.Rules()).first()["valid"]


def test_palettes(spark, px_of, grids_of):
    p = spark.createDataFrame([(0, 0, 0, 0), (1, 100, 200, 100)], "idx int, r int, g int, b int")
    assert one(grids_of, palette.map_to_palette(px_of(np.array([[[120, 200, 80, 77]]])), p))[0, 0].tolist() == [100, 200, 100, 77]
    g = solid(10, 10, (255, 0, 0, 255))
    g[:, 5:] = (0, 0, 255, 255)
    for kind in ("wu", "octree"):
        c = {tuple(r)[2:] for r in palette.extract(px_of(g), 2, kind).collect()}
        assert c == {(255, 0, 0), (0, 0, 255)}
    y, x = np.mgrid[0:8, 0:8]
    many = np.stack([32 * x, 32 * y, np.full((8, 8), 128), np.full((8, 8), 255)], axis=2)
    for kind in ("wu", "octree"):
        assert 1 <= palette.extract(px_of(many), 4, kind).count() <= 4
    out = one(grids_of, palette.reduce(px_of(many), 4))
    assert len(np.unique(out.reshape(-1, 4), axis=0)) <= 4


def test_equally_light_colours_of_a_palette_go_by_first_appearance(px_of):
    a, b = (23, 8, 15), (8, 17, 8)
    assert np.dot(a, (299, 587, 114)) == np.dot(b, (299, 587, 114))
    up, down = (np.array([[[*c, 255] for c in (p, q, (255, 255, 255), p)]]) for p, q in ((a, b), (b, a)))
    for kind in ("wu", "octree"):
        got = palette.extract(px_of(up, down, up[:, ::-1], down.transpose(1, 0, 2)), 8, kind)
        own = {k: [tuple(r)[2:] for r in got.where(f"image_id = {k}").orderBy("idx").collect()] for k in range(4)}
        white = [(255, 255, 255)]
        assert own == {0: white + [a, b], 1: white + [b, a], 2: white + [a, b], 3: white + [b, a]}


def test_dither_uses_the_palette_only_and_clears_what_is_transparent(px_of, grids_of):
    g = np.random.default_rng(1).integers(0, 256, (9, 9, 4))
    g[0, 0, 3] = 0
    pal = palette.preset_colours("Pico8")
    a, b = (one(grids_of, palette.dither_to_palette(px_of(g), pal)) for _ in range(2))
    assert (a == b).all() and a[0, 0].tolist() == [0, 0, 0, 0] and (a[..., 3] == g[..., 3]).all()
    assert {tuple(c) for c in a[a[..., 3] > 0][:, :3]} <= set(pal)


def test_an_empty_palette_changes_nothing(spark, px_of, grids_of):
    g = solid(2, 2, (9, 9, 9, 255))
    assert (one(grids_of, palette.map_to_palette(px_of(g), spark.createDataFrame([], "idx int, r int, g int, b int"))) == g).all()


def test_geometry(px_of, grids_of):
    assert (one(grids_of, geometry.resize(px_of(np.array([[[1, 2, 3, 4]]])), 2, 2)) == (1, 2, 3, 4)).all()
    assert one(grids_of, geometry.pad_to_multiple(px_of(solid(6, 10, (1, 1, 1, 255))), 8)).shape == (8, 16, 4)
    g = solid(100, 100, (0, 0, 0, 0))
    g[25:75, 25:75] = (255, 0, 0, 255)
    out, report = geometry.crop_pipeline(px_of(g), mode="trim_padded", padding=10, pot="axis")
    r = report.first()
    assert r["max_x"] - r["min_x"] == 70 and (r["final_w"], r["final_h"]) == (128, 128) and one(grids_of, out).shape[:2] == (128, 128)
    r = geometry.crop_boxes(px_of(solid(8, 8, (0, 0, 0, 0)))).first()
    assert (r["final_w"], r["final_h"], r["no_op"]) == (1, 1, True) and "no-op" in r["description"]
    h = solid(80, 100, (1, 1, 1, 255))
    assert one(grids_of, geometry.crop_to_grid(px_of(h), 32, 16)).shape[:2] == (80, 96)
    assert one(grids_of, geometry.crop_to_grid(px_of(h), 32, 16, 2, 2)).shape[:2] == (70, 100)
    small = np.random.default_rng(0).integers(0, 256, (2, 2, 4))
    assert (one(grids_of, geometry.seamless(px_of(small), 4)) == small).all()


@pytest.mark.parametrize("w,h,axis,square", [(192, 100, (256, 128), (256, 256)), (64, 64, (64, 64), (64, 64))])
def test_powers_of_two(px_of, w, h, axis, square):
    px = px_of(solid(h, w, (1, 1, 1, 255)))
    for pot, want in (("axis", axis), ("square", square)):
        r = geometry.crop_boxes(px, pot=pot).first()
        assert (r["final_w"], r["final_h"]) == want


def test_next_power_of_two(spark):
    n = [0, 1, 2, 3, 8, 9, 192, 1024, 1025]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(n)], "i int, n int")
    assert [r[0] for r in d.orderBy("i").select(scalar.next_pow2(F.col("n"))).collect()] == [1, 1, 2, 4, 8, 16, 256, 1024, 2048]


def test_size_statistics(spark):
    d = spark.createDataFrame([(v, v) for v in (10, 12, 11, 13, 14)], "w int, h int")
    s = aggregate.size_statistics(d).first()
    assert (s["max_w"], s["median_w"], s["count"]) == (14, 12, 5)
    s = aggregate.size_statistics(spark.createDataFrame([(v, v) for v in (10, 11, 9, 10, 100)], "w int, h int")).first()
    assert s["max_h"] == 100 and s["median_h"] <= 11 and s["outliers_h"] >= 1


def test_slicing(spark):
    im = spark.createDataFrame([(0, 960, 384)], "image_id long, width int, height int")
    r = generate.slice_grid(im, 1, 5).orderBy("ord").collect()
    assert len(r) == 5 and (r[0]["max_x"], r[0]["max_y"]) == (192, 384)
    r = {x["id"]: x for x in generate.slice_exact(im, 2, 2, 10, 10, 4, 6).collect()}
    assert r["r0c1"]["min_x"] == 14 and r["r1c0"]["min_y"] == 16
    assert generate.slice_grid(spark.createDataFrame([(0, 10, 10)], "image_id long, width int, height int"), 2, 2).count() == 0


def test_snapping(spark):
    d = spark.createDataFrame([(13, 5, 15, 8, 32), (13, 5, 15, 8, 24)], "i int, a int, b int, c int, d int")
    v = [r[0] for r in d.select(cells.snap_modulo(F.col("i"), F.col("a"), F.col("b"), F.col("c"), F.col("d"), 8)).collect()]
    assert v == [11, 13]


def cell(spark, *boxes):
    return spark.createDataFrame([(0, i, f"k{i}", *b, 0.5, 0.5) for i, b in enumerate(boxes)], "image_id long, ord int, id string, min_x int, min_y int, max_x int, max_y int, pivot_x double, pivot_y double")


def test_cells(spark, px_of, grids_of):
    g = solid(80, 80, (0, 0, 0, 0))
    g[33:65, 17:49] = (5, 5, 5, 255)
    _, moved = cells.snap_to_grid(px_of(g), cell(spark, (17, 33, 49, 65)), 16)
    r = moved.first()
    assert (r["min_x"], r["min_y"], r["max_x"] - r["min_x"], r["max_y"] - r["min_y"]) == (16, 32, 32, 32)
    a = solid(20, 20, (0, 0, 0, 0))
    a[0:2, 0:4], a[10:13, 10:15] = (1, 1, 1, 255), (2, 2, 2, 255)
    s = cells.content_size(px_of(a), cell(spark, (0, 0, 10, 10), (10, 10, 20, 20))).first()
    assert (s["w"], s["h"]) == (5, 3)


def test_frames(spark, px_of, grids_of):
    g = solid(4, 4, (0, 0, 0, 0))
    g[0, 0] = (9, 9, 9, 255)
    px, c = px_of(g), cell(spark, (0, 0, 4, 4))
    off = cells.frame_offsets(px, c, 0, 1, "centre", 0)
    assert tuple(off.first())[2:] == (2, 2)
    low = one(grids_of, cells.compose_frames(px, c, cells.frame_offsets(px, c, 0, 1, "baseline")))
    assert low[3, 2, 3] == 255
    same = one(grids_of, cells.compose_frames(px, c, cells.frame_offsets(px, c, 0, 1, "reset")))
    assert (same == g).all()
    atlas = solid(4, 8, (0, 0, 0, 0))
    atlas[2, 3] = (*MAGENTA, 255)
    content = cells.in_cells(px_of(atlas), cell(spark, (4, 0, 8, 4)), 2).where("x = 1 and y = 4").first()
    assert (content["r"], content["g"], content["b"]) == MAGENTA


def test_baseline(spark, px_of, grids_of):
    g = solid(6, 8, (0, 0, 0, 0))
    g[1, 1] = g[2, 5] = (7, 7, 7, 255)
    out, c = cells.align_baseline(px_of(g), cell(spark, (0, 0, 4, 4), (4, 0, 8, 6)))
    out = one(grids_of, out)
    assert out.shape[0] == 6 and (out[5, :, 3] == 255).sum() == 2
    assert [(r["min_x"], r["max_y"]) for r in c.orderBy("ord").collect()] == [(0, 6), (4, 6)]


def test_packing(spark):
    r = cells.pack_row(spark.createDataFrame([(0, 0, 2, 2), (0, 1, 1, 2)], "sheet int, ord long, w int, h int")).first()
    assert (r["atlas_w"], r["atlas_h"]) == (3, 2)
    with pytest.raises(Exception, match="smaller than frame"):
        cells.export_layout(spark.createDataFrame([(0, 0, 20, 2)], "sheet int, ord long, w int, h int"), custom=(8, 8)).collect()


def test_restore_pencil(px_of):
    px = px_of(solid(2, 2, (0, 0, 0, 0)))
    assert pointwise.changed(px, pointwise.restore(px, -1, -1, 3, (1, 2, 3))).first()["changed"] == 4


def test_boxes(spark):
    one_row = spark.range(1)
    lit = lambda *v: [F.lit(x) for x in v]
    b = one_row.select(scalar.from_corners(*lit(1280.0, 608.0, 0.0, 0.0, 2000, 1000)).alias("b")).first()["b"]
    assert (b["max_x"] - b["min_x"], b["max_y"] - b["min_y"]) == (1280, 608)
    assert not one_row.select(scalar.intersects(scalar.box(*lit(0, 0, 1, 10)), scalar.box(*lit(1, 0, 2, 10)))).first()[0]


def test_hex(spark):
    d = spark.createDataFrame([(0, "#aBcD09"), (1, "not-a-color"), (2, "#12345"), (3, None)], "i int, t string")
    v = [r[0] for r in d.orderBy("i").select(color.parse_hex(F.col("t"))).collect()]
    assert tuple(v[0]) == (171, 205, 9, 255) and v[1:] == [None] * 3


def test_oklab_round_trip(spark):
    d = spark.createDataFrame([(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (12, 200, 99)], "r int, g int, b int")
    for r in d.withColumn("c", color.oklab_to_rgb(color.oklab(F.col("r"), F.col("g"), F.col("b")))).collect():
        assert max(abs(r[k] - r["c"][k]) for k in "rgb") <= 5
    with pytest.raises(ValueError):
        color.invert(((1, 2, 3), (2, 4, 6), (1, 1, 1)))


def test_the_calibrated_tolerance_of_a_column_is_that_of_a_key(spark):
    for key in ((0, 255, 0), (10, 20, 30), (250, 250, 250)):
        got = spark.range(1).select(color.calibrated_column(*map(F.lit, key), 20)).first()[0]
        assert got == pytest.approx(color.calibrated(key, 20), rel=1e-6)
    assert color.calibrated((0, 0, 0), 0.5) == (0.5 / 255) ** 2


def test_motion(spark):
    s = temporal.tick((0.0, 0.0, 100.0, 0.0), 0, 0, 1.0, temporal.Motion(friction=0.1))
    assert s[2] == pytest.approx(90)
    w = temporal.World(400, ((10, 380, 60, 400),))
    out = temporal.tick((0.0, 410.0, 0.0, 0.0), 0, 0, 1 / 60, temporal.Motion(), w)
    assert out[1] <= 410


def test_batch_fold_equals_the_tick_function(spark):
    rows = [(b, o, 0.05 * (o % 3), float((o + b) % 3 - 1), float(o % 2)) for b in range(3) for o in range(20)]
    t = spark.createDataFrame(rows, "body_id long, ord long, dt double, input_x double, input_y double")
    for r in temporal.integrate(t).collect():
        s = (0.0,) * 4
        for _, _, dt, ix, iy in sorted(x for x in rows if x[0] == r["body_id"]):
            s = temporal.tick(s, ix, iy, dt, temporal.Motion())
        assert tuple(r)[1:] == pytest.approx(s)


def test_a_stream_of_ticks_ends_like_the_batch(spark, tmp_path):
    rows = [(b, o, 0.05, float((o + b) % 3 - 1), float(o % 2)) for b in range(3) for o in range(12)]
    schema = "body_id long, ord long, dt double, input_x double, input_y double"
    t = spark.createDataFrame(rows, schema)
    for k in range(3):
        t.where(f"ord div 4 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = temporal.stream_motion(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bodies").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r["body_id"]: r for r in spark.sql("select * from bodies").orderBy("ord").collect()}
    for r in temporal.integrate(t).collect():
        assert (last[r["body_id"]]["px"], last[r["body_id"]]["vy"]) == pytest.approx((r["px"], r["vy"]))


def test_template_parts_blend_again_where_they_overlap(spark, grids_of):
    g = one(grids_of, generate.template(spark, generate.Template(rows=1, cols=1, cell_w=16, cell_h=16, show_index=False, show_pivot=False, show_baseline=False)))
    assert g[0, 0, 3] > g[0, 5, 3] == 200


def test_pipeline_without_stages_is_the_identity(px_of, grids_of):
    g = np.random.default_rng(2).integers(0, 256, (3, 4, 4))
    r = pipelines.run(px_of(g), pipelines.Options(background_isolation=False, quantize=False))
    assert (one(grids_of, r.px) == g).all() and r.report().first()["steps"] == []


def test_cleanup(px_of, grids_of):
    g = solid(4, 4, (*GREEN, 255))
    g[1:3, 1:3] = (255, 0, 0, 255)
    r = pipelines.clean(px_of(g), pipelines.Cleanup(tolerance=5, defringe=False, spikes=False, islands=False))
    out = one(grids_of, r.px)
    assert out[0, 0, 3] == 0 and out[1, 1].tolist() == [255, 0, 0, 255]
    assert r.report().first()["steps"] == ["sfondo (tol 5, rimossi 12)", "alpha→128"]


def test_forms_and_arguments():
    with pytest.raises(ValueError):
        pipelines.options_of(pipelines.Form())
    with pytest.raises(ValueError):
        pipelines.options_of(pipelines.Form(snap=True, background="green"))
    o = pipelines.options_of(pipelines.Form(snap=True, background="ff8000", tolerance="7", majority=True, island="x", preset="Aggressive", alpha_on=True, alpha="999"))
    assert (o.background, o.tolerance, o.island_area, o.alpha, o.background_snap) == ((255, 128, 0), 7, 3, 255, True)
    o, shared, indexed = pipelines.batch_options(["in", "out", "--PALETTE", "12", "--shared-palette", "--indexed", "--background-snap", "#102030", "9"])
    assert (shared, indexed, o.quantize, o.background, o.tolerance) == (12, True, False, (16, 32, 48), 9)
    assert pipelines.batch_options(["in", "out", "--palette"])[1] is None


def test_plugins_fail_by_image(px_of):
    def flip(g):
        if g[0, 0, 0] == 13:
            raise RuntimeError("unlucky")
        return g[:, ::-1]

    plugins.register(plugins.Plugin("flip", "Flip", "1.0", flip))
    a, b = solid(1, 2, (1, 1, 1, 255)), solid(1, 2, (13, 0, 0, 255))
    a[0, 0] = (7, 7, 7, 255)
    rows = plugins.apply(px_of(a, b), "flip").collect()
    assert {(r["x"], r["r"]) for r in rows if r["image_id"] == 0} == {(0, 1), (1, 7)}
    assert all("unlucky" in r["error"] for r in rows if r["image_id"] == 1)


def test_history(px_of):
    px = px_of(solid(1, 1, (1, 1, 1, 255)))
    h = plugins.History(px, depth=2)
    for _ in range(3):
        h.push(pointwise.alpha_threshold(h.current))
    assert len(h.past) == 2
    h.undo(), h.undo()
    assert h.undo() is h.current


def test_raster_round_trip_and_density(px_of, grids_of):
    g = np.random.default_rng(4).integers(0, 256, (5, 3, 4))
    px = px_of(g)
    assert (one(grids_of, to_px(to_raster(px))) == g).all()
    assert holes(px).count() == 0 and holes(px.where("x <> 1 or y <> 1")).count() == 1
    assert tuple(images_of(px).first()) == (0, 3, 5)


def test_layers(px_of, grids_of):
    base, top = solid(2, 2, (10, 20, 30, 255)), solid(1, 1, (255, 255, 255, 255))
    out = one(grids_of, compose.draw(px_of(base), px_of(top), 1, 1))
    assert out[1, 1].tolist() == [255] * 4 and out[0, 0].tolist() == [10, 20, 30, 255]


def test_a_clip_named_in_another_case_starts_anew(spark):
    ticks = spark.createDataFrame([(1, k, c, 0.5) for k, c in enumerate(["walk", "walk", "Walk", "Walk", "walk"])], "body_id long, ord long, clip string, dt double")
    clips = spark.createDataFrame([("WALK", 2.0, [5, 6, 7])], "name string, fps double, frames array<int>")
    got = temporal.animate(ticks, clips, 2.0).orderBy("ord").collect()
    assert [(r["elapsed"], r["frame_id"]) for r in got] == [(0.5, 6), (1.0, 7), (0.5, 6), (1.0, 7), (0.5, 6)]
