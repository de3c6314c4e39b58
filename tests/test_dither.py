"""Dithering by waves and bands against the plain loop."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import color
from rasterloom.operators import dither, palette


def plain(g, pal):
    """Pixel by pixel in raster order, errors pushed ahead."""
    h, w = g.shape[:2]
    lab = np.array([color.lab_of(c) for c in pal], np.float32)
    rest = np.array([[color.lab_of(tuple(map(int, g[y, x, :3]))) for x in range(w)] for y in range(h)], np.float32)
    out = np.zeros_like(g)
    for y in range(h):
        for x in range(w):
            if g[y, x, 3] == 0:
                continue
            d = lab - rest[y, x]
            k = int(np.argmin(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]))
            e = rest[y, x] - lab[k]
            out[y, x] = (*pal[k], g[y, x, 3])
            for dx, dy, n in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                if 0 <= x + dx < w and y + dy < h:
                    rest[y + dy, x + dx] += e * np.float32(n / 16)
    return out


def noise(seed, h, w, clear=0.3):
    r = np.random.default_rng(seed)
    g = r.integers(0, 256, (h, w, 4))
    g[..., 3] = np.where(r.random((h, w)) < clear, 0, r.choice([1, 128, 255], (h, w)))
    return g


SHAPES = ((1, 1), (1, 40), (40, 1), (2, 2), (17, 5), (5, 17), (24, 31))


def test_lab_of_many_is_that_of_each():
    rgb = np.random.default_rng(0).integers(0, 256, (500, 3))
    assert (color.labs_of(rgb) == np.array([color.lab_of(tuple(map(int, c))) for c in rgb])).all()
    assert color.labs_of(np.zeros((0, 3), int)).shape == (0, 3)


@pytest.mark.parametrize("band", [1, 7, 60, dither.BAND])
def test_one_palette(px_of, grids_of, band):
    grids = [noise(k, *s) for k, s in enumerate(SHAPES)] + [noise(9, 6, 6, 1.1), noise(10, 12, 12, -1)]
    out = grids_of(dither.dithered(px_of(*grids), palette.preset_colours("Pico8"), band))
    for k, g in enumerate(grids):
        assert (out[k] == plain(g, palette.preset_colours("Pico8"))).all(), k


@pytest.mark.parametrize("band", [1, 50, dither.BAND])
def test_a_palette_an_image(spark, px_of, grids_of, band):
    grids = [noise(20 + k, *s) for k, s in enumerate(SHAPES)]
    pals = {k: [tuple(map(int, c)) for c in np.random.default_rng(k).integers(0, 256, (1 + 3 * k, 3))] for k in range(len(grids) - 1)}
    own = spark.createDataFrame([(k, i, *c) for k, p in pals.items() for i, c in enumerate(p)], "image_id long, idx int, r int, g int, b int")
    out = grids_of(dither.dithered(px_of(*grids), own, band))
    for k, g in enumerate(grids):
        assert (out[k] == (plain(g, pals[k]) if k in pals else g)).all(), k


def test_equal_colours_of_a_palette_give_the_first_and_order_of_rows_is_of_no_matter(px_of, grids_of):
    g = noise(3, 9, 9)
    out = grids_of(dither.dithered(px_of(g).orderBy(F.desc("x"), "y"), [(9, 9, 9), (200, 0, 0), (9, 9, 9)], 20))[0]
    assert (out == plain(g, [(9, 9, 9), (200, 0, 0)])).all()


def test_null_ids_empty_tables_and_other_columns(spark, px_of):
    g = noise(4, 6, 7)
    d = px_of(g).withColumn("image_id", F.lit(None).cast("long")).withColumn("note", F.lit("x"))
    zero = px_of(noise(5, 6, 7)).withColumn("note", F.lit("y"))
    got = {(r["image_id"], r["x"], r["y"]): tuple(r)[3:] for r in dither.dithered(d.unionByName(zero), [(0, 0, 0), (255, 255, 255)], 5).collect()}
    for key, grid in ((None, g), (0, noise(5, 6, 7))):
        want = plain(grid, [(0, 0, 0), (255, 255, 255)])
        assert all(got[key, x, y] == tuple(want[y, x]) for y in range(6) for x in range(7))
    none = px_of(g).where("false")
    assert dither.dithered(none, [(0, 0, 0)]).count() == 0 and dither.dithered(none, palette.extract(none, 4)).count() == 0


def test_bands_hold_no_more_than_a_row_beyond_their_size(monkeypatch):
    seen = []
    real = dither.diffuse
    monkeypatch.setattr(dither, "diffuse", lambda bands, rgba: (seen.append(len(rgba)), real(bands, rgba))[1])
    h, w = 300, 20
    y, x = np.divmod(np.arange(h * w), w)
    t = pa.table({"image_id": pa.array(np.zeros(h * w, np.int64)), **{n: pa.array(v.astype(np.int32)) for n, v in (("x", x), ("y", y), ("r", x), ("g", y % 256), ("b", x), ("a", x * 0 + 255))}})
    out = pa.Table.from_batches(dither._stream(iter(t.to_batches(max_chunksize=33)), np.array([(0, 0, 0), (255, 255, 255)]), 100))
    assert out.num_rows == h * w and max(seen) <= 100 + 33 + w and len(seen) > 40


def test_waves_beat_the_loop():
    g = noise(6, 512, 512, 0.0)
    pal = np.array(palette.preset_colours("Pico8"))
    y, x = np.divmod(np.arange(512 * 512), 512)
    t = time.perf_counter()
    dither.diffuse([dither.Band(x, y, pal, None)], g.reshape(-1, 4).astype(np.int32))
    waves = time.perf_counter() - t
    t = time.perf_counter()
    plain(g[:32], [tuple(map(int, c)) for c in pal])
    assert waves * 8 < (time.perf_counter() - t) * 16  # 32 of 512 rows were looped
