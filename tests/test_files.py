"""Codecs, readers, writers and documents."""

from __future__ import annotations

import io
import json
import zipfile
import zlib

import numpy as np
import pytest
from support import solid
from pyspark.sql import functions as F

from rasterloom.sources import exports, images, png


@pytest.mark.parametrize("shape", [(1, 1), (3, 7), (16, 5)])
def test_png_round_trip(shape):
    g = np.random.default_rng(0).integers(0, 256, (*shape, 4))
    assert (png.decode(png.encode(g)) == g).all()


def test_indexed_png():
    pal = [(0, 0, 0, 0), (255, 0, 0, 255), (0, 0, 255, 128)]
    g = np.array([[pal[0], pal[1]], [pal[2], (250, 3, 3, 255)]])
    assert png.decode(png.encode_indexed(g, pal)).tolist() == [[list(pal[0]), list(pal[1])], [list(pal[2]), list(pal[1])]]
    with pytest.raises(ValueError):
        png.encode_indexed(g, [])
    with pytest.raises(ValueError):
        png.encode_indexed(g, [(0, 0, 0, 0)] * 257)


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    """Files whose rows use each filter."""
    g = np.random.default_rng(kind).integers(0, 256, (4, 5, 4)).astype(np.uint8)
    rows, above = [], np.zeros(20, int)
    for line in g.reshape(4, 20).astype(int):
        left = np.concatenate([np.zeros(4, int), line[:-4]])
        corner = np.concatenate([np.zeros(4, int), above[:-4]])
        p = left + above - corner
        d = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        guess = {0: 0 * line, 1: left, 2: above, 3: (left + above) // 2, 4: np.choose(d.argmin(axis=0), [left, above, corner])}[kind]
        rows.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    raw = png.encode(g)
    at = raw.index(b"IDAT") - 4
    made = raw[:at] + png._chunk(b"IDAT", zlib.compress(b"".join(rows))) + png._chunk(b"IEND", b"")
    assert (png.decode(made) == g).all()


def test_folder_of_pngs(spark, px_of, grids_of, tmp_path):
    a, b = solid(2, 3, (1, 2, 3, 200)), solid(1, 1, (9, 9, 9, 255))
    files = images.encoded(px_of(a, b)).select(F.format_string("f%d.png", "image_id").alias("name"), "png")
    written = images.write_files(files, str(tmp_path / "out"))
    assert written.count() == 2
    (tmp_path / "out" / "bad.png").write_bytes(b"nothing")
    (tmp_path / "out" / "deeper").mkdir()
    (tmp_path / "out" / "deeper" / "x.png").write_bytes(png.encode(a))
    d = images.read_pngs(spark, str(tmp_path / "out"))
    rows = {r["name"]: r for r in d.collect()}
    assert set(rows) == {"f0.png", "f1.png", "bad.png"} and rows["bad.png"]["error"] and rows["f0.png"]["width"] == 3
    (g,) = grids_of(images.to_px(d.where("name = 'f0.png'"))).values()
    assert (g == a).all()
    report = exports.batch_report(d, F.lit(1)).first()
    assert (report["files"], report["processed"], report["failed"]) == (3, 2, 1)
    (tmp_path / "out" / "bad.png").unlink()
    via = {r["width"]: r for r in images.read_images(spark, str(tmp_path / "out")).collect()}
    assert via[3]["rgba"] == a.astype(np.uint8).tobytes()


def test_automatic_palette_files(px_of):
    g = solid(4, 4, (200, 0, 0, 255))
    g[0, 0] = (0, 0, 0, 0)
    raw = images.encoded_auto(px_of(g)).first()["png"]
    assert png.decode(bytes(raw)).tolist() == g.tolist()


def test_zip(spark):
    rows = [(1, 0, "a.png", b"A"), (1, 1, "b", b"B"), (1, 2, " ", b"C"), (1, 3, "x/y.png", b"D"), (1, 4, "e.PNG", b"E")]
    z = images.zipped(spark.createDataFrame(rows, "sheet_id long, ord int, name string, png binary")).first()["zip"]
    with zipfile.ZipFile(io.BytesIO(bytes(z))) as f:
        assert f.namelist() == ["a.png", "b.png", "e.PNG"] and f.read("b.png") == b"B"


CELLS = "image_id long, ord int, id string, min_x int, min_y int, max_x int, max_y int, pivot_x double, pivot_y double"


def test_metadata_round_trip(spark):
    c = spark.createDataFrame([(0, 1, "b", 4, 0, 8, 4, 0.5, 1.0), (0, 0, "a", 0, 0, 4, 4, 0.5, 0.5)], CELLS)
    d = exports.metadata_json(c)
    text = d.first()["json"]
    assert "PaletteId" not in text and [x["Id"] for x in json.loads(text)["Cells"]] == ["a", "b"]
    back = d.select(exports.read_metadata(F.col("json")).alias("m")).first()["m"]
    assert back["Cells"][1]["PivotNdcY"] == 1.0 and back["PaletteId"] is None
    assert json.loads(exports.metadata_json(c, F.lit("p")).first()["json"])["PaletteId"] == "p"


def test_tiled_map(spark):
    im = spark.createDataFrame([(0, 8, 4), (1, 5, 5)], "image_id long, width int, height int")
    c = spark.createDataFrame([(0, 0, "a", 0, 0, 4, 4, 0.5, 0.5)], CELLS)
    docs = {r["image_id"]: json.loads(r["json"]) for r in exports.tiled_export(c, im).collect()}
    assert docs[0]["layers"][0]["data"] == [1, 2] and docs[0]["tilesets"][0]["imagewidth"] == 4
    assert docs[1]["tilesets"][0]["tiles"] == [{"id": 0, "x": 0, "y": 0, "width": 5, "height": 5}]
