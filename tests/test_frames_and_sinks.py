"""Frames onto sheets, folders as batch and stream, and sinks that leave whole files only."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import exports, images, png, sinks

FRAMES = "sheet_id long, name string, width int, height int, rgba binary"


def brute(frames, rows, cols, cw, ch, alpha):
    sheets = {}
    for s in {f[0] for f in frames}:
        sheet = np.zeros((rows * ch, cols * cw, 4), int)
        for i, (_, _, w, h, raw) in enumerate(sorted((f for f in frames if f[0] == s), key=lambda f: f[1])[: rows * cols]):
            if raw is None:
                continue
            g = np.frombuffer(raw, np.uint8).reshape(h, w, 4)
            on = [(x, y) for y in range(h) for x in range(w) if g[y, x, 3] >= alpha]
            if on:
                x0, y0 = min(p[0] for p in on), min(p[1] for p in on)
                dx = cw // 2 - (x0 + (max(p[0] for p in on) + 1 - x0) // 2)
                dy = ch // 2 - (y0 + (max(p[1] for p in on) + 1 - y0) // 2)
            else:
                dx, dy = int((cw - w) / 2), int((ch - h) / 2)
            for y in range(h):
                for x in range(w):
                    tx, ty = x + dx + i % cols * cw, y + dy + i // cols * ch
                    if 0 <= tx < cols * cw and 0 <= ty < rows * ch and g[y, x, 3] == 255:
                        sheet[ty, tx] = g[y, x]
        sheets[s] = sheet
    return sheets


@pytest.mark.parametrize("seed", range(3))
def test_frames_are_centred_on_their_boxes(spark, grids_of, seed):
    r = random.Random(seed)
    frames = []
    for k in range(14):
        w, h = r.randrange(1, 14), r.randrange(1, 12)  # some larger than a cell
        g = np.array([[[r.randrange(256) for _ in range(3)] + [255 if r.random() < 0.4 else 0] for _ in range(w)] for _ in range(h)], np.uint8)
        if k % 5 == 0:
            g[..., 3] = 0
        frames.append((k % 3, f"f{r.random()}", w, h, g.tobytes()))
    frames += [(2, "0", None, None, None), (7, "0", None, None, None)]
    px, cells = images.import_frames(spark.createDataFrame(frames, FRAMES), 2, 2, 7, 5)
    want = brute(frames, 2, 2, 7, 5, 1)
    got = grids_of(px)
    assert set(got) == set(want) and all((got[s] == want[s]).all() for s in want)
    assert cells.count() == 4 * len(want)
    assert [tuple(c) for c in cells.where("image_id = 7").orderBy("ord").select("id", "min_x", "min_y", "max_x", "max_y").collect()] == [("r0c0", 0, 0, 7, 5), ("r0c1", 7, 0, 14, 5), ("r1c0", 0, 5, 7, 10), ("r1c1", 7, 5, 14, 10)]


def test_no_frames(spark):
    px, cells = images.import_frames(spark.createDataFrame([], FRAMES), 2, 2, 7, 5)
    assert px.count() == cells.count() == 0
    with pytest.raises(ValueError):
        images.import_frames(spark.createDataFrame([], FRAMES), 0, 2)


def _fill(folder, names):
    for i, n in enumerate(names):
        with open(f"{folder}/.tmp", "wb") as f:
            f.write(b"broken" if i % 3 == 2 else png.encode(np.full((2, 3, 4), i, np.uint8)))
        os.rename(f"{folder}/.tmp", f"{folder}/{n}")


def test_stream_and_batch_give_the_same_rows(spark, tmp_path):
    folder, key = tmp_path / "in", lambda d: sorted((r["name"], r["width"], r["rgba"] and bytes(r["rgba"]), r["error"]) for r in d.collect())
    folder.mkdir()

    def step():
        q = images.stream_pngs(spark, str(folder), files_a_batch=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "seen")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    _fill(folder, [f"a{i}.png" for i in range(5)])
    assert key(step()) == key(images.read_pngs(spark, str(folder)))
    _fill(folder, ["b+ %41.png", "c.PNG", "d.png"])  # one more of the pattern's case
    (folder / "note.txt").write_text("no image")
    both = step()
    assert key(both) == key(images.read_pngs(spark, str(folder)))
    report, batch = (exports.batch_report(d, F.lit(0)).first() for d in (both, images.read_pngs(spark, str(folder))))
    assert tuple(report) == tuple(batch) and report["failed"] == 2 and report["processed"] == 5


def test_webp_and_png_by_their_ending(spark):
    from test_codecs import picture, webp_of

    px = picture(6, 7, 1)
    rows = [("x/a.webp", webp_of(px)), ("x/b.png", png.encode(px)), ("x/c.webp", png.encode(px)), ("x/d", b"")]
    got = {r["name"]: r for r in images.decoded(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert bytes(got["a.webp"]["rgba"]) == bytes(got["b.png"]["rgba"]) == px.tobytes()
    assert got["c.webp"]["error"] and got["d"]["error"] and got["d"]["rgba"] is None


def _sink(spark):
    spark.dataSource.register(sinks.FileSink)
    return sinks.FileSink.name()


def test_sink_appends_replaces_and_overwrites(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame(r, "name string, content binary").repartition(3)
    there = lambda: {n: open(f"{out}/{n}", "rb").read() for n in os.listdir(out)}
    w = lambda d, m: d.write.format(_sink(spark)).option("path", out).mode(m).save()
    w(rows(("a b+%41.png", b"1"), ("c.png", b"")), "append")
    assert there() == {"a b+%41.png": b"1", "c.png": b""}
    w(rows(("c.png", b"22"), ("d", b"3")), "append")
    assert there() == {"a b+%41.png": b"1", "c.png": b"22", "d": b"3"}
    w(rows(("e", b"4")), "overwrite")
    assert there() == {"e": b"4"}
    w(rows(("f", b"5")).where("name = ''"), "append")
    assert there() == {"e": b"4"}
    got = images.write_files(rows(("a b+%41.png", b"12"), ("g.png", b"123")), out, content="content")
    assert sorted(map(tuple, got.collect())) == [("a b+%41.png", 2), ("g.png", 3)]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    d = spark.range(0, 40, 1, 4).select(F.format_string("%d.bin", "id").alias("name"), F.when(F.col("id") != 39, F.encode(F.lit("x"), "utf-8")).alias("content"))
    with pytest.raises(Exception, match="no file can be written"):
        d.write.format(_sink(spark)).option("path", out).mode("append").save()
    assert not os.path.exists(out) or not os.listdir(out)


def test_an_attempt_that_was_killed_leaves_no_part_of_a_file(tmp_path):
    """Its folder stays aside, and another attempt's whole files are the ones that count."""
    import pyarrow as pa

    w = sinks.FileWriter(str(tmp_path / "out"), False)
    batch = lambda *r: pa.RecordBatch.from_pylist([{"name": n, "content": c} for n, c in r])

    def killed():
        yield batch(("a", b"half"))
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        w.write(killed())
    done = w.write(iter([batch(("a", b"whole"), ("b", b"2"))]))
    assert not [f for f in os.listdir(tmp_path / "out") if not f.startswith("_staging")]
    w.commit([done, None])
    assert {f: (tmp_path / "out" / f).read_bytes() for f in os.listdir(tmp_path / "out")} == {"a": b"whole", "b": b"2"}
