"""Image files in and out, and frame sequences."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.operators.compose import on_canvas
from rasterloom.schema import RASTER, to_px, to_raster
from rasterloom.sources import png, sinks, webp


DECODERS = {".png": png.decode, ".webp": webp.decode}


def decoded(files: DataFrame) -> DataFrame:
    """(path, name, image_id, width, height, rgba, error) of files (path, content), PNG or lossless WebP by their ending.

    ``image_id`` hashes the path.  A file that can't be read has an error and no pixels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    g = DECODERS[path[path.rindex(".") :].lower()](raw)
                    out.append((path, g.shape[1], g.shape[0], g.tobytes(), None))
                except Exception as e:  # noqa: BLE001  one bad file doesn't end a batch
                    out.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "width", "height", "rgba", "error"])

    d = files.select("path", "content").mapInArrow(run, "path string, width int, height int, rgba binary, error string")
    return d.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.xxhash64("path").alias("image_id"), "width", "height", "rgba", "error")


def read_pngs(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """``decoded`` files of one folder, not of those below it; a task takes files up to ``spark.sql.files.maxPartitionBytes``."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder))


def stream_pngs(spark: SparkSession, folder: str, pattern: str = "*.png", files_a_batch: int = 1000) -> DataFrame:
    """``decoded`` files as they arrive in the folder, each once; the query's checkpoint holds which have been seen."""
    arriving = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch)
    return decoded(arriving.load(folder))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, image_id, width, height, rgba) through Spark's own image source (png, jpeg, gif, bmp), whose bytes are BGR(A)."""
    d = spark.read.format("image").load(folder).select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("n"), "image.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            out = []
            for r in rows:
                g = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["n"])
                rgb = g[..., [2, 1, 0]] if r["n"] >= 3 else np.repeat(g[..., :1], 3, axis=2)
                a = g[..., 3:4] if r["n"] == 4 else np.full((*g.shape[:2], 1), 255, np.uint8)
                out.append(np.concatenate([rgb, a], axis=2).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], ["path", "width", "height", "rgba"])

    return d.mapInArrow(run, "path string, width int, height int, rgba binary").withColumn("image_id", F.xxhash64("path"))


def encoded(px: DataFrame, palette: list[tuple[int, int, int, int]] | None = None) -> DataFrame:
    """(image_id, png binary): RGBA files, or indexed ones with a locked palette."""
    if palette is not None and not 1 <= len(palette) <= 256:
        raise ValueError("a palette has 1 to 256 colours")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                g = np.frombuffer(r["rgba"], np.uint8).reshape(r["height"], r["width"], 4)
                out.append(png.encode(g) if palette is None else png.encode_indexed(g, palette))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["image_id", "png"])

    return to_raster(px).mapInArrow(run, "image_id long, png binary")


def encoded_auto(px: DataFrame, k: int = 256) -> DataFrame:
    """Indexed files, each with its own palette, a transparent entry included where it is needed."""
    from rasterloom.operators.palette import extract

    own = extract(px, min(255, k)).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", "r", "g", "b"))).alias("pal"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                g = np.frombuffer(r["rgba"], np.uint8).reshape(r["height"], r["width"], 4)
                pal = [(c["r"], c["g"], c["b"], 255) for c in r["pal"] or []] + ([(0, 0, 0, 0)] if (g[..., 3] == 0).any() or not r["pal"] else [])
                out.append(png.encode_indexed(np.where(g[..., 3:] == 0, 0, g), pal))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["image_id", "png"])

    return to_raster(px).join(own, "image_id", "left").select("image_id", "width", "height", "rgba", "pal").mapInArrow(run, "image_id long, png binary")


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "png") -> DataFrame:
    """Write each row's bytes to ``folder/name`` through ``sinks.FileSink``; returns (name, bytes) of these files as they lie in the folder.

    ``folder`` is one that driver and executors share; any filesystem that pyarrow knows by its URI.
    """
    spark = files.sparkSession
    spark.dataSource.register(sinks.FileSink)
    rows = files.select(F.col(name).alias("name"), F.col(content).alias("content"))
    rows.write.format(sinks.FileSink.name()).option("path", folder).mode("append").save()
    lying = spark.read.format("binaryFile").load(folder if "://" in folder else f"file://{folder}").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    return rows.select("name").distinct().join(lying, F.col("name") == F.col("file")).select("name", "bytes")


BAD_NAME = r'[<>:"/\\|?*\x00-\x1F]'


def frame_name(i: Column, cell_id: Column) -> Column:
    """``007_walk.png``: invalid characters become ``_``, a blank id ``cell``."""
    clean = F.regexp_replace(F.coalesce(cell_id, F.lit("")), BAD_NAME, "_")
    return F.format_string("%03d_%s.png", i.cast("int"), F.when(F.trim(clean) == "", F.lit("cell")).otherwise(clean))


def single_name(cell_id: Column, w: Column, h: Column) -> Column:
    return F.concat(cell_id, F.lit("_"), w.cast("string"), F.lit("x"), h.cast("string"), F.lit(".png"))


def zipped(files: DataFrame, sheet: str = "sheet_id") -> DataFrame:
    """(sheet, zip binary) of rows (sheet, ord, name, png): names that are blank or invalid are skipped, ``.png`` is added where it lacks."""
    ok = files.where((F.trim(F.coalesce("name", F.lit(""))) != "") & ~F.col("name").rlike(BAD_NAME) & F.col("png").isNotNull())
    ok = ok.select(F.col(sheet).alias("sheet"), "ord", F.when(F.lower("name").endswith(".png"), F.col("name")).otherwise(F.concat("name", F.lit(".png"))).alias("name"), "png")

    def run(key, t):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in sorted(t.to_pylist(), key=lambda r: r["ord"]):
                z.writestr(zipfile.ZipInfo(r["name"]), r["png"])
        return pa.table({sheet: pa.array([key[0].as_py()], pa.int64()), "zip": pa.array([out.getvalue()], pa.binary())})

    return ok.groupBy("sheet").applyInArrow(run, f"{sheet} long, zip binary")


def unzipped(zips: DataFrame, sheet: str = "sheet_id") -> DataFrame:
    """(sheet, ord, name, content): the entries of each archive, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    names = z.namelist()
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(names), pa.int64()), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string()), pa.array([z.read(n) for n in names], pa.binary())], [sheet, "ord", "name", "content"])

    return zips.select(F.col(sheet).cast("long"), "zip").mapInArrow(run, f"{sheet} long, ord int, name string, content binary")


def placed_frames(files: DataFrame, rows: int, cols: int, sheet: str = "sheet_id") -> DataFrame:
    """(sheet, ord, id, name): the first rows*cols files by name on a grid; places without a file have a null name."""
    order = Window.partitionBy(sheet).orderBy("name")
    first = files.withColumn("ord", F.row_number().over(order) - 1).where(F.col("ord") < rows * cols)
    places = files.select(sheet).distinct().withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))))
    out = places.join(first, [sheet, "ord"], "left")
    return out.select(sheet, "ord", F.concat(F.lit("r"), F.call_function("div", F.col("ord"), F.lit(cols)), F.lit("c"), F.col("ord") % cols).alias("id"), "name")


def import_frames(frames: DataFrame, rows: int, cols: int, cell_w: int = 64, cell_h: int = 64, alpha: int = 1, sheet: str = "sheet_id") -> tuple[DataFrame, DataFrame]:
    """Frames (sheet, name, width, height, rgba), packed or as read from files, onto one sheet each; returns (pixels, cells).

    The first rows*cols frames by name get a cell each, row by row; a frame's opaque box is put on the
    middle of its cell, or the whole frame if nothing in it reaches ``alpha``.  What leaves the cell
    lies on its neighbours, later frames on top; what leaves the sheet is cut.  Cells without a frame
    stay empty, as do those of files that couldn't be read.  Boxes are taken from the packed rows in
    the task that reads them, and only opaque pixels go further.
    """
    if min(rows, cols) < 1 or min(cell_w, cell_h) < 4:
        raise ValueError("a grid of one cell and cells of four pixels at least")
    order = Window.partitionBy(sheet).orderBy("name", "place")
    named = frames.withColumn("place", F.monotonically_increasing_id()) if "place" not in frames.columns else frames
    first = named.withColumn("ord", F.row_number().over(order) - 1).where(F.col("ord") < rows * cols)
    half = lambda n: int(n / 2)  # noqa: E731  towards zero

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                if r["rgba"] is None or not r["width"] or not r["height"]:
                    continue
                g = np.frombuffer(r["rgba"], np.uint8).reshape(r["height"], r["width"], 4)
                ys, xs = np.nonzero(g[..., 3] >= alpha)
                if len(xs):
                    dx = cell_w // 2 - (int(xs.min()) + (int(xs.max()) + 1 - int(xs.min())) // 2)
                    dy = cell_h // 2 - (int(ys.min()) + (int(ys.max()) + 1 - int(ys.min())) // 2)
                else:
                    dx, dy = half(cell_w - r["width"]), half(cell_h - r["height"])
                y, x = np.nonzero(g[..., 3])
                colour = g[y, x].astype(np.int32)
                x, y = x + dx + r["ord"] % cols * cell_w, y + dy + r["ord"] // cols * cell_h
                on = (x >= 0) & (x < cols * cell_w) & (y >= 0) & (y < rows * cell_h)
                n = int(on.sum())
                values = [pa.array([r["sheet"]] * n, pa.int64()), *(pa.array(v[on].astype(np.int32)) for v in (x, y)), pa.array(np.full(n, r["ord"], np.int32)), *(pa.array(colour[on, k]) for k in range(4))]
                yield pa.RecordBatch.from_arrays(values, ["image_id", "x", "y", "z", *"rgba"])

    layers = first.select(F.col(sheet).cast("long").alias("sheet"), "ord", "width", "height", "rgba").mapInArrow(run, "image_id long, x int, y int, z int, r int, g int, b int, a int")
    sheets = frames.select(F.col(sheet).cast("long").alias("image_id")).distinct()
    px = on_canvas(layers, sheets.select("image_id", F.lit(cols * cell_w).alias("width"), F.lit(rows * cell_h).alias("height")))
    c = sheets.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))))
    col, row = F.col("ord") % cols, F.call_function("div", F.col("ord"), F.lit(cols)).cast("int")
    at = {"min_x": col * cell_w, "min_y": row * cell_h, "max_x": (col + 1) * cell_w, "max_y": (row + 1) * cell_h}
    cells = c.select("image_id", "ord", F.concat(F.lit("r"), row, F.lit("c"), col).alias("id"), *[v.cast("int").alias(k) for k, v in at.items()], F.lit(0.5).alias("pivot_x"), F.lit(0.5).alias("pivot_y"))
    return px, cells


__all__ = ["RASTER", "decoded", "encoded", "encoded_auto", "frame_name", "import_frames", "placed_frames", "read_images", "read_pngs", "single_name", "stream_pngs", "to_px", "unzipped", "write_files", "zipped"]
