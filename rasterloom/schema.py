"""The pixel relation and its packed form.

``px``: one row a pixel, ``(image_id, x, y, r, g, b, a)``, dense: every image has
width*height rows.  Transparent pixels (a = 0) are values, not absences.
``raster``: one row an image, row-major RGBA bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PX = "image_id long, x int, y int, r int, g int, b int, a int"
PX_COLS = ("image_id", "x", "y", "r", "g", "b", "a")
RASTER = "image_id long, width int, height int, rgba binary"
CELLS = "image_id long, ord int, id string, min_x int, min_y int, max_x int, max_y int, pivot_x double, pivot_y double"
RGBA = ("r", "g", "b", "a")
#: Bytes of small groups that a task hands to a kernel at once.
_HELD = 4 << 20


def byte(c: Column) -> Column:
    """Clamp to 0..255."""
    return F.least(F.greatest(c, F.lit(0)), F.lit(255)).cast("int")


def packed(r: Column | str = "r", g: Column | str = "g", b: Column | str = "b", a: Column | str | None = None) -> Column:
    """A colour as one BIGINT: rgb, or rgba if alpha is given."""
    col = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")
    rgb = F.shiftleft(col(r), 16).bitwiseOR(F.shiftleft(col(g), 8)).bitwiseOR(col(b))
    return rgb if a is None else F.shiftleft(rgb, 8).bitwiseOR(col(a))


def recolour(px: DataFrame, when: Column, **to: Column | int) -> DataFrame:
    """Channels in ``to`` take their new value where ``when`` holds; all of them see the old pixel."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return px.select(*[F.when(when, lit(to[c])).otherwise(F.col(c)).cast("int").alias(c) if c in to else F.col(c) for c in px.columns])


def cleared(px: DataFrame, when: Column) -> DataFrame:
    """Removal writes (0, 0, 0, 0)."""
    return recolour(px, when, r=0, g=0, b=0, a=0)


def images_of(px: DataFrame) -> DataFrame:
    """(image_id, width, height)."""
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, one an image, dealt by ``image_id`` over the cluster before each becomes many.

    Files and shuffles of a few bytes an image are few partitions, and an explode of
    them would be as few tasks.  The number is given, so Spark doesn't merge them again.
    """
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "image_id")


def holes(px: DataFrame) -> DataFrame:
    """Images whose rows aren't dense: the operators on neighbours would be wrong there."""
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count("*").alias("n")).where(F.col("n") != F.col("width") * F.col("height"))


def grid_of(t: pa.Table) -> np.ndarray:
    """(height, width, 4) of one image's rows in any order."""
    col = lambda c: t.column(c).to_numpy().astype(np.int64)
    x, y = col("x"), col("y")
    out = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 4), np.int32)
    out[y, x] = np.stack([col(c) for c in RGBA], axis=1)
    return out


def rows_of(image_id: int | None, grid: np.ndarray) -> pa.Table:
    h, w = grid.shape[:2]
    y, x = np.divmod(np.arange(h * w, dtype=np.int32), max(1, w))
    flat = grid.reshape(-1, 4).astype(np.int32)
    return pa.table({"image_id": pa.array([image_id] * (h * w), pa.int64()), "x": x.astype(np.int32), "y": y.astype(np.int32), **{c: flat[:, i] for i, c in enumerate(RGBA)}})


def per_image(px: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a kernel on whole images: for steps whose pixels depend on each other in sequence."""

    def run(key, t):
        return rows_of(key[0].as_py(), kernel(grid_of(t)))

    return px.select(*PX_COLS).groupBy("image_id").applyInArrow(run, PX)


def by_groups(rows: DataFrame, keys: list[str], kernel: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``kernel`` over groups of equal integer ``keys``, many at once: it gets their rows, group after group, and where each begins and the last ends.

    For groups so small that a call each would take longer than their work.  A
    task holds ``_HELD`` bytes, or the largest group if that is more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def done(t: pa.Table, last: bool) -> pa.Table:
            """What is left of ``t`` once its whole groups have gone."""
            k = [f(t.column(c)).to_numpy() for c in keys for f in (lambda c: c.fill_null(0), lambda c: c.is_null())]
            new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in k])] if t.num_rows else np.zeros(0, bool)
            cuts = np.r_[np.flatnonzero(new), [t.num_rows] if last else []].astype(np.int64)
            if len(cuts) > 1:
                out.extend(kernel(t.slice(0, int(cuts[-1])).combine_chunks(), cuts).to_batches())
            return t.slice(int(cuts[-1])) if len(cuts) else t

        out: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            count += b.nbytes
            if count >= _HELD:
                rest = done(pa.Table.from_batches(held).combine_chunks(), False)
                # a group that goes on is only looked at again once it has doubled
                held, count = rest.to_batches(), min(rest.nbytes, _HELD - rest.nbytes)
                yield from out
                out.clear()
        if held:
            done(pa.Table.from_batches(held).combine_chunks(), True)
            yield from out

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def to_raster(px: DataFrame) -> DataFrame:
    def run(t: pa.Table, cuts: np.ndarray) -> pa.Table:
        x, y, *colours = (t.column(c).to_numpy() for c in PX_COLS[1:])
        begin, n = cuts[:-1], np.diff(cuts)
        w, h = np.maximum.reduceat(x, begin).astype(np.int64) + 1, np.maximum.reduceat(y, begin).astype(np.int64) + 1
        ends = np.cumsum(w * h)
        flat = np.zeros((int(ends[-1]), 4), np.uint8)
        flat[np.repeat(ends - w * h, n) + y.astype(np.int64) * np.repeat(w, n) + x] = np.stack([c.astype(np.uint8) for c in colours], axis=1)
        rgba = [flat[e - m : e].tobytes() for e, m in zip(ends.tolist(), (w * h).tolist(), strict=True)]
        return pa.table({"image_id": t.column("image_id").take(pa.array(begin)), "width": w.astype(np.int32), "height": h.astype(np.int32), "rgba": pa.array(rgba, pa.binary())})

    return by_groups(px.select(*PX_COLS), ["image_id"], run, RASTER)


def to_px(raster: DataFrame) -> DataFrame:
    """Unpack without shuffling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if r["width"] and r["height"]:
                    g = np.frombuffer(r["rgba"], np.uint8).reshape(r["height"], r["width"], 4)
                    yield from rows_of(r["image_id"], g).to_batches()

    return raster.select("image_id", "width", "height", "rgba").mapInArrow(run, PX)
