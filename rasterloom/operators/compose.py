"""Layers onto canvases: ordered source-over per pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalar import blend
from rasterloom.operators.geometry import fill, resize
from rasterloom.operators.pointwise import clear_rect
from rasterloom.schema import PX_COLS, images_of

RGBA_T = "struct<r:int,g:int,b:int,a:int>"


def folded(layers: Column, base: Column | None = None) -> Column:
    """The blend of an array of structs with ``r g b a`` in its order, over ``base`` or nothing."""
    start = base if base is not None else F.struct(*[F.lit(0).alias(c) for c in "rgba"])
    colour = lambda p: F.struct(*[p[c].cast("int").alias(c) for c in "rgba"])
    return F.aggregate(layers, start.cast(RGBA_T), lambda acc, p: blend(colour(p), acc).cast(RGBA_T))


def compose(layers: DataFrame) -> DataFrame:
    """Rows (image_id, x, y, z, r, g, b, a), higher z on top, to one pixel a place.

    Rows without alpha change nothing and are left out before the shuffle; a
    place gathers its own layers only.
    """
    seen = layers.where(F.col("a") > 0)
    z = F.sort_array(F.collect_list(F.struct("z", "r", "g", "b", "a")))
    return seen.groupBy("image_id", "x", "y").agg(folded(z).alias("c")).select("image_id", "x", "y", "c.*")


def on_canvas(layers: DataFrame, sizes: DataFrame) -> DataFrame:
    """``compose`` clipped to dense canvases of (image_id, width, height)."""
    return fill(sizes, compose(layers))


def draw(base: DataFrame, top: DataFrame, dx: int | Column = 0, dy: int | Column = 0) -> DataFrame:
    """Draw images over images of the same id, moved; what falls outside is cut."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    moved = top.select("image_id", (F.col("x") + lit(dx)).cast("int").alias("x"), (F.col("y") + lit(dy)).cast("int").alias("y"), *[F.col(c).alias(f"t_{c}") for c in "rgba"])
    d = base.join(moved, ["image_id", "x", "y"], "left")
    colour = lambda p: F.struct(*[F.col(f"{p}{c}").cast("int").alias(c) for c in "rgba"])
    out = F.when(F.col("t_a").isNull(), colour("").cast(RGBA_T)).otherwise(blend(colour("t_"), colour("")).cast(RGBA_T))
    return d.select("image_id", "x", "y", out.alias("c")).select("image_id", "x", "y", "c.*")


def commit_paste(doc: DataFrame, paste: DataFrame, x: int, y: int, w: int, h: int, scale: float = 1.0) -> DataFrame:
    """A floating paste of size w*h at a scale up to 1, drawn at (x, y)."""
    s = min(1.0, max(1e-4, scale))
    sw, sh = max(1, int(w * s)), max(1, int(h * s))
    return draw(doc, resize(paste, sw, sh) if (sw, sh) != (w, h) else paste, x, y)


def paste_into_cell(atlas: DataFrame, buffer: DataFrame, cell: tuple[int, int, int, int], w: int, h: int) -> DataFrame:
    """Clear a cell, then draw a buffer of size w*h in its middle."""
    x0, y0, x1, y1 = cell
    half = lambda n: int(n / 2)  # noqa: E731  towards zero
    return draw(clear_rect(atlas, x0, y0, x1 - x0, y1 - y0), buffer, x0 + half(x1 - x0 - w), y0 + half(y1 - y0 - h))


def frames_to_grid(frames: DataFrame, sheet: str = "sheet_id") -> tuple[DataFrame, DataFrame]:
    """Frames (sheet, ord, x, y, r, g, b, a), ``ord`` from 0, onto a near square atlas; returns (pixels, cells).

    The first frame gives the cell; columns are the rounded up root of the count.
    """
    n = frames.groupBy(sheet).agg((F.max("ord") + 1).alias("n"), (F.max(F.when(F.col("ord") == 0, F.col("x"))) + 1).alias("cw"), (F.max(F.when(F.col("ord") == 0, F.col("y"))) + 1).alias("ch"))
    n = n.withColumn("cols", F.ceil(F.sqrt("n")).cast("int")).withColumn("rows", F.ceil(F.col("n") / F.col("cols")).cast("int"))
    place = lambda o: ((o % F.col("cols")).cast("int") * F.col("cw"), F.call_function("div", o, F.col("cols")).cast("int") * F.col("ch"))
    ox, oy = place(F.col("ord"))
    d = frames.join(n, sheet).select(F.col(sheet).alias("image_id"), (F.col("x") + ox).alias("x"), (F.col("y") + oy).alias("y"), F.col("ord").alias("z"), *"rgba")
    px = on_canvas(d, n.select(F.col(sheet).alias("image_id"), (F.col("cols") * F.col("cw")).alias("width"), (F.col("rows") * F.col("ch")).alias("height")))
    c = n.withColumn("ord", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    ox, oy = place(F.col("ord"))
    return px, c.select(F.col(sheet).alias("image_id"), "ord", F.format_string("frame_%03d", "ord").alias("id"), ox.alias("min_x"), oy.alias("min_y"), (ox + F.col("cw")).alias("max_x"), (oy + F.col("ch")).alias("max_y"))


__all__ = ["PX_COLS", "commit_paste", "compose", "draw", "folded", "frames_to_grid", "images_of", "on_canvas", "paste_into_cell"]
