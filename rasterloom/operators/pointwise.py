"""Operators that look at one pixel at a time: projections, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import color, scalar
from rasterloom.schema import cleared, recolour

RGB = tuple[int, int, int]


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def matches_key(key: RGB, tolerance: float, use_lab: bool = True) -> Column:
    """Is a pixel's colour, whatever its alpha, within the tolerance of a key?"""
    if use_lab:
        own = color.oklab(*_rgb())
        target = F.struct(*[F.lit(float(v)).cast("float").alias(n) for v, n in zip(color.lab_of(key), "lab", strict=True)])
        return color.lab_distance_sq(own, target).cast("double") <= color.calibrated(key, tolerance)
    return color.rgb_distance_sq(_rgb(), key) <= tolerance * tolerance


def chroma_key(px: DataFrame, key: RGB, tolerance: float) -> DataFrame:
    """Remove every pixel of the key colour, anywhere in the image."""
    return cleared(px, (F.col("a") != 0) & matches_key(key, tolerance))


def snap_background(px: DataFrame, key: RGB, tolerance: float) -> DataFrame:
    """Colours near the key become the key; alpha stays."""
    near = (F.col("a") != 0) & (color.rgb_distance_sq(_rgb(), key) <= tolerance * tolerance)
    return recolour(px, near, r=key[0], g=key[1], b=key[2])


def alpha_threshold(px: DataFrame, threshold: int = 128) -> DataFrame:
    """Alpha above the threshold is 255, else 0; colours stay, also under alpha 0."""
    return recolour(px, F.lit(True), a=F.when(F.col("a") > threshold, 255).otherwise(0))


def remove_bleed(px: DataFrame, background: RGB) -> DataFrame:
    """Undo the mix of half transparent pixels with a background; steps are FLOAT."""
    alpha = (F.col("a") / F.lit(255.0)).cast("float")
    one = F.lit(1.0).cast("float")

    def undone(c: str, bg: int) -> Column:
        v = (F.col(c).cast("float") - (one - alpha) * F.lit(float(bg)).cast("float")) / alpha
        return F.least(F.greatest(F.rint(v.cast("float")), F.lit(0.0)), F.lit(255.0)).cast("int")

    return recolour(px, (F.col("a") > 0) & (F.col("a") < 255), **{c: undone(c, bg) for c, bg in zip("rgb", background, strict=True)})


def in_rect(x: int, y: int, w: int, h: int) -> Column:
    return (F.col("x") >= x) & (F.col("x") < x + w) & (F.col("y") >= y) & (F.col("y") < y + h)


def clear_rect(px: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    return cleared(px, in_rect(x, y, w, h))


def remove_selection(px: DataFrame, min_x: int, min_y: int, max_x: int, max_y: int) -> DataFrame:
    """Clear a selection, clamped to the image; one without area does nothing."""
    return clear_rect(px, min_x, min_y, max_x - min_x, max_y - min_y)


def brush_origin(world: Column, size: Column) -> Column:
    return F.floor(world).cast("int") - scalar.idiv(size - 1, 2)


def erase_strokes(px: DataFrame, strokes: DataFrame) -> DataFrame:
    """Square brushes ``(image_id, wx, wy, size)`` set alpha to 0; colours survive.

    Strokes are spread to the pixels they cover, so the join is an equi-join.
    """
    s = strokes.select("image_id", brush_origin(F.col("wx"), F.col("size")).alias("x0"), brush_origin(F.col("wy"), F.col("size")).alias("y0"), "size")
    s = s.select("image_id", "y0", "size", F.explode(F.sequence(F.col("x0"), F.col("x0") + F.col("size") - 1)).alias("x"))
    s = s.select("image_id", "x", F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("size") - 1)).alias("y")).distinct().withColumn("__hit", F.lit(True))
    joined = px.join(s, ["image_id", "x", "y"], "left")
    return joined.select(*[F.when(F.col("__hit"), 0).otherwise(F.col("a")).cast("int").alias("a") if c == "a" else F.col(c) for c in px.columns])


def restore(px: DataFrame, x: int, y: int, side: int, rgb: RGB) -> DataFrame:
    """A square pencil that paints transparent pixels only, opaque."""
    return recolour(px, in_rect(x, y, side, side) & (F.col("a") == 0), r=rgb[0], g=rgb[1], b=rgb[2], a=255)


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(image_id, changed): pixels that differ in any channel."""
    b = before.select("image_id", "x", "y", *[F.col(c).alias(f"b_{c}") for c in "rgba"])
    diff = F.lit(False)
    for c in "rgba":
        diff = diff | (F.col(c) != F.col(f"b_{c}"))
    return after.join(b, ["image_id", "x", "y"]).groupBy("image_id").agg(F.count_if(diff).alias("changed"))
