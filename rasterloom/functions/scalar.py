"""Sizes, boxes, viewports and option parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(c: Column) -> Column:
    return c.cast("int")


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b)).cast("int")


def next_pow2(n: Column) -> Column:
    """The least power of two that isn't below ``n``; 1 for 1 and less."""
    v = (n - 1).cast("int")
    for s in (1, 2, 4, 8, 16):
        v = v.bitwiseOR(F.shiftright(v, s))
    return F.when(n <= 1, 1).otherwise(v + 1).cast("int")


def is_pow2(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def ceil_to_multiple(n: Column, m: Column | int) -> Column:
    m = m if isinstance(m, Column) else F.lit(m)
    return F.when(m < 1, n).otherwise(idiv(n + m - 1, m) * m).cast("int")


def box(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """A half-open box."""
    return F.struct(*[whole(c).alias(n) for c, n in zip((min_x, min_y, max_x, max_y), ("min_x", "min_y", "max_x", "max_y"), strict=True)])


def width(b: Column) -> Column:
    return b["max_x"] - b["min_x"]


def height(b: Column) -> Column:
    return b["max_y"] - b["min_y"]


def is_empty(b: Column) -> Column:
    return (width(b) <= 0) | (height(b) <= 0)


def intersects(p: Column, q: Column) -> Column:
    return (p["min_x"] < q["max_x"]) & (q["min_x"] < p["max_x"]) & (p["min_y"] < q["max_y"]) & (q["min_y"] < p["max_y"])


def from_inclusive(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return box(min_x, min_y, max_x + 1, max_y + 1)


def from_corners(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> Column:
    """The box of two world corners in either order, rounded outwards and clamped to the image; zeros if nothing is left."""
    lo = lambda a, b: F.greatest(F.lit(0), F.floor(F.least(a, b))).cast("int")
    hi = lambda a, b, n: F.least(n, F.ceil(F.greatest(a, b))).cast("int")
    b = box(lo(x0, x1), lo(y0, y1), hi(x0, x1, w), hi(y0, y1, h))
    zero = box(*[F.lit(0)] * 4)
    return F.when(is_empty(b), zero).otherwise(b)


def clamp_box(b: Column, w: Column, h: Column) -> Column:
    return box(F.greatest(F.lit(0), b["min_x"]), F.greatest(F.lit(0), b["min_y"]), F.least(w, b["max_x"]), F.least(h, b["max_y"]))


def world_to_screen(w: Column, zoom: Column, pan: Column) -> Column:
    return w * zoom + pan


def screen_to_world(s: Column, zoom: Column, pan: Column) -> Column:
    return (s - pan) / zoom


def zoom_at(screen: Column, zoom: Column, pan: Column, factor: Column) -> Column:
    """struct<zoom, pan>: zoom by a factor within 0.05 and 64; the world point under ``screen`` stays there."""
    new = F.least(F.greatest(zoom * factor, F.lit(0.05)), F.lit(64.0))
    return F.struct(new.alias("zoom"), (screen - screen_to_world(screen, zoom, pan) * new).alias("pan"))


def fit_scale(w: Column, h: Column, canvas_w: Column, canvas_h: Column) -> Column:
    """1, or less for what is larger than the canvas."""
    return F.when((w > canvas_w) | (h > canvas_h), F.least(canvas_w / w, canvas_h / h)).otherwise(F.lit(1.0))


def shown_size(n: Column, scale: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n * scale).cast("int"))


def centred(canvas: Column, n: Column) -> Column:
    return idiv(canvas - n, 2)


#: Pivots in shares of the cell (fixed values).
PIVOTS = {
    "TopLeft": (0.0, 0.0), "TopCenter": (0.5, 0.0), "TopRight": (1.0, 0.0),
    "MiddleLeft": (0.0, 0.5), "Center": (0.5, 0.5), "MiddleRight": (1.0, 0.5),
    "BottomLeft": (0.0, 1.0), "BottomCenter": (0.5, 1.0), "BottomRight": (1.0, 1.0),
}


def pivot(name: Column) -> Column:
    """struct<x, y>; the centre for any other name."""
    x, y = F.lit(0.5), F.lit(0.5)
    for k, (px, py) in PIVOTS.items():
        x, y = F.when(name == k, F.lit(px)).otherwise(x), F.when(name == k, F.lit(py)).otherwise(y)
    return F.struct(x.alias("x"), y.alias("y"))


def parse_int(text: Column, fallback: int) -> Column:
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(fallback))


def flag_int(args: Column, flag: str) -> Column:
    """The integer after the first occurrence of a flag, in any case; null if there is none or it is the last."""
    at = F.array_position(F.transform(args, F.lower), flag.lower())
    return F.when((at > 0) & (at < F.size(args)), F.trim(F.get(args, at.cast("int"))).try_cast("int"))


def blend(src: Column, dst: Column) -> Column:
    """Source over destination, structs of r, g, b, a; halves go to the even neighbour.

    A source without alpha changes nothing; an opaque source, or a destination
    without alpha, gives the source.  All steps are FLOAT.
    """
    share = lambda c: (c / F.lit(255.0)).cast("float")
    sa, da = share(src["a"]), share(dst["a"])
    one = F.lit(1.0).cast("float")
    out = sa + da * (one - sa)
    mix = lambda c: F.rint(((src[c].cast("float") * sa + dst[c].cast("float") * da * (one - sa)) / out).cast("float")).cast("int")
    mixed = F.struct(mix("r").alias("r"), mix("g").alias("g"), mix("b").alias("b"), F.rint(out * F.lit(255.0).cast("float")).cast("int").alias("a"))
    plain = lambda p: F.struct(*[p[c].cast("int").alias(c) for c in "rgba"])
    return F.when(src["a"] == 0, plain(dst)).when((src["a"] == 255) | (dst["a"] == 0), plain(src)).otherwise(mixed)
