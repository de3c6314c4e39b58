"""Coordinate remaps: every target pixel is an equi-join or a shift of a source pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import scalar
from rasterloom.operators.aggregate import opaque_box
from rasterloom.schema import PX_COLS, images_of, recolour, spread


def grid(sizes: DataFrame, w: str = "width", h: str = "height") -> DataFrame:
    """(the columns of ``sizes``, x, y): every place of images of these sizes."""
    s = spread(sizes.where((F.col(w) > 0) & (F.col(h) > 0)))
    s = s.withColumn("y", F.explode(F.sequence(F.lit(0), (F.col(h) - 1).cast("int"))))
    return s.withColumn("x", F.explode(F.sequence(F.lit(0), (F.col(w) - 1).cast("int"))))


def fill(sizes: DataFrame, px: DataFrame) -> DataFrame:
    """Dense images of the given sizes: the pixels there are, transparent ones elsewhere."""
    g = grid(sizes).select("image_id", "x", "y")
    # pixels made by an explode look small to Spark, so without the hint it may send all of them to the driver for a broadcast
    return g.join(px.select(*PX_COLS).hint("merge"), ["image_id", "x", "y"], "left").select("image_id", "x", "y", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in "rgba"])


def blank(spark, image_id: int, w: int, h: int, rgba: tuple[int, int, int, int]) -> DataFrame:
    """A canvas of one colour; sides of 1 to 8192."""
    if not (1 <= w <= 8192 and 1 <= h <= 8192):
        raise ValueError("sides: 1 to 8192")
    at = spark.range(w * h)
    return at.select(F.lit(image_id).cast("long").alias("image_id"), (F.col("id") % w).cast("int").alias("x"), F.call_function("div", F.col("id"), F.lit(w)).cast("int").alias("y"), *[F.lit(v).cast("int").alias(c) for v, c in zip(rgba, "rgba", strict=True)])


def blanks(sizes: DataFrame) -> DataFrame:
    """A canvas for each row (image_id, width, height, r, g, b, a); rows with a side beyond 1 to 8192, or null, give none."""
    fits = F.col("width").between(1, 8192) & F.col("height").between(1, 8192)
    return grid(sizes.where(fits)).select(F.col("image_id").cast("long").alias("image_id"), "x", "y", *[F.col(c).cast("int").alias(c) for c in "rgba"])


def disc(spark, image_id: int = 0) -> DataFrame:
    """A 64x64 atlas with a disc of radius 20 around its centre."""
    return _with_disc(blank(spark, image_id, 64, 64, (26, 26, 34, 255)))


def discs(images: DataFrame) -> DataFrame:
    """``disc`` for each row (image_id)."""
    side = F.lit(64)
    return _with_disc(blanks(images.select("image_id", side.alias("width"), side.alias("height"), *[F.lit(v).alias(c) for v, c in zip((26, 26, 34, 255), "rgba", strict=True)])))


def _with_disc(px: DataFrame) -> DataFrame:
    inside = F.col("x").between(8, 55) & F.col("y").between(8, 55) & ((F.col("x") - 32) * (F.col("x") - 32) + (F.col("y") - 32) * (F.col("y") - 32) < 400)
    return recolour(px, inside, r=200, g=80, b=255)


def resize(px: DataFrame, tw: int, th: int, ox: float = 0.0, oy: float = 0.0) -> DataFrame:
    """Nearest neighbour."""
    t = grid(images_of(px).select("image_id", F.col("width").alias("sw"), F.col("height").alias("sh"), F.lit(tw).alias("width"), F.lit(th).alias("height")))
    from_ = lambda d, s, n, o: F.least(F.greatest(F.floor(F.lit(o) + F.col(d) * F.col(s).cast("double") / n), F.lit(0)), F.col(s) - 1).cast("int")
    t = t.select("image_id", F.col("x").alias("tx"), F.col("y").alias("ty"), from_("x", "sw", tw, ox).alias("x"), from_("y", "sh", th, oy).alias("y"))
    return t.join(px, ["image_id", "x", "y"]).select("image_id", F.col("tx").alias("x"), F.col("ty").alias("y"), *"rgba")


def crop(px: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cut each image to its box (image_id, min_x, min_y, max_x, max_y); images without a box, or with an empty one, give nothing."""
    b = boxes.select("image_id", "min_x", "min_y", "max_x", "max_y")
    d = px.join(b, "image_id").where((F.col("x") >= F.col("min_x")) & (F.col("x") < F.col("max_x")) & (F.col("y") >= F.col("min_y")) & (F.col("y") < F.col("max_y")))
    return d.select("image_id", (F.col("x") - F.col("min_x")).alias("x"), (F.col("y") - F.col("min_y")).alias("y"), *"rgba")


def crop_fixed(px: DataFrame, min_x: int, min_y: int, max_x: int, max_y: int) -> DataFrame:
    """One box for all images; a filter and a shift.  Boxes beyond the image are an error of the caller's, checked by ``outside``."""
    d = px.where((F.col("x") >= min_x) & (F.col("x") < max_x) & (F.col("y") >= min_y) & (F.col("y") < max_y))
    return d.select("image_id", (F.col("x") - min_x).alias("x"), (F.col("y") - min_y).alias("y"), *"rgba")


def outside(images: DataFrame, min_x: int, min_y: int, max_x: int, max_y: int) -> DataFrame:
    """The images that the box doesn't fit into."""
    bad = F.lit(min_x < 0 or min_y < 0 or min_x >= max_x or min_y >= max_y)
    return images.where(bad | (F.col("width") < max_x) | (F.col("height") < max_y))


MODES, POT = ("trim", "roi", "trim_padded"), ("none", "axis", "square")


def crop_boxes(px: DataFrame, mode: str = "trim", alpha: int = 1, padding: int = 0, pot: str = "none", roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(image_id, box, final_w, final_h, pot_applied, description) of the crop pipeline.

    The order is box, padding, clamp, crop, and then padding to powers of two at
    the right and the bottom.  Without content the result is one transparent pixel.
    """
    if mode not in MODES or pot not in POT:
        raise ValueError(f"{mode}, {pot}")
    dims = images_of(px)
    if mode == "roi":
        b = dims.select("image_id", "width", "height", *[F.lit(v).alias(n) for v, n in zip(roi or (0, 0, 0, 0), ("min_x", "min_y", "max_x", "max_y"), strict=True)])
        none = F.lit("ROI mancante o vuota")
    else:
        b = dims.join(opaque_box(px, alpha), "image_id")
        none = F.lit(f"nessun pixel α ≥ {alpha}")
    pad = padding if mode == "trim_padded" and padding > 0 else 0
    empty = (F.col("max_x") <= F.col("min_x")) | (F.col("max_y") <= F.col("min_y"))
    boxed = scalar.clamp_box(scalar.box(F.col("min_x") - pad, F.col("min_y") - pad, F.col("max_x") + pad, F.col("max_y") + pad), F.col("width"), F.col("height"))
    b = b.select("image_id", empty.alias("e"), boxed.alias("b"))
    gone = F.col("e") | scalar.is_empty(F.col("b"))
    w, h = scalar.width(F.col("b")), scalar.height(F.col("b"))
    side = scalar.next_pow2(F.greatest(w, h))
    fw, fh = {"none": (w, h), "axis": (scalar.next_pow2(w), scalar.next_pow2(h)), "square": (side, side)}[pot]
    applied = ~gone & ((fw != w) | (fh != h))
    head = {"trim": f"trim α≥{alpha}", "roi": "ROI utente", "trim_padded": f"trim α≥{alpha} +pad {padding}px"}[mode]
    times = lambda p, q: F.concat(p.cast("string"), F.lit("×"), q.cast("string"))
    note = F.concat_ws(" · ", F.lit(head), F.concat(F.lit("box "), times(w, h)), F.when(applied, F.concat(F.lit("POT square→" if pot == "square" else "POT axis→"), times(fw, fh))))
    reason = F.when(F.col("e"), none).otherwise(F.lit("box di lavoro vuoto dopo clamp"))
    pick = lambda n, v: F.when(gone, F.lit(v)).otherwise(F.col("b")[n]).cast("int").alias(n)
    return b.select(
        "image_id", pick("min_x", 0), pick("min_y", 0), pick("max_x", 1), pick("max_y", 1),
        F.when(gone, 1).otherwise(fw).cast("int").alias("final_w"), F.when(gone, 1).otherwise(fh).cast("int").alias("final_h"),
        applied.alias("pot_applied"), F.when(gone, F.concat(F.lit("crop no-op ("), reason, F.lit(") → 1×1 trasparente"))).otherwise(note).alias("description"), gone.alias("no_op"),
    )


def crop_pipeline(px: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(pixels, report)."""
    report = crop_boxes(px, **how)
    cut = crop(px, report.where(~F.col("no_op")))
    return fill(report.select("image_id", F.col("final_w").alias("width"), F.col("final_h").alias("height")), cut), report


def pad(px: DataFrame, left: int = 0, top: int = 0, right: int = 0, bottom: int = 0) -> DataFrame:
    """Transparent margins; negative ones count as none."""
    left, top, right, bottom = (max(0, v) for v in (left, top, right, bottom))
    sizes = images_of(px).select("image_id", (F.col("width") + left + right).alias("width"), (F.col("height") + top + bottom).alias("height"))
    return fill(sizes, px.withColumns({"x": F.col("x") + left, "y": F.col("y") + top}))


def pad_to_multiple(px: DataFrame, multiple: int) -> DataFrame:
    if multiple < 2:
        return px
    up = lambda c: scalar.ceil_to_multiple(F.col(c), multiple).alias(c)
    return fill(images_of(px).select("image_id", up("width"), up("height")), px)


def mirror(px: DataFrame, vertical: bool = False, from_start: bool = True) -> DataFrame:
    """Copy one half onto the other, mirrored; the middle of an odd side stays.  Rows are made twice instead of joined."""
    c = "y" if vertical else "x"
    n = F.max(c).over(Window.partitionBy("image_id")) + 1
    d = px.withColumn("__n", n)
    half = scalar.idiv(F.col("__n"), 2)
    source = F.col(c) < half if from_start else F.col(c) >= F.col("__n") - half
    middle = (F.col(c) >= half) & (F.col(c) < F.col("__n") - half)
    d = d.where(source | middle)
    to = F.when(middle, F.array(F.col(c))).otherwise(F.array(F.col(c), F.col("__n") - 1 - F.col(c)))
    return d.withColumn("__to", F.explode(to)).select(*[F.col("__to").cast("int").alias(c) if k == c else F.col(k) for k in px.columns])


#: Ordered dither of 4x4, in sixteenths (fixed values).
BAYER = (
    (0, 8, 2, 10),
    (12, 4, 14, 6),
    (3, 11, 1, 9),
    (15, 7, 13, 5),
)


def seamless(px: DataFrame, radius: int = 6) -> DataFrame:
    """A tile without seams: the image shifted by half, with the original over the seams by ordered dither.  Images under 4 pixels stay."""
    radius = max(1, radius)
    w = Window.partitionBy("image_id")
    d = px.withColumns({"__w": F.max("x").over(w) + 1, "__h": F.max("y").over(w) + 1})
    sx, sy = scalar.idiv(F.col("__w"), 2), scalar.idiv(F.col("__h"), 2)
    one = F.lit(1.0).cast("float")
    weight = lambda c, s: F.greatest(F.lit(0.0).cast("float"), one - (F.abs(F.col(c) - s) / F.lit(float(radius))).cast("float"))
    bayer = F.array(*[F.lit(v / 16.0).cast("float") for row in BAYER for v in row])
    patch = F.greatest(weight("x", sx), weight("y", sy)) > F.get(bayer, F.col("y").bitwiseAND(3) * 4 + F.col("x").bitwiseAND(3))
    small = (F.col("__w") < 4) | (F.col("__h") < 4)
    d = d.withColumns({"__p": small | patch, "__bx": (F.col("x") + sx) % F.col("__w"), "__by": (F.col("y") + sy) % F.col("__h")})
    base = px.select("image_id", F.col("x").alias("__bx"), F.col("y").alias("__by"), *[F.col(c).alias(f"__{c}") for c in "rgba"])
    return d.join(base, ["image_id", "__bx", "__by"]).select("image_id", "x", "y", *[F.when(F.col("__p"), F.col(c)).otherwise(F.col(f"__{c}")).cast("int").alias(c) for c in "rgba"])


def valid_grid(n: Column, cell: int, spacing: int, offset: int) -> Column:
    """struct<start, count, size> along one side."""
    cell = max(1, cell)
    start = F.least(F.greatest(F.lit(offset), F.lit(0)), F.greatest(n - 1, F.lit(0)))
    count = scalar.idiv(n - start + max(0, spacing), cell + max(0, spacing))
    return F.struct(start.cast("int").alias("start"), count.alias("count"), (count * cell + F.greatest(count - 1, F.lit(0)) * max(0, spacing)).cast("int").alias("size"))


def crop_to_grid(px: DataFrame, cell_w: int, cell_h: int, sx: int = 0, sy: int = 0, ox: int = 0, oy: int = 0) -> DataFrame:
    """Cut off what makes no whole cell; without a whole cell the image stays."""
    d = images_of(px).withColumns({"gx": valid_grid(F.col("width"), cell_w, sx, ox), "gy": valid_grid(F.col("height"), cell_h, sy, oy)})
    some = (F.col("gx.count") >= 1) & (F.col("gy.count") >= 1)
    b = d.select("image_id", F.when(some, F.col("gx.start")).otherwise(0).alias("min_x"), F.when(some, F.col("gy.start")).otherwise(0).alias("min_y"), F.when(some, F.col("gx.start") + F.col("gx.size")).otherwise(F.col("width")).alias("max_x"), F.when(some, F.col("gy.start") + F.col("gy.size")).otherwise(F.col("height")).alias("max_y"))
    return crop(px, b)


def tile_preview(px: DataFrame) -> DataFrame:
    """Nine copies, three by three."""
    w = Window.partitionBy("image_id")
    d = px.withColumns({"__w": F.max("x").over(w) + 1, "__h": F.max("y").over(w) + 1})
    d = d.withColumn("__i", F.explode(F.array(*map(F.lit, range(3))))).withColumn("__j", F.explode(F.array(*map(F.lit, range(3)))))
    return d.select("image_id", (F.col("x") + F.col("__i") * F.col("__w")).cast("int").alias("x"), (F.col("y") + F.col("__j") * F.col("__h")).cast("int").alias("y"), *"rgba")
