"""Operators on 3x3 neighbourhoods.

The neighbours of every pixel come from two window passes: along rows, then
along columns of what the rows gathered.  Both use one shuffle.  Images go to
tasks whole (``together``), or by square tiles: a tile carries a rim of its
neighbours' pixels, which are dropped again, so that an image of any size is
spread over tasks and only pixels at the tiles' edges are multiplied.  Neighbours
outside the image are null.  All operators read the pixels as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import color
from rasterloom.schema import cleared, packed, recolour

#: Places of the neighbours in ``nb``, row by row.
OFFSETS = ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1))
FOUR = (1, 3, 4, 6)


#: Side of a tile.
TILE = 1024


def dealt(px: DataFrame, together: bool = True, tile: int = TILE, rim: int = 1) -> tuple[DataFrame, Window, Window, Column]:
    """``px`` dealt to tasks, the windows along its rows and its columns, and what tells a tile's own pixels from its rim."""
    if together:
        unit, d, own = ["image_id"], px.repartition("image_id"), F.lit(True)
    else:
        at = lambda c: F.call_function("div", c, F.lit(tile)).cast("int")
        reached = lambda c: F.explode(F.sequence(at(F.greatest(F.col(c) - rim, F.lit(0))), at(F.col(c) + rim)))
        unit = ["image_id", "__tx", "__ty"]
        d = px.withColumn("__tx", reached("x")).withColumn("__ty", reached("y")).repartition(*unit)
        own = (F.col("__tx") == at(F.col("x"))) & (F.col("__ty") == at(F.col("y")))
    return d, Window.partitionBy(*unit, "y").orderBy("x"), Window.partitionBy(*unit, "x").orderBy("y"), own


def neighbours(px: DataFrame, value: Column | None = None, together: bool = True, name: str = "nb", tile: int = TILE) -> DataFrame:
    """``px`` with an array of the eight neighbours' values (their r, g, b, a by default)."""
    v = value if value is not None else F.struct("r", "g", "b", "a")
    d, rows, cols, own = dealt(px, together, tile)
    d = d.withColumn("__v", v)
    d = d.withColumn("__h", F.struct(F.lag("__v").over(rows).alias("l"), F.col("__v").alias("c"), F.lead("__v").over(rows).alias("r")))
    d = d.withColumn("__u", F.lag("__h").over(cols)).withColumn("__d", F.lead("__h").over(cols)).where(own)
    nb = F.array("__u.l", "__u.c", "__u.r", "__h.l", "__h.r", "__d.l", "__d.c", "__d.r")
    return d.withColumn(name, nb).drop("__v", "__h", "__u", "__d", "__tx", "__ty")


def _done(df: DataFrame, px: DataFrame) -> DataFrame:
    return df.select(*px.columns)


def there(cond):
    """A condition on neighbours that are in the image."""
    return lambda n: n.isNotNull() & cond(n)


def defringe(px: DataFrame, opaque: int = 250, **how) -> DataFrame:
    """Half transparent pixels take the mean colour, cut to integers, of their opaque neighbours."""
    d = neighbours(px, **how)
    d = d.withColumn("__o", F.filter("nb", there(lambda n: n["a"] >= opaque)))
    fits = (F.col("a") > 0) & (F.col("a") < opaque) & (F.size("__o") > 0)
    for one, other in ((1, 6), (3, 4)):  # images of one row or one column stay
        fits = fits & (F.col("nb")[one].isNotNull() | F.col("nb")[other].isNotNull())
    mean = lambda c: F.call_function("div", F.aggregate("__o", F.lit(0), lambda s, n: s + n[c]), F.size("__o"))
    return _done(recolour(d, fits, **{c: mean(c) for c in "rgb"}), px)


def remove_outliers(px: DataFrame, tolerance: float = 20, **how) -> DataFrame:
    """Remove pixels whose colour no neighbour shares, within the tolerance around their own."""
    kinds = px.select("r", "g", "b").distinct()  # a colour is worked out once, however many pixels have it
    kinds = kinds.withColumns({"__lab": color.oklab(F.col("r"), F.col("g"), F.col("b")), "__tol": color.calibrated_column(F.col("r"), F.col("g"), F.col("b"), tolerance)})
    d = neighbours(px.join(kinds, ["r", "g", "b"]), F.struct(F.col("__lab").alias("lab"), F.col("a").alias("a")), **how)
    alike = F.exists("nb", lambda n: F.coalesce(n.isNotNull() & (n["a"] != 0) & (color.lab_distance_sq(F.col("__lab"), n["lab"]) <= F.col("__tol")), F.lit(False)))
    return _done(cleared(d, (F.col("a") != 0) & ~alike), px)


def median(px: DataFrame, together: bool = True, tile: int = TILE) -> DataFrame:
    """3x3 median of each channel; beyond the edge its pixels repeat; images under 3x3 stay."""
    d, rows, cols, own = dealt(px, together, tile, rim=2)
    d = d.withColumn("__c", F.struct("r", "g", "b", "a"))
    # of three in a line one has a neighbour on each side, and the others have two on one side
    three = lambda c, w: (F.lag(c).over(w).isNotNull() & F.lead(c).over(w).isNotNull()) | F.lag(c, 2).over(w).isNotNull() | F.lead(c, 2).over(w).isNotNull()
    d = d.withColumns({"__row": F.array(F.coalesce(F.lag("__c").over(rows), "__c"), "__c", F.coalesce(F.lead("__c").over(rows), "__c")), "__wide": three("__c", rows)})
    d = d.withColumns({"__n": F.concat(F.coalesce(F.lag("__row").over(cols), "__row"), "__row", F.coalesce(F.lead("__row").over(cols), "__row")), "__tall": three("__c", cols)}).where(own)
    mid = lambda c: F.array_sort(F.transform("__n", lambda p: p[c]))[4]
    return _done(recolour(d, F.col("__wide") & F.col("__tall"), **{c: mid(c) for c in "rgba"}), px)


def most_frequent(values: Column) -> Column:
    """The commonest of an array of comparable values; of equally common ones the first."""
    counted = F.transform(values, lambda v, i: F.struct(F.size(F.filter(values, lambda o: o == v)).alias("n"), (-i).alias("i"), v.alias("v")))
    return F.array_max(counted)["v"]


def majority_denoise(px: DataFrame, least: int = 2, **how) -> DataFrame:
    """Interior pixels with fewer than ``least`` equal neighbours take the commonest neighbour colour."""
    d = neighbours(px, **how)
    whole = F.forall("nb", lambda n: n.isNotNull())
    own = F.struct("r", "g", "b", "a")
    same = F.size(F.filter("nb", lambda n: n == own))
    # order by count and place alone: the place is unique, so the colour never decides
    d = d.withColumn("__m", F.when(whole & (same < least), most_frequent(F.col("nb"))))
    return _done(recolour(d, F.col("__m").isNotNull(), **{c: F.col("__m")[c] for c in "rgba"}), px)


def erode(px: DataFrame, times: int = 1, **how) -> DataFrame:
    """Remove pixels that touch a transparent one; outside the image nothing is transparent."""
    for _ in range(max(1, times)):
        d = neighbours(px, F.col("a"), **how)
        px = _done(cleared(d, (F.col("a") != 0) & F.exists("nb", lambda n: F.coalesce(n == 0, F.lit(False)))), px)
    return px


def dilate(px: DataFrame, times: int = 1, **how) -> DataFrame:
    """Transparent pixels beside others take their commonest colour, opaque."""
    for _ in range(max(1, times)):
        d = neighbours(px, **how)
        d = d.withColumn("__s", F.transform(F.filter("nb", there(lambda n: n["a"] != 0)), lambda n: F.struct(n["r"].alias("r"), n["g"].alias("g"), n["b"].alias("b"))))
        d = d.withColumn("__m", F.when((F.col("a") == 0) & (F.size("__s") > 0), most_frequent(F.col("__s"))))
        px = _done(recolour(d, F.col("__m").isNotNull(), r=F.col("__m")["r"], g=F.col("__m")["g"], b=F.col("__m")["b"], a=255), px)
    return px


def opened(px: DataFrame, times: int = 1, **how) -> DataFrame:
    return dilate(erode(px, times, **how), times, **how)


def closed(px: DataFrame, times: int = 1, **how) -> DataFrame:
    return erode(dilate(px, times, **how), times, **how)


def outline(px: DataFrame, rgba: tuple[int, int, int, int] = (0, 0, 0, 255), eight: bool = False, **how) -> DataFrame:
    """One ring around what isn't transparent."""
    d = neighbours(px, F.col("a"), **how)
    nb = F.col("nb") if eight else F.array(*[F.col("nb")[k] for k in FOUR])
    touches = F.exists(nb, lambda n: F.coalesce(n > 0, F.lit(False)))
    return _done(recolour(d, (F.col("a") == 0) & touches, **dict(zip("rgba", rgba, strict=True))), px)


def sobel_edges(px: DataFrame, threshold: float, **how) -> DataFrame:
    """``px`` with a boolean ``edge``: interior, not transparent, FLOAT gradient of luma at the threshold or over it."""
    t = min(4096.0, max(0.0, threshold))
    if t <= 0:
        return px.withColumn("edge", F.lit(False))
    light = F.when(F.col("a") == 0, F.lit(0.0)).otherwise(color.luma(F.col("r"), F.col("g"), F.col("b"))).cast("float")
    d = neighbours(px, light, **how)
    n = [F.col("nb")[k] for k in range(8)]
    two = F.lit(2.0).cast("float")
    gx = -n[0] + n[2] - two * n[3] + two * n[4] - n[5] + n[7]
    gy = n[0] + two * n[1] + n[2] - n[5] - two * n[6] - n[7]
    strong = gx * gx + gy * gy >= F.lit(t * t).cast("float")
    edge = F.coalesce(F.forall("nb", lambda v: v.isNotNull()) & (F.col("a") != 0) & strong, F.lit(False))
    return d.withColumn("edge", edge).select(*px.columns, "edge")


def modal_neighbours(px: DataFrame) -> DataFrame:
    """(image_id, x, y, rgb, n): the commonest neighbour colour by an equi-join on shifted places.

    The other way to neighbourhoods: eight rows a pixel, no order needed, and
    counts that are summed before the shuffle.
    """
    off = F.array(*[F.struct(F.lit(-dx).alias("dx"), F.lit(-dy).alias("dy"), F.lit(i).alias("i")) for i, (dx, dy) in enumerate(OFFSETS)])
    to = px.where("a != 0").select("image_id", "x", "y", packed().alias("rgb"), F.explode(off).alias("o"))
    to = to.select("image_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "rgb", "o.i")
    n = to.groupBy("image_id", "x", "y", "rgb").agg(F.count("*").alias("n"), F.min("i").alias("i"))
    best = n.groupBy("image_id", "x", "y").agg(F.max_by(F.struct("rgb", "n"), F.struct("n", -F.col("i"))).alias("m"))
    return px.select("image_id", "x", "y").join(best, ["image_id", "x", "y"]).select("image_id", "x", "y", "m.rgb", "m.n")
