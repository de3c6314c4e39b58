"""One row an image (or cell): boxes, counts, dominant colours, size statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import color, scalar
from rasterloom.schema import packed

RGB = tuple[int, int, int]


def opaque_box(px: DataFrame, alpha: int = 1) -> DataFrame:
    """(image_id, min_x, min_y, max_x, max_y): half-open, of alpha at least ``alpha``; zeros for none.  One pass, pre-aggregated."""
    seen = F.col("a") >= alpha
    of = lambda f, c, more=0: F.coalesce(f(F.when(seen, F.col(c))) + more, F.lit(0)).cast("int")
    return px.groupBy("image_id").agg(of(F.min, "x").alias("min_x"), of(F.min, "y").alias("min_y"), of(F.max, "x", 1).alias("max_x"), of(F.max, "y", 1).alias("max_y"))


def unique_colours(px: DataFrame, ignore_transparent: bool = True) -> DataFrame:
    c = F.when((F.col("a") != 0) | F.lit(not ignore_transparent), packed(a="a"))
    return px.groupBy("image_id").agg(F.count_distinct(c).alias("n"))


def semi_transparent(px: DataFrame, opaque: int) -> DataFrame:
    return px.groupBy("image_id").agg(F.count_if((F.col("a") > 0) & (F.col("a") < opaque)).alias("n"))


def mismatch_counts(background: RGB, tolerance: float) -> tuple[Column, Column]:
    """(pixels off the background, pixels that aren't transparent)."""
    off = color.rgb_distance_sq((F.col("r"), F.col("g"), F.col("b")), background) > tolerance * tolerance
    return F.count_if((F.col("a") != 0) & off), F.count_if(F.col("a") != 0)


def background_mismatch(px: DataFrame, background: RGB, tolerance: float = 0) -> DataFrame:
    off, seen = mismatch_counts(background, tolerance)
    return px.groupBy("image_id").agg(off.alias("off"), seen.alias("seen")).select("image_id", "off", "seen", F.when(F.col("seen") == 0, 0.0).otherwise(F.col("off") / F.col("seen")).alias("ratio"))


def sample_colour(px: DataFrame, cx: int, cy: int, radius: int = 2) -> DataFrame:
    """(image_id, r, g, b, a): commonest colour, opaque, of alpha 128 or more around a place; the first of equals; the pixel itself if there is none."""
    near = px.where(F.col("x").between(cx - radius, cx + radius) & F.col("y").between(cy - radius, cy + radius) & (F.col("a") >= 128))
    n = near.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"), F.min(F.struct("y", "x")).alias("first"))
    best = n.groupBy("image_id").agg(F.min_by(F.struct("r", "g", "b"), F.struct(-F.col("n"), "first")).alias("m"))
    dims = px.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    at = dims.select("image_id", F.least(F.greatest(F.lit(cx), F.lit(0)), "mx").alias("x"), F.least(F.greatest(F.lit(cy), F.lit(0)), "my").alias("y"))
    own = px.join(at, ["image_id", "x", "y"]).join(best, "image_id", "left")
    return own.select("image_id", *[F.coalesce(F.col("m")[c], c).alias(c) for c in "rgb"], F.when(F.col("m").isNotNull(), 255).otherwise(F.col("a")).alias("a"))


def snap_key(px: DataFrame, key: RGB, most: float = 32, depth: int = 3) -> DataFrame:
    """(image_id, r, g, b): the colour near the border closest to the key, if it is close enough, else the key.

    Equally close ones are decided by the scan: ring by ring, along top and
    bottom in turn, then along left and right in turn.
    """
    dims = px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    d = px.join(dims, "image_id")
    right, low = F.col("w") - 1 - F.col("x"), F.col("h") - 1 - F.col("y")
    ring = F.least("x", "y", right, low)
    deep = F.greatest(F.lit(1), F.least(F.lit(depth), scalar.idiv(F.col("w"), 2), scalar.idiv(F.col("h"), 2)))
    level = (F.col("y") == ring) | (low == ring)
    scan = F.struct(ring, F.when(level, 0).otherwise(1), F.when(level, F.col("x")).otherwise(F.col("y")), F.when(level, (F.col("y") != ring).cast("int")).otherwise((F.col("x") != ring).cast("int")))
    dist = color.rgb_distance_sq((F.col("r"), F.col("g"), F.col("b")), key)
    rim = d.where(ring < deep).groupBy("image_id").agg(F.min(F.when(F.col("a") != 0, F.struct(dist.alias("d"), scan.alias("s"), "r", "g", "b"))).alias("m"))
    ok = F.coalesce((F.col("m.d") <= 3 * most * most) & F.lit(most >= 0), F.lit(False))
    return rim.select("image_id", *[F.when(ok, F.col(f"m.{c}")).otherwise(k).cast("int").alias(c) for c, k in zip("rgb", key, strict=True)])


def bottom_row(px: DataFrame, alpha: int = 1) -> DataFrame:
    """(image_id, y): the lowest row with alpha above ``alpha``, or -1."""
    return px.groupBy("image_id").agg(F.coalesce(F.max(F.when(F.col("a") > alpha, F.col("y"))), F.lit(-1)).alias("y"))


def size_statistics(boxes: DataFrame, *by: str) -> DataFrame:
    """Over widths ``w`` and heights ``h``: largest, upper median, 90th percentile, how many exceed twice the median.

    Ranks come from counts of distinct sizes, so a group of any size is summed
    before it is ordered.
    """
    if not by:
        return size_statistics(boxes.withColumn("__all", F.lit(0)), "__all").drop("__all")
    out = None
    for c in ("w", "h"):
        n = boxes.groupBy(*by, F.col(c).alias("v")).agg(F.count("*").alias("n"))
        g = n.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("s"), F.sum("n").alias("count"))
        nth = lambda k: F.aggregate(
            "s",
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("v")),
            lambda a, x: F.when(a["n"] > k, a).otherwise(F.struct((a["n"] + x["n"]).cast("long").alias("n"), x["v"].cast("int").alias("v"))),
            lambda a: a["v"],
        )
        half = F.call_function("div", F.col("count"), F.lit(2))
        top = F.ceil(F.col("count") * 0.9) - 1
        g = g.withColumns({"med": nth(half), "p90": nth(top)})
        over = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.when(x["v"] > 2 * F.col("med"), x["n"]).otherwise(0))
        u = c
        g = g.select(*by, F.element_at("s", -1)["v"].cast("int").alias(f"max_{u}"), F.col("med").alias(f"median_{u}"), F.col("p90").alias(f"p90_{u}"), over.alias(f"outliers_{u}"), "count")
        out = g if out is None else out.join(g.drop("count"), list(by))
    return out


POLICIES = ("max", "median", "p90")


def select_size(stats: DataFrame, policy: str = "max") -> DataFrame:
    kind = policy if policy in POLICIES else "max"
    return stats.withColumns({"target_w": F.greatest(F.lit(1), f"{kind}_w"), "target_h": F.greatest(F.lit(1), f"{kind}_h")})


def outlier_warning(stats: DataFrame) -> DataFrame:
    """A short note on frames over twice the median, null without any."""
    part = lambda u: F.when(F.col(f"outliers_{u}") > 0, F.concat(F.col(f"outliers_{u}").cast("string"), F.lit(f" outlier {u.upper()} ({u.upper()}>2×mediana)")))
    text = F.concat(F.lit("⚠ Max-policy gonfia la cella: "), F.concat_ws(", ", part("w"), part("h")), F.lit(". Considera Median o Percentile90."))
    return stats.withColumn("warning", F.when((F.col("outliers_w") > 0) | (F.col("outliers_h") > 0), text))
