"""Sums over all earlier rows of a group, where one group may be most of a table.

A window holds a group in one task.  Groups of more rows than ``RUN`` are cut into
ranges of their order first: sums go up from rows to ranges, along the ranges of
each group, and back to the rows as one head row a range, which leads the range's
window.  So nothing is joined on a hot group, and no task sees all its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.shared import fresh_dir

#: Rows of a group that one task takes.
RUN = 1 << 20
#: Ranges that a group is cut into at most; beyond that ranges grow.
RANGES = 4096


def _ranged(d: DataFrame, by: str, order: str, run: int) -> DataFrame | None:
    """``d`` with ``__range``, which rises with ``order``, or none where all groups are small.

    Bounds are quantiles by sketch.  They decide only how even ranges are; they are
    written once, as a second reckoning of a sketch may differ.
    """
    large = d.groupBy(by).agg(F.count("*").alias("__n")).where(F.col("__n") > run)
    most = large.agg(F.max("__n")).first()[0]
    if most is None:
        return None
    k = min(RANGES, -(-most // run))
    path = fresh_dir(d.sparkSession, "bounds")
    key = F.struct(F.col(by)).alias("__g")  # a struct is never null, what it holds may be
    named = large.select(F.struct(by).alias("__g"))
    q = d.select(key, F.col(order)).join(named, "__g", "left_semi")
    q = q.groupBy("__g").agg(F.array_distinct(F.percentile_approx(order, [i / k for i in range(1, k)] or [0.5], 10 * k)).alias("__bounds"))
    q.write.parquet(path)
    out = d.withColumn("__g", key).join(d.sparkSession.read.parquet(path), "__g", "left").withColumn("__range", F.lit(0))
    size = F.coalesce(F.size("__bounds"), F.lit(0))
    step = 1 << (RANGES.bit_length() - 1)
    while step:  # how many bounds lie below, by halving
        there = F.col("__range") + step
        out = out.withColumn("__range", F.when((there <= size) & (F.get("__bounds", there - 1) < F.col(order)), there).otherwise(F.col("__range")))
        step >>= 1
    return out.drop("__g", "__bounds")


def before(d: DataFrame, by: str, order: list[str], sums: list[str], tops: list[str], run: int | None = None) -> DataFrame:
    """``d`` with, of its group in the given order, ``__before_n`` and ``__before_<c>`` (rows and sums before the row),
    ``__all_<c>`` (sums) and ``__max_<c>``.

    Rows alike in all of ``order`` follow in any order.  Null sums count nothing;
    nulls of ``order`` come first; a null group is a group.
    """
    cut = _ranged(d, by, order[0], RUN if run is None else run)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    if cut is None:
        whole, w = Window.partitionBy(by), Window.partitionBy(by).orderBy(*order)
        so_far = w.rowsBetween(Window.unboundedPreceding, -1)
        return d.select(
            "*", (F.row_number().over(w) - 1).cast("long").alias("__before_n"), *[zero(F.sum(c).over(so_far)).alias(f"__before_{c}") for c in sums],
            *[zero(F.sum(c).over(whole)).alias(f"__all_{c}") for c in sums], *[F.max(c).over(whole).alias(f"__max_{c}") for c in tops],
        )
    ranges = cut.groupBy(by, "__range").agg(F.count("*").alias("__n"), *[zero(F.sum(c)).alias(f"__s_{c}") for c in sums], *[F.max(c).alias(f"__t_{c}") for c in tops])
    whole, earlier = Window.partitionBy(by), Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    head = F.struct(
        zero(F.sum("__n").over(earlier)).alias("n"), *[zero(F.sum(f"__s_{c}").over(earlier)).alias(f"b_{c}") for c in sums],
        *[F.sum(f"__s_{c}").over(whole).alias(f"a_{c}") for c in sums], *[F.max(f"__t_{c}").over(whole).alias(f"m_{c}") for c in tops],
    )
    heads = ranges.select(by, "__range", F.lit(False).alias("__row"), head.alias("__head"))
    both = heads.unionByName(cut.withColumn("__row", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(by, "__range").orderBy("__row", *order)
    so_far, h = w.rowsBetween(Window.unboundedPreceding, -1), F.first("__head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"__h": h, "__k": F.row_number().over(w), **{f"__p_{c}": zero(F.sum(c).over(so_far)) for c in sums}}).where("__row")
    return both.select(
        *d.columns, (F.col("__h.n") + F.col("__k") - 2).cast("long").alias("__before_n"), *[(F.col(f"__h.b_{c}") + F.col(f"__p_{c}")).alias(f"__before_{c}") for c in sums],
        *[F.col(f"__h.a_{c}").alias(f"__all_{c}") for c in sums], *[F.col(f"__h.m_{c}").alias(f"__max_{c}") for c in tops],
    )
