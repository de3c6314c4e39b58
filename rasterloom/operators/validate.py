"""Checks on images: one aggregate each, issues in a fixed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalar import is_pow2
from rasterloom.operators.aggregate import mismatch_counts
from rasterloom.schema import packed


@dataclass(frozen=True)
class Rules:
    max_colours: int | None = None
    power_of_two: bool = False
    binary_alpha: bool = False
    ignore_transparent: bool = True
    background: tuple[int, int, int] | None = None
    background_tolerance: float = 0
    max_mismatch: float | None = None


def validate(px: DataFrame, rules: Rules) -> DataFrame:
    """(image_id, unique, valid, issues array<string>, severities array<string>)."""
    colour = F.when((F.col("a") != 0) | F.lit(not rules.ignore_transparent), packed(a="a"))
    off, seen = mismatch_counts(rules.background or (0, 0, 0), max(0.0, rules.background_tolerance))
    d = px.groupBy("image_id").agg(
        F.count_distinct(colour).cast("int").alias("unique"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"),
        F.max((~F.col("a").isin(0, 255)).cast("int")).alias("soft"), off.alias("off"), seen.alias("seen"),
    )
    ratio = F.when(F.col("seen") == 0, 0.0).otherwise(F.col("off") / F.col("seen"))
    checks = [
        (rules.max_colours is not None, F.col("unique") > (rules.max_colours or 0), "MAX_UNIQUE_COLORS", "Warning"),
        (rules.power_of_two, ~is_pow2(F.col("w")), "WIDTH_NOT_POW2", "Warning"),
        (rules.power_of_two, ~is_pow2(F.col("h")), "HEIGHT_NOT_POW2", "Warning"),
        (rules.binary_alpha, F.col("soft") == 1, "ALPHA_NOT_BINARY", "Error"),
        (rules.background is not None and rules.max_mismatch is not None, ratio > (rules.max_mismatch or 0.0), "BACKGROUND_MISMATCH", "Warning"),
    ]
    found = [F.when(c, F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"))) for on, c, code, level in checks if on]
    issues = F.filter(F.array(*found), lambda i: i.isNotNull()) if found else F.array().cast("array<struct<code:string,level:string>>")
    d = d.withColumn("i", issues)
    return d.select("image_id", "unique", (F.size("i") == 0).alias("valid"), F.transform("i", lambda i: i["code"]).alias("issues"), F.transform("i", lambda i: i["level"]).alias("severities"))
