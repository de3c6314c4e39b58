"""Every query of the library, with SQL that another engine can run on the same tables.

Queries are named ``rNNN_<operator>``; their rasters come from
``rasterloom.sources.rasters``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom import queries_a, queries_b
from rasterloom.plans import pipelines
from rasterloom.sources import rasters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**queries_a.QUERIES, **queries_b.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**queries_a.SQL, **queries_b.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggressive pipeline without its snap, and its report."""
    o = pipelines.Options(tolerance=18, background=(0, 80, 100), quantize=False, majority=True, island_area=3, alpha=144)
    return pipelines.run(rasters.px_events(spark, sf_dir), o).report()
