"""Rasters, boxes and ticks read out of ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.schema import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16x16 images of 256 events each, by their ids; places without an event, as at the end of the last image, are transparent."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    ids = events.agg(F.count("event_id").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    n = (ids["hi"] // 256 + 1) * 256 if ids["n"] else 0
    if ids["n"] and ids["lo"] == 0 and ids["n"] == ids["hi"] + 1:  # dense: only the end is missing
        gaps = spark.range(ids["hi"] + 1, n, 1, 1).withColumnRenamed("id", "event_id")
    else:
        gaps = spark.range(n).withColumnRenamed("id", "event_id").join(events, "event_id", "left_anti")
    d = events.selectExpr(
        "cast(event_id div 256 as bigint) image_id", "cast(event_id % 16 as int) x", "cast((event_id div 16) % 16 as int) y",
        "cast((user_id % 4) * 64 as int) r", "cast((k % 4) * 80 as int) g", "cast(user_id % 3 * 100 as int) b",
        "case event_type when 'error' then 0 when 'signup' then 96 when 'click' then 128 else 255 end a",
    )
    return d.unionByName(gaps.selectExpr("cast(event_id div 256 as bigint) image_id", "cast(event_id % 16 as int) x", "cast((event_id div 16) % 16 as int) y", "0 r", "0 g", "0 b", "0 a")) if n else d


def px_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 images of grey levels, one a vector of 64; vectors are dealt by image, so that steps by image don't shuffle their pixels."""
    rows = spread(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("image_id"), "embedding"))
    d = rows.select("image_id", F.posexplode("embedding").alias("pos", "v"))
    d = d.withColumn("l", F.least(F.greatest(F.floor(F.col("v").cast("double") * 256) + 128, F.lit(0)), F.lit(255)).cast("int"))
    return d.selectExpr(
        "image_id", "cast(pos % 8 as int) x", "cast(pos div 8 as int) y", "l r", "255 - l g", "cast(pos * 37 % 256 as int) b",
        "case when v < -0.15 then 0 when v < 0 then 128 else 255 end a",
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sheet, ord, w, h): an order a box, on fifty sheets."""
    return table(spark, sf_dir, "orders").selectExpr("cast(o_custkey % 50 as int) sheet", "cast(o_orderkey as bigint) ord", "cast(1 + o_orderkey % 31 as int) w", "cast(1 + (o_orderkey div 7) % 23 as int) h")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body_id, ord, dt, input_x, input_y, clip): a user a body, an event a tick."""
    return table(spark, sf_dir, "events").selectExpr(
        "cast(user_id as bigint) body_id", "cast(event_id as bigint) ord", "cast((event_id % 4) as double) / 16 dt",
        "case event_type when 'click' then 1.0D when 'view' then -1.0D else 0.0D end input_x", "case event_type when 'signup' then 1.0D when 'error' then -1.0D else 0.0D end input_y",
        "case when event_id % 7 < 4 then 'Walk' else 'run' end clip",
    )


def cells(images: DataFrame) -> DataFrame:
    """Four overlapping cells an image, by its size: three quarters of each side, from each corner."""
    w, h = F.col("width"), F.col("height")
    q = lambda n: F.call_function("div", n * 3, F.lit(4)).cast("int")
    c = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), (w - q(w) if i % 2 else F.lit(0)).alias("min_x"), (h - q(h) if i > 1 else F.lit(0)).alias("min_y")) for i in range(4)]))
    d = images.select("image_id", "width", "height", c.alias("c"))
    return d.select("image_id", "c.ord", F.concat(F.lit("k"), "c.ord").alias("id"), "c.min_x", "c.min_y", (F.col("c.min_x") + q(w)).alias("max_x"), (F.col("c.min_y") + q(h)).alias("max_y"), F.lit(0.5).alias("pivot_x"), F.lit(0.5).alias("pivot_y"))
