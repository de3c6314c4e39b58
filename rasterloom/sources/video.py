"""Video metadata and frame choice.  Decoding itself is left to the tool that made the frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROBE = "struct<format:struct<duration:string>,streams:array<struct<codec_type:string,width:int,height:int,r_frame_rate:string>>>"


def metadata(probe: Column) -> Column:
    """struct<duration, fps, width, height> of a probe's JSON; null where anything is missing or wrong."""
    p = F.from_json(probe, PROBE)
    v = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    rate = F.split(v["r_frame_rate"], "/")
    den = F.coalesce(F.get(rate, F.lit(1)).try_cast("double"), F.lit(1.0))
    fps = F.when(den != 0, F.get(rate, F.lit(0)).try_cast("double") / den)
    seconds = p["format"]["duration"].try_cast("double")
    ok = seconds.isNotNull() & fps.isNotNull() & v["width"].isNotNull() & v["height"].isNotNull()
    return F.when(ok, F.struct(seconds.alias("duration"), fps.alias("fps"), v["width"].alias("width"), v["height"].alias("height")))


def every_nth(frames: DataFrame, n: float, start: float | None = None, end: float | None = None) -> DataFrame:
    """Frames (n, t) whose number a step divides, between two times in seconds."""
    return between(frames, start, end).where(F.pmod("n", F.lit(max(1, round(n)))) == 0)


def between(frames: DataFrame, start: float | None, end: float | None) -> DataFrame:
    d = frames if start is None else frames.where(F.col("t") >= start)
    return d if end is None else d.where(F.col("t") <= end)


def at_rate(frames: DataFrame, fps: float, start: float | None = None, end: float | None = None, video: str = "video_id") -> DataFrame:
    """The first frame of each interval of 1/fps seconds."""
    d = between(frames, start, end).withColumn("slot", F.floor(F.col("t") * fps).cast("long"))
    first = F.row_number().over(Window.partitionBy(video, "slot").orderBy("t", "n"))
    return d.withColumn("__k", first).where("__k = 1").drop("__k")


def estimate(duration: Column, start: Column, end: Column, fps: Column, n: float | None = None) -> Column:
    """How many frames a choice gives: at a rate, or every n-th of the source's."""
    span = F.greatest(F.lit(0.0), F.least(end, duration) - start)
    return F.ceil(span * fps / max(1, round(n)) if n is not None else span * fps).cast("int")
