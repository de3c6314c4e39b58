"""Animation and motion over ticks: in batch as ordered expressions, in streams as keyed state."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TICK = 1.0 / 60.0


# ---- animation -----------------------------------------------------------------


def animate(ticks: DataFrame, clips: DataFrame, fixed_fps: float | None = 8.0, key: str = "body_id") -> DataFrame:
    """Ticks (key, ord, clip, dt) with the frame shown after each.

    Time runs from the last change of the clip's name, of its case too; clips (name, fps, frames) are found
    in any case; a tick of an unknown, empty or still clip shows frame 0.
    """
    order = Window.partitionBy(key).orderBy("ord")
    named = F.col("clip")
    d = ticks.withColumn("__new", F.when(named.eqNullSafe(F.lag(named).over(order)) & F.lag("ord").over(order).isNotNull(), 0).otherwise(1))
    d = d.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    since = Window.partitionBy(key, "__run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    c = clips.select(F.lower("name").alias("__name"), "fps", "frames")
    d = d.withColumn("elapsed", F.sum("dt").over(since)).join(c, F.lower("clip") == F.col("__name"), "left")
    fps = F.lit(fixed_fps) if fixed_fps is not None else F.col("fps")
    n = F.coalesce(F.size("frames"), F.lit(0))
    runs = (n > 0) & (fps > 0)
    i = F.when(runs, F.floor(F.col("elapsed") / (1.0 / fps)).cast("long") % n).otherwise(0).cast("int")
    d = d.withColumn("frame", i)
    return d.select(key, "ord", "clip", "elapsed", "frame", F.when(n > 0, F.get("frames", "frame")).alias("frame_id"))


def loop(t: Column, n: Column) -> Column:
    return F.when(n <= 1, 0).otherwise(F.pmod(t, n)).cast("int")


def ping_pong(t: Column, n: Column) -> Column:
    return F.when(n <= 1, 0).otherwise(n - 1 - F.abs(F.pmod(t, F.greatest(2 * n - 2, F.lit(1))) - (n - 1))).cast("int")


def once(t: Column, n: Column) -> Column:
    return F.when(n <= 1, 0).otherwise(F.least(t, n - 1)).cast("int")


# ---- motion --------------------------------------------------------------------


@dataclass(frozen=True)
class Motion:
    acceleration: float = 1200.0
    friction: float = 0.12
    max_speed: float = 280.0


@dataclass(frozen=True)
class World:
    """Ground and obstacles (half-open boxes); the player is 32 by 48, standing on its place."""

    ground_y: int = 400
    obstacles: tuple[tuple[int, int, int, int], ...] = ()
    player_w: int = 32
    player_h: int = 48


def tick(state: tuple[float, float, float, float], ix: float, iy: float, dt: float, m: Motion, world: World | None = None) -> tuple[float, float, float, float]:
    """One tick as numbers; with a world the body is then pushed out of it.

    The player's box is taken once, before any push; each obstacle pushes along
    the axis of the smaller overlap.
    """
    px, py, vx, vy = state
    if dt > 0:
        if ix or iy:
            size = math.sqrt(ix * ix + iy * iy)
            vx, vy = vx + ix / size * m.acceleration * dt, vy + iy / size * m.acceleration * dt
        else:
            keep = 1.0 - min(0.999999, max(0.0, m.friction))
            vx, vy = vx * keep, vy * keep
        fast = math.sqrt(vx * vx + vy * vy)
        if fast > m.max_speed and fast > 0:
            vx, vy = vx * (m.max_speed / fast), vy * (m.max_speed / fast)
        px, py = px + vx * dt, py + vy * dt
    if world is None:
        return px, py, vx, vy
    left = px - world.player_w / 2.0
    x0, y0, x1, y1 = math.floor(left), math.floor(py - world.player_h), math.floor(left + world.player_w), math.floor(py)
    if y1 > world.ground_y:
        py -= y1 - world.ground_y
    for ox0, oy0, ox1, oy1 in world.obstacles:
        wide, tall = min(x1, ox1) - max(x0, ox0), min(y1, oy1) - max(y0, oy0)
        if wide <= 0 or tall <= 0:
            continue
        if wide < tall:
            px += -wide if px < (ox0 + ox1) / 2.0 else wide
        else:
            py += -tall if py < (oy0 + oy1) / 2.0 else tall
    return px, py, vx, vy


def _folded(ticks: DataFrame, m: Motion, world: World | None, key: str) -> DataFrame:
    """A body's ticks in order of (ord, dt, input_x, input_y), nulls first, folded from rest.

    What a tick does depends on the capped speed before it, so the fold can't be
    split; but nothing of it is held beyond the batch at hand.  Spark sorts (and
    spills), ticks stream through, and four numbers pass from batch to batch, so a
    body may have any number of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, s = None, None  # the body at hand, as a list of one; its state
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0)
            start = [0, *(np.flatnonzero(_changes(keys)) + 1).tolist(), b.num_rows]
            dt, ix, iy = (pc.fill_null(b.column(i), 0.0).to_numpy(zero_copy_only=False).tolist() for i in (1, 2, 3))
            done: list[tuple] = []
            for lo, hi in zip(start, start[1:], strict=False):
                name = keys.slice(lo, 1)
                if body is None or not body.equals(name):
                    if body is not None:
                        done.append((body, s))
                    body, s = name, (0.0, 0.0, 0.0, 0.0)
                for i in range(lo, hi):
                    s = tick(s, ix[i], iy[i], dt[i], m, world)
            yield from _states(done, names)
        if body is not None:
            yield from _states([(body, s)], names)

    kind = ticks.schema[key].dataType.simpleString()
    names = [key, "px", "py", "vx", "vy"]
    columns = [F.col(key).alias(key), *[F.col(c).cast("double").alias(f"__{c}") for c in ("dt", "input_x", "input_y")]]
    d = ticks.select(*columns, F.col("ord").alias("__ord")).repartition(key).sortWithinPartitions(key, "__ord", "__dt", "__input_x", "__input_y")
    return d.select(key, "__dt", "__input_x", "__input_y").mapInArrow(run, f"`{key}` {kind}, px double, py double, vx double, vy double")


def _changes(keys: pa.Array) -> np.ndarray:
    """Where a value differs from the one before, nulls being alike."""
    a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
    return pc.fill_null(pc.not_equal(a, b), pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _states(done: list[tuple], names: list[str]) -> list[pa.RecordBatch]:
    if not done:
        return []
    return [pa.record_batch([pa.concat_arrays([k for k, _ in done]), *[pa.array([s[i] for _, s in done], pa.float64()) for i in range(4)]], names=names)]


def integrate(ticks: DataFrame, m: Motion | None = None, key: str = "body_id") -> DataFrame:
    """(key, px, py, vx, vy): the last state of each body over its ticks (ord, dt, input_x, input_y), from rest.

    A null dt is no time, a null input none; a null key is a body.
    """
    return _folded(ticks, m or Motion(), None, key)


def world_ticks(ticks: DataFrame, world: World, m: Motion | None = None, key: str = "body_id") -> DataFrame:
    """The same after all ticks, of 1/60 s each whatever their dt, in a world."""
    return _folded(ticks.withColumn("dt", F.lit(TICK)), m or Motion(), world, key)


def stream_motion(ticks: DataFrame, m: Motion | None = None, world: World | None = None, key: str = "body_id") -> DataFrame:
    """The same as a stream: (key, ord, px, py, vx, vy) after each micro-batch.

    A body's state is four numbers and the last ``ord``; ticks of a batch are
    taken in order, and ticks at or before the last one are dropped as late.
    """
    m = m or Motion()

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = state.get if state.exists else (-1, 0.0, 0.0, 0.0, 0.0)
        last, body = s[0], tuple(s[1:])
        for o, dt, ix, iy in pd.concat(list(frames)).sort_values("ord")[["ord", "dt", "input_x", "input_y"]].itertuples(index=False):
            if o > last:
                last, body = int(o), tick(body, float(ix), float(iy), float(dt), m, world)
        state.update((last, *body))
        yield pd.DataFrame([(k[0], last, *body)], columns=[key, "ord", "px", "py", "vx", "vy"])

    return ticks.groupBy(key).applyInPandasWithState(run, f"{key} long, ord long, px double, py double, vx double, vy double", "ord long, px double, py double, vx double, vy double", "update", GroupStateTimeout.NoTimeout)
