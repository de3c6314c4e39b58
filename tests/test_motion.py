"""Motion over sorted batches against the plain fold."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.streaming import temporal

SCHEMA = "body_id long, ord long, dt double, input_x double, input_y double"
WORLD = temporal.World(400, ((20, 360, 80, 400), (-90, 300, -40, 400)))


def fold(rows, m, world=None, dt=None):
    out = {}
    low = lambda v: (v is not None, v or 0)  # noqa: E731  nulls first
    for b, _, t, ix, iy in sorted(rows, key=lambda r: [low(v) for v in r]):
        out[b] = temporal.tick(out.get(b, (0.0,) * 4), ix or 0.0, iy or 0.0, dt or t or 0.0, m, world)
    return out


def drawn(seed, n, bodies, hot):
    r = random.Random(seed)
    rows = [(0 if r.random() < hot else r.randrange(bodies), o, r.choice([0.0, 0.05, 0.02, -1.0]), r.choice([-1.0, 0.0, 0.5, 1.0]), r.choice([-1.0, 0.0, 1.0])) for o in range(n)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [0.0, 0.34, 1.0])
def test_fold_is_that_of_the_ticks_in_order_bit_for_bit(spark, hot):
    rows = drawn(3, 4000, 40, hot)
    t = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        for world in (None, WORLD):
            d = temporal.world_ticks(t, world) if world else temporal.integrate(t)
            assert {r[0]: tuple(r)[1:] for r in d.collect()} == fold(rows, temporal.Motion(), world, temporal.TICK if world else None)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nulls_ties_repeated_rows_and_other_columns(spark):
    rows = [(None, 1, 0.1, 1.0, 0.0), (None, None, 0.1, 0.0, 1.0), (1, 1, 0.1, None, 1.0), (1, 1, 0.2, 1.0, None), (1, 1, 0.2, 1.0, None), (1, 2, None, 1.0, 1.0), (2, 5, 0.1, None, None)]
    t = spark.createDataFrame(rows, SCHEMA).withColumns({"px": F.lit("clash"), "__dt": F.lit(9)})
    assert {r[0]: tuple(r)[1:] for r in temporal.integrate(t).collect()} == fold(rows, temporal.Motion())
    assert temporal.integrate(t.where("false")).collect() == []


def test_keys_of_other_types(spark):
    t = spark.createDataFrame([("a", 1, 0.1, 1.0, 0.0), ("b", 1, 0.1, 0.0, 1.0)], "who string, ord long, dt double, input_x double, input_y double")
    assert sorted(r["who"] for r in temporal.integrate(t, key="who").collect()) == ["a", "b"]


def test_neighbouring_keys_and_nulls_are_told_apart():
    assert temporal._changes(pa.array([None, None, 0, 0, 1, 1, None])).tolist() == [False, True, False, True, False, True]


def test_plan_gathers_no_body(spark):
    t = spark.createDataFrame(drawn(1, 10, 3, 0.0), SCHEMA)
    plan = temporal.integrate(t)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan and "Aggregate" not in plan
