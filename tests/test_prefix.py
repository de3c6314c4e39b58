"""Packing by ranges against packing in one go, and both against plain sums."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import cells, prefix

SCHEMA = "sheet int, ord long, w int, h int"


def drawn(n, seed=1):
    """A third of all boxes on one sheet, orders uneven and many alike, some null."""
    r = random.Random(seed)
    order = lambda: None if r.random() < 0.01 else r.choice([r.randrange(10), int(r.expovariate(1 / 1e6)), -(1 << 60)])
    return [(r.choice([0, 0, 1, 2, 3, None]), order(), r.randrange(1, 30), r.randrange(1, 20)) for _ in range(n)]


def plain(rows):
    low = lambda v: (v is not None, v or 0)
    out, sheets = [], {}
    for r in rows:
        sheets.setdefault(r[0], []).append(r)
    for s, of in sheets.items():
        x, top, wide = 0, max(r[3] for r in of), sum(r[2] for r in of)
        for r in sorted(of, key=lambda r: (low(r[1]), r[2], r[3])):
            out.append((s, r[1], x, (top - r[3]) // 2, r[2], r[3], wide, top))
            x += r[2]
    return sorted(map(str, out))


@pytest.mark.parametrize("run", [1, 7, 100, None])
def test_rows_of_boxes(spark, run):
    rows = drawn(900)
    d = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"x": F.lit("clash"), "idx": F.lit(1)})
    got = cells.pack_row(d, run=run)
    assert got.columns == ["sheet", "ord", "x", "y", "w", "h", "atlas_w", "atlas_h"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows)


@pytest.mark.parametrize("custom", [None, (40, 33)])
def test_equal_slots(spark, custom):
    d = spark.createDataFrame(drawn(700, 2), SCHEMA)
    key = lambda run: sorted(str(tuple(r)) for r in cells.export_layout(d, uniform=True, custom=custom, run=run).collect())
    assert key(5) == key(None) and len(key(5)) == 700


def test_one_order_for_all_and_none_at_all(spark):
    same = [(1, 5, 2, 2)] * 50
    assert sorted(r["x"] for r in cells.pack_row(spark.createDataFrame(same, SCHEMA), run=3).collect()) == list(range(0, 100, 2))
    assert cells.pack_row(spark.createDataFrame([], SCHEMA), run=3).count() == 0


def test_ranges_are_even_and_rise_with_the_order(spark):
    d = spark.createDataFrame([(0, i * i, 1, 1) for i in range(5000)], SCHEMA)
    r = prefix._ranged(d, "sheet", "ord", 100).groupBy("__range").agg(F.count("*").alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi")).orderBy("__range").collect()
    assert len(r) > 40 and max(x["n"] for x in r) < 200 and all(a["hi"] < b["lo"] for a, b in zip(r, r[1:], strict=False))


def test_no_window_holds_a_sheet_of_many_boxes(spark):
    d = spark.createDataFrame(drawn(300, 3), SCHEMA)
    plan = cells.pack_row(d, run=10)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    rows = [x for x in windows if "__row#" in x]
    assert rows and all("windowspecdefinition(sheet#" in x and "__range#" in x for x in rows)
    assert all("__s_w#" in x or "__t_h#" in x for x in windows if x not in rows)  # of ranges only
