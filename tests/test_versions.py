"""Undo over a log of changed pixels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import pointwise
from rasterloom.plans import plugins
from rasterloom.schema import PX_COLS


def rows(d):
    return sorted(map(str, map(tuple, d.select(*PX_COLS).collect())))


def test_versions_come_back_through_folds_and_undone_pushes(spark, px_of):
    px = px_of(np.full((3, 4, 4), 255), np.full((2, 2, 4), 9))
    v, want = plugins.Versions(px, depth=2), [rows(px)]
    for k in range(6):  # folded once there are over four
        new = v.current.withColumn("r", F.when(F.col("x") == k % 4, k).otherwise(F.col("r")))
        assert rows(v.push(new)) != want[-1]
        want.append(rows(v.current))
    assert rows(v.undo()) == want[-2] and rows(v.undo()) == want[-3]
    assert rows(v.undo()) == want[-3]  # no deeper
    again = v.push(pointwise.clear_rect(v.current, 0, 0, 2, 2))
    assert rows(again) == rows(pointwise.clear_rect(v.undo(), 0, 0, 2, 2))
    assert rows(v.current) == want[-3]


def test_pixels_that_go_and_come_and_null_ids(spark, px_of):
    px = px_of(np.full((2, 3, 4), 7)).withColumn("image_id", F.when(F.col("x") > 0, F.col("image_id")))
    v = plugins.Versions(px.withColumn("note", F.lit("x")))
    cropped = v.push(v.current.where("y = 0"))
    assert cropped.count() == 3 and v.push(px).count() == 6 and rows(v.current) == rows(px)
    assert rows(v.undo()) == rows(cropped) and rows(v.undo()) == rows(px)
    assert plugins.Versions(px.where("false")).undo().count() == 0
    with pytest.raises(ValueError):
        plugins.Versions(px, depth=0)


def test_only_changes_are_logged_and_plans_do_not_grow(spark, px_of):
    v = plugins.Versions(px_of(np.full((8, 8, 4), 5)))
    sizes = []
    for k in range(12):
        v.push(pointwise.clear_rect(v.current, k % 8, k // 8, 1, 1))
        sizes.append(len(v.current._jdf.queryExecution().optimizedPlan().toString().split("\n")))
        assert spark.read.parquet(v.folders[-1]).count() == 1
    assert len(set(sizes)) == 1
