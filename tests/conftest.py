"""One Spark session for all tests, and images as nested lists."""

from __future__ import annotations

import os
import sys

import numpy as np
import pytest

from support import ROOT

sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def px_of(spark):
    """Pixels of images given as (h, w, 4) arrays."""

    def make(*grids):
        rows = [(i, x, y, *map(int, g[y, x])) for i, g in enumerate(map(np.asarray, grids)) for y in range(g.shape[0]) for x in range(g.shape[1])]
        return spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")

    return make


@pytest.fixture(scope="session")
def grids_of():
    """(h, w, 4) arrays of pixels, by image."""

    def back(px):
        by: dict = {}
        for r in px.collect():
            by.setdefault(r["image_id"], []).append(r)
        out = {}
        for k, rows in by.items():
            g = np.full((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1, 4), -1)
            for r in rows:
                assert (g[r["y"], r["x"]] == -1).all(), "a place has two rows"
                g[r["y"], r["x"]] = (r["r"], r["g"], r["b"], r["a"])
            assert (g >= 0).all(), "a place has no row"
            out[k] = g
        return out

    return back
