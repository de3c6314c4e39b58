"""Hard negatives against brute force over all rows."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, c int, anchor string, `key` int"


def brute(rows, every, k):
    seen = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            seen[i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = 1
    out = []
    cut = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for i, lab, q in seen:
        if i % every:
            continue
        scored = sorted((-cut(sum(a * b for a, b in zip(q, v))), j, m) for j, m, v in seen if j != i)
        for p, j, m in [x for x in scored if x[2] == lab][:k]:
            hits = [x for x in scored if x[2] != lab and 80 * -p <= 100 * -x[0] <= 100 * -p][:k]
            out += [(i, j, n + 1, x[1], -p, -x[0]) for n, x in enumerate(hits)]
    return sorted(out)


def ours(spark, rows, every=10, k=5):
    d = spark.createDataFrame([(i, v, lab, 0, "x", 1) for i, v, lab in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.mine(d, F.col("vec_id") % every == 0, F.col("label"), k, k).collect())


@pytest.mark.parametrize(("block", "leaf"), [(4096, 64), (57, 4)])
def test_brute_force(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "LEAF", leaf)
    r = random.Random(3)
    centres = [[r.gauss(0, 0.4) for _ in range(8)] for _ in range(4)]
    rows = [(i, [x + r.gauss(0, 0.15) for x in centres[r.randrange(4)]], r.randrange(3)) for i in range(220)]
    rows += [(300 + i, rows[10][1], i % 3) for i in range(40)]  # ties with an anchor
    rows += [(500, None, 1), (510, [1.0, None], 1), (520, [float("nan")] * 8, 1), (530, [float("inf")] * 8, 1), (None, [0.1] * 8, 1), (540, [0.1] * 8, None), (550, [], 1), (560, [1.0, 2.0], 2)]
    rows += [rows[20], (30, rows[31][1], 1), (30, rows[31][1], 2)]  # alike, and one id with several vectors
    got = ours(spark, rows)
    assert got == brute(rows, 10, 5) and len(got) > 300


def test_few_heavy_and_no_rows(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(0, [1.0], 1)]) == []
    one_label = [(i, [1.0, i / 10], 1) for i in range(30)]
    assert ours(spark, one_label) == []
    heavy = [(0, [1e18, 1.0], 0), (1, [1e18, 2.0], 0), (2, [9e17, 0.0], 1), (3, [1e30, 0.0], 1), (4, [-1e30, 0.0], 1), (5, [0.0, 1.0], 1), (10, [-1.0, 0.0], 0)]
    assert ours(spark, heavy) == brute(heavy, 10, 5)


def test_the_tree_leaves_parts_out(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 64)
    r = np.random.default_rng(1)
    centres = r.normal(0, 300, (16, 8))
    m = np.floor(np.concatenate([c + r.normal(0, 3, (128, 8)) for c in centres]))
    t = negatives.Tree(np.arange(len(m)), np.arange(len(m)) % 5, m)
    s = negatives.Search(t, 0, m[0])
    got = list(itertools.islice(s.nearest(lambda labels: labels != 0), 5))
    scores = (m @ m[0]).astype(int)
    assert got == sorted(((int(x), i) for i, x in enumerate(scores) if i % 5), key=lambda x: (-x[0], x[1]))[:5]
    assert s.leaves < sum(n[2] < 0 for n in t.nodes) / 2


def test_nothing_is_broadcast(spark, monkeypatch):
    """Behind an explode Spark took a copy of the anchors for every block for as few bytes as the anchors, and sent all of them to the driver."""
    monkeypatch.setattr(negatives, "BLOCK", 16)
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], r.randrange(3)) for i in range(200)]
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        assert ours(spark, rows) == brute(rows, 10, 5)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


@pytest.mark.parametrize(("groups", "held"), [(2, 32), (1, 2)])
def test_groups_of_trees(spark, monkeypatch, groups, held):
    """A group's trees share the floors; ids below a k-th of equal score still take its place."""
    for name, x in (("BLOCK", 32), ("GROUPS", groups), ("HELD", held), ("ANCHORS", 3), ("FOUND", 10)):
        monkeypatch.setattr(negatives, name, x)
    r = random.Random(6)
    few = [[r.gauss(0, 1) for _ in range(3)] for _ in range(9)]
    rows = [(i, few[r.randrange(9)], r.randrange(3)) for i in range(300)] + [(310, [1e18, 0.0, 0.0], 1), (320, [9e17, 1.0, 2.0], 1), (330, [9e17, 0.0, 0.0], 2)]
    assert ours(spark, rows) == brute(rows, 10, 5)


def test_asks_open_few_parts(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 64)
    r = np.random.default_rng(1)
    centres = r.normal(0, 300, (16, 8))
    m = np.floor(np.concatenate([c + r.normal(0, 3, (128, 8)) for c in centres]))
    t = negatives.Tree(np.arange(len(m)), np.arange(len(m)) % 5, m)
    at = np.array([0, 700, 1500])
    low, high = np.full(3, -(1 << 63)), np.full(3, (1 << 63) - 1)
    asks = negatives.Asks(at, at % 5, m[at], np.arange(3), low, high, False, 5)
    assert asks.walk(t) < 3 * sum(n[2] < 0 for n in t.nodes) / 2
    scores = (m @ m[at].T).astype(int)
    want = [(a, -s, i) for a in range(3) for s, i in sorted((-int(scores[i, a]), i) for i in range(len(m)) if i % 5 != at[a] % 5)[:5]]
    assert list(zip(*(x.tolist() for x in asks.best))) == want
