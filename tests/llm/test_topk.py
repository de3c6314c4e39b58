"""Exactness against brute force in whole numbers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from rasterloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, c int"


def brute(rows, k, every):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            seen[i, tuple(math.floor(64 * float(np.float32(x))) for x in v)] = 1
    out = []
    for i, q in seen:
        if i % every:
            continue
        s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in seen if j != i)[:k]
        out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return sorted(out)


def ours(spark, rows, k, every):
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(d, k, every).collect())


@pytest.mark.parametrize("block", [4096, 37])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(16)]) for i in range(200)]
    rows += [(300 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 16), (403, [float("inf")] * 16), (None, [0.1] * 16), (404, []), (405, [1.0, 2.0]), (20, rows[20][1])]
    assert ours(spark, rows, 20, 20) == brute(rows, 20, 20)


def test_heavy_and_few_vectors(spark):
    rows = [(0, [3.0, -1e6]), (20, [1e6, 2.0]), (40, [0.0, 0.0])]
    assert ours(spark, rows, 20, 20) == brute(rows, 20, 20)
    assert ours(spark, [(0, [1.0])], 20, 20) == []
    assert ours(spark, [], 20, 20) == []
    big = [(0, [1e30, 1.0]), (20, [1e30, 1.0]), (21, [-1e30, 0.0])]
    got = ours(spark, big, 20, 20)
    assert [g[2] for g in got] == [20, 21, 0, 21] and got[0][3] == 2**63 - 1 and got[1][3] == -(2**63)


def test_the_index_stops_early_only_with_proof():
    r = np.random.default_rng(5)
    c = np.floor(r.normal(0, 10, (500, 32)))
    c[:5] += 200
    q = c[:4].copy()
    got = {i: (v.tolist(), s.tolist()) for i, v, s in topk.search_block(np.arange(4), q, np.arange(500), topk.ImpactIndex.build(c), 10)}
    for i in range(4):
        s = (c @ q[i]).astype(int)
        want = sorted((-s[j], j) for j in range(500) if j != i)[:10]
        assert got[i] == ([j for _, j in want], [-x for x, _ in want])


def _skewed(r, n, dims):
    """Components that fall by a quarter from one dimension to the next."""
    return np.floor(r.normal(0, 4000, (n, dims)) * 0.75 ** np.arange(dims))


def test_skewed_vectors_take_few_postings():
    r = np.random.default_rng(6)
    c = _skewed(r, 3000, 32)
    q = _skewed(r, 8, 32)
    counts = {}
    got = {i: (v.tolist(), s.tolist()) for i, v, s in topk.search_block(-1 - np.arange(8), q, np.arange(3000), topk.ImpactIndex.build(c), 10, counts=counts)}
    for i in range(8):
        s = (c @ q[i]).astype(int)
        want = sorted((-s[j], j) for j in range(3000))[:10]
        assert got[-1 - i] == ([j for _, j in want], [-x for x, _ in want])
    assert 0 < counts["postings"] < 0.5 * 8 * np.count_nonzero(c)


def test_a_floor_leaves_out_only_what_lies_below_it():
    r = np.random.default_rng(7)
    c, q = np.floor(r.normal(0, 10, (400, 16))), np.floor(r.normal(0, 10, (6, 16)))
    index = topk.ImpactIndex.build(c)
    free, bound = {}, {}
    all_ = {i: list(zip(v.tolist(), s.tolist())) for i, v, s in topk.search_block(-1 - np.arange(6), q, np.arange(400), index, 10, counts=free)}
    floor = np.array([all_[-1 - i][4][1] for i in range(6)], float)
    some = {i: list(zip(v.tolist(), s.tolist())) for i, v, s in topk.search_block(-1 - np.arange(6), q, np.arange(400), index, 10, floor, bound)}
    for i in range(6):
        assert [x for x in some[-1 - i] if x[1] >= floor[i]] == [x for x in all_[-1 - i] if x[1] >= floor[i]]
    assert bound["postings"] <= free["postings"]


def test_postings_are_those_of_the_block():
    c = np.array([[8.0, 0.0, -3.0], [0.0, 0.0, 0.0], [1.0, -7.0, 2.0]])
    index = topk.ImpactIndex.build(c)
    assert sorted(index.places.tolist()) == np.flatnonzero(c.ravel()).tolist()
    scores = np.zeros((3, 2))
    w = np.array([[1.0, 2.0], [3.0, 0.0], [-1.0, 5.0]])
    assert sum(index.add(s, w, scores) for s in range(topk.SEGMENTS)) == 5
    assert (scores == c @ w).all()
    assert (index.left[-1] == 0).all() and (np.diff(index.left, axis=0) <= 0).all()


def test_copies_of_queries_are_not_broadcast(spark, monkeypatch):
    """Behind an explode Spark took a copy of the queries for every block for as few bytes as the queries, and sent all of them to the driver."""
    monkeypatch.setattr(topk, "BLOCK", 8)
    r = random.Random(7)
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)], "vec_id long, embedding array<float>")
    plan = topk.top_k(rows, 3, 5)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [x for i, x in enumerate(plan) if "Join Inner" in x and any("Generate explode" in y for y in plan[i : i + 6])]
    assert joins and all("strategy=merge" in x for x in joins)
