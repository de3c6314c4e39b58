"""The manifest against plain recursion."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def shown(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def proofs(nodes):
    """(root, [(left, right), ...] of each node)."""
    where, ways = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, at in enumerate(where):
            run = nodes[at // 3 * 3 : at // 3 * 3 + 3]
            ways[i].append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
            where[i] = at // 3
        nodes = [h(*nodes[a : a + 3]) for a in range(0, len(nodes), 3)]
    return nodes[0], ways


def brute(rows):
    """rows: (doc_id, text, source, lang, n_chars)."""
    leaf = lambda r, text: h(*map(shown, (r[0], r[2], r[3], r[4], text)))
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, ways = {}, {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        subs[s], ways[s] = proofs([leaf(r, r[1]) for r in by[s]])
    root, above = proofs([subs[s] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        for r, w in zip(by[s], ways[s], strict=True):
            at = leaf(r, r[1].replace("\n", "") if r[1] is not None and r[0] is not None and r[0] % 2 == 0 else r[1])
            for a, z in w + up:
                at = h(a, at, z)
            out.append((r[0], leaf(r, r[1]), subs[s], root, h(*(a + z for a, z in w + up)), at, at == root))
    return sorted(map(str, out))


def ours(spark, rows):
    d = spark.createDataFrame([(*r, "g", 7, "x") for r in rows], "doc_id long, text string, source string, lang string, n_chars long, g string, pos int, digest string")
    out = merkle.manifest(d, F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text")))
    return sorted(str(tuple(r)) for r in out.collect())


@pytest.fixture(params=[5, 1])
def levels(request, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", request.param)
    monkeypatch.setattr(merkle, "BLOCK", 3**request.param)
    if request.param == 1:
        monkeypatch.setattr(merkle, "_COLLAPSE", merkle._COLLAPSE.replace("sequence(1, 5)", "sequence(1, 1)"))
        monkeypatch.setattr(merkle, "_PATH", merkle._PATH.replace("sequence(0, 4)", "sequence(0, 0)").replace("243", "3"))


def test_sources_of_any_size(spark, levels):
    r = random.Random(2)
    sources = {"a": 260, "b": 1, "ä": 9, None: 10, "": 3, "B": 4, "c d": 28}
    rows = [(r.randrange(10**9), r.choice([None, "", "x\ny", "naïve\n" * r.randrange(4), "plain"]), s, r.choice([None, "en"]), r.choice([None, 3])) for s, n in sources.items() for _ in range(n)]
    rows += [(None, "a\nb", "a", None, None), (None, "c", "a", None, None), rows[0], rows[0], (rows[1][0], "other", "a", "en", 1)]
    assert ours(spark, rows) == brute(rows)


def test_lone_rows_and_none(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(1, None, None, None, None)]) == brute([(1, None, None, None, None)])
    long = [(2, "long \n" * 300_000, "s", "en", 5), (4, "no break", "s", "en", 5)]
    got = ours(spark, long)
    assert got == brute(long) and "False" in got[0] + got[1] and "True" in got[0] + got[1]


def test_no_python_in_the_plan(spark, docs_of):
    plan = merkle.manifest(docs_of([(1, "a")]).withColumn("n_chars", F.lit(1)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
