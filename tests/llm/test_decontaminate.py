"""Against brute force, and the cases that the module defines."""

from __future__ import annotations

import random
import re

import pytest

from rasterloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, bench, window=13):
    grams = {}
    for item, t in bench:
        w = WORD.findall(lower(t))
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            grams.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, items = set(), set()
        for g, its in grams.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    items |= its
        out.append((d, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def ours(df):
    return sorted([(r["id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def case(prose):
    r = random.Random(1)
    bench = [(i, prose(100 + i, n)) for i, n in enumerate([40, 13, 14, 5, 1, 12, 0, 2])] + [(None, prose(7, 20)), (3, prose(103, 5).upper())]
    docs = []
    for d in range(60):
        parts = [prose(d, r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            w = (r.choice(bench)[1] or "").split()
            a = r.randint(0, max(0, len(w) - 1))
            parts.append("-- ".join(w[a : a + r.randint(1, 30)]))
            parts.append(prose(1000 + d, r.randint(0, 9)))
        docs.append((d, ", ".join(parts)))
    docs += [(60, None), (61, ""), (62, "!!! ???"), (None, prose(100, 40)), (5, docs[5][1]), (63, "É" + prose(101, 13)), (64, (prose(64, 3000) + " " + prose(100, 40) + " ") * 3)]
    return docs, bench


def test_brute_force(spark, docs_of, case):
    docs, bench = case
    b = spark.createDataFrame(bench, "item_id int, text string")
    assert ours(D.judge(docs_of(docs), b)) == brute(docs, bench)


def test_without_broadcast(spark, docs_of, case, monkeypatch):
    docs, bench = case
    monkeypatch.setattr(D, "fits_broadcast", lambda rows, size: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert ours(D.judge(docs_of(docs), spark.createDataFrame(bench, "item_id int, text string"))) == brute(docs, bench)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id int, text string")
    assert ours(D.judge(docs_of([(1, "a b")]), none)) == [(1, 2, 0, [], False)]
    assert D.judge(docs_of([]), none).count() == 0


def test_drop_and_cut(spark, docs_of, prose):
    b = spark.createDataFrame([(1, prose(1, 20))], "item_id int, text string")
    docs = docs_of([(1, "Start here, " + prose(1, 20) + ". And on."), (2, prose(2, 50)), (3, None)])
    assert {r["doc_id"] for r in D.decontaminate(docs, b).collect()} == {2, 3}
    cut = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, b, mode="cut").collect()}
    assert cut == {1: "Start here. And on.", 2: prose(2, 50), 3: None}
    with pytest.raises(ValueError):
        D.decontaminate(docs, b, mode="x")


def test_there_is_no_python_in_the_plan(spark, docs_of):
    b = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    plan = D.judge(docs_of([(1, "a b c")]), b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
