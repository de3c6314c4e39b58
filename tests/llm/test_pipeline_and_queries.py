"""The pipeline against plain functions stage by stage, and the queries against SQL."""

from __future__ import annotations

import os

import duckdb
import pytest
from support import DATA

import corpus_pipeline
from rasterloom.llm import common, registry

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = sorted(df.columns)
    assert order == sorted(names)
    theirs = sorted(tuple(str(r[names.index(c)]) for c in order) for r in cur.fetchall())
    assert sorted(tuple(str(r[c]) for c in order) for r in df.collect()) == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"pipeline"}))
def test_query_covers_its_table(spark, name):
    df = registry.queries()[name](spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert df.select("doc_id").distinct().count() == docs.count()


def test_stages_take_effect_and_return_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    start, ids = docs.count(), {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, docs, DATA), "stage")
        assert out.columns == docs.columns, name
        now = {r[0] for r in out.select("doc_id").collect()}
        assert now <= ids and out.count() == len(now)
        docs, ids = out, now
    assert 0 < len(ids) <= start
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r[0] for r in packed.select("doc_id").collect()} == ids


def test_run_is_its_stages(spark):
    a = corpus_pipeline.run(spark, DATA)
    docs = common.table(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, DATA), "stage")
    key = lambda d: sorted(map(tuple, d.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert key(a) == key(docs)
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
