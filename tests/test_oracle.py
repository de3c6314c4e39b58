"""Every query with SQL against another engine on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from support import DATA

from rasterloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got, names = df.collect(), df.columns
    cur = duck.execute(catalog.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    assert sorted(names) == sorted(kinds)
    order = sorted(names)
    ours = sorted(tuple(str(r[c]) for c in order) for r in got)
    at = [list(kinds).index(c) for c in order]
    theirs = sorted(tuple(str(r[i]) for i in at) for r in want)
    assert ours == theirs
    assert got


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).limit(5).collect()
