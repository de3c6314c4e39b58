"""Both ways of dropping lines against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from rasterloom.llm import lines


def brute(rows, ratio, least):
    total, pages = Counter(), Counter()
    for _, text, host in rows:
        total[host or ""] += 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            pages[host or "", line] += 1
    bad = {k for k, n in pages.items() if n >= least and n > ratio * total[k[0]]}
    return sorted([(d, None if t is None else "\n".join(x for x in t.split("\n") if (h or "", x.strip(" ")) not in bad)) for d, t, h in rows], key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    shared = [f"Line {k}" for k in range(8)]
    out = []
    for d in range(200):
        host = r.choice(["a", "a", "a", "b", None])
        body = [f"own {d} {k}" for k in range(r.randint(0, 4))] + r.sample(shared, r.randint(0, 3)) + [""] * r.randint(0, 2)
        r.shuffle(body)
        out.append((d, "\n".join(x + " " * r.randint(0, 2) for x in body), host))
    return out + [(200, None, "a"), (201, "", "b"), (202, "Line 0", "lonely"), (3, out[3][1], out[3][2]), (203, "x " * 100_000 + "\nLine 1", "a"), (204, "Line 1", "a")]


@pytest.mark.parametrize("broadcast", [None, False])
@pytest.mark.parametrize("ratio,least", [(0.05, 3), (0.2, 1), (0.0, 2)])
def test_brute_force(docs_of, rows, broadcast, ratio, least):
    docs = docs_of(rows)
    out = lines.drop_lines(docs, ratio=ratio, least_pages=least, broadcast=broadcast)
    assert out.columns == docs.columns
    assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=str) == brute(rows, ratio, least)


def test_no_documents(docs_of):
    for b in (None, False):
        assert lines.drop_lines(docs_of([]), broadcast=b).count() == 0


@pytest.mark.parametrize("broadcast", [None, False])
def test_copies_are_one_page(docs_of, broadcast):
    """Six copies on a host of 100 pages keep their text; a line of six pages that differ goes."""
    copy = "first of the copies\nsecond of the copies"
    rows = [(d, copy if d < 6 else f"own {d}" + ("\nmenu" if d < 12 else ""), "h") for d in range(100)]
    out = {r["doc_id"]: r["text"] for r in lines.drop_lines(docs_of(rows), broadcast=broadcast, once=True).collect()}
    assert out == {d: t.removesuffix("\nmenu") for d, t, _ in rows}


def test_the_pipeline_keeps_one_of_large_groups_of_copies(spark, docs_of):
    import corpus_pipeline

    rows = [(d, f"copy of host {d % 2}\nbody {d % 2}" if d < 80 else f"own {d}", f"h{d % 2}") for d in range(300)]
    kept = corpus_pipeline.near_dedup(spark, corpus_pipeline.line_dedup(spark, docs_of(rows), ""), "")
    assert sorted(r["text"] for r in kept.collect()) == sorted({t for _, t, _ in rows})


@pytest.mark.parametrize("broadcast", [None, False])
def test_small_hosts_lose_lines_too(docs_of, broadcast):
    import corpus_pipeline

    rows = [(d, f"own {d}\nmenu", "four") for d in range(4)] + [(d, f"own {d}" + ("\nmenu" if d < 13 else "\npair" if d < 15 else ""), "ten") for d in range(10, 20)]
    want = {d: t.removesuffix("\nmenu") for d, t, _ in rows}
    assert {r["doc_id"]: r["text"] for r in lines.drop_lines(docs_of(rows), broadcast=broadcast, once=True, share=lines.SHARE).collect()} == want
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(None, docs_of(rows), "").collect()} == want
