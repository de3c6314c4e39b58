"""Near duplicates whose shared keys are led by documents unlike them, against brute force."""

from __future__ import annotations

import random

import pytest

from rasterloom.llm import simhash


def shingles(text):
    w = text.split(" ")
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets, of = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def root(d):
        while of[d] != d:
            d = of[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                ra, rb = root(a), root(b)
                of[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d in ids}


def ours(docs):
    return {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(docs).collect()}


def group(prose, k, leaders, at):
    """Two ends of similarity about 0.85, and longer leaders that hold all they share, each with a document that shares its tail."""
    base = prose(k * 100, 250)
    rows = [(at, base + " " + prose(k * 100 + 1, 14)), (at + 1, base + " " + prose(k * 100 + 2, 28))]
    for j in range(leaders):
        tail = prose(k * 100 + 10 + j, 300)
        rows += [(at + 2 + 2 * j, base + " " + tail), (at + 3 + 2 * j, tail + " " + prose(k * 100 + 50 + j, 200))]
    return rows


@pytest.mark.parametrize(("leaders", "ordinary"), [(1, 0), (1, 40), (2, 40)])
def test_unlike_leaders_hide_no_link(docs_of, prose, leaders, ordinary):
    rows = [r for k in range(10) for r in group(prose, k, leaders, 1000 + 20 * k)]
    for k in range(ordinary):
        t = prose(5000 + k, 200)
        rows += [(10_000 + 2 * k, t), (10_001 + 2 * k, t + " and more")]
    got = ours(docs_of(rows))
    assert got == brute(rows)
    assert all(got[1001 + 20 * k] == 1000 + 20 * k for k in range(10))


@pytest.mark.parametrize("seed", range(2))
def test_random_leaders_of_any_size(docs_of, prose, seed):
    r = random.Random(seed)
    rows, at = [], 0
    for k in range(14):
        base = prose(seed * 10_000 + k * 100, r.randrange(40, 260)).split(" ")
        ends = [" ".join(base) + " " + prose(seed * 10_000 + k * 100 + j, max(1, int(len(base) * r.uniform(0.02, 0.2)))) for j in (1, 2, 3)]
        for j in range(r.randrange(0, 6)):  # quotations of parts, as long as the ends or longer
            part = base[r.randrange(len(base) // 2) :]
            ends.append(" ".join(part) + " " + prose(seed * 10_000 + k * 100 + 10 + j, int(len(base) * r.uniform(0.3, 2))))
        r.shuffle(ends)
        rows += [(at + i, t) for i, t in enumerate(ends)]
        at += len(ends)
    assert ours(docs_of(rows)) == brute(rows)
