"""The code's geometry, fingerprints, and groups against brute force."""

from __future__ import annotations

import os
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from rasterloom.llm import golay, graph, simhash


def test_golay_keys_meet_within_one_bit():
    r = np.random.default_rng(0)
    w = r.integers(0, 1 << 23, 20000)
    v = w ^ (np.int64(1) << r.integers(0, 23, len(w)))
    for a, b in ((w, w), (w, v), (v, w)):
        assert (golay.keys(b) == golay.home(a)[:, None]).any(axis=1).all()
    k = golay.keys(w)
    assert set((k >= 0).sum(axis=1)) <= {1, 6} and (k[:, 0] == golay.home(w)).all()


def test_golay_home_is_the_nearest_codeword():
    parity, _ = golay.tables()
    code = (np.arange(4096) << 11) | parity
    for w in np.random.default_rng(1).integers(0, 1 << 23, 50):
        d = np.array([int(x).bit_count() for x in code ^ w])
        assert d[golay.home(np.array([w]))[0]] == d.min() <= 3
        assert set(np.flatnonzero(d <= 4)) == {int(x) for x in golay.keys(np.array([w]))[0] if x >= 0}


def brute_fp(text, size=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    s = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("paired", [16, 1])
def test_fingerprint_groups(docs_of, prose, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    r = random.Random(2)
    rows = []
    for d in range(150):
        w = prose(d // 5, 400).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "x"
        rows.append((d, " ".join(w)))
    rows += [(150, None), (151, ""), (152, "One"), (153, "two Words"), (154, " \t\n"), (155, rows[0][1].upper()), (3, rows[140][1]), (None, "q"), (156, "é É")]
    got = simhash.fingerprint_groups(docs_of(rows)).collect()
    fps = [(d, brute_fp(t)) for d, t in rows]
    assert sorted((r["doc_id"], r["fingerprint"]) for r in got if r["doc_id"] is not None) == sorted((d, f"{f:016x}") for d, f in fps if d is not None)
    known = [(d, f) for d, f in fps if d is not None]
    want = brute_groups({d for d, _ in known}, [(a, b) for (a, f), (b, g) in combinations(known, 2) if (f ^ g).bit_count() <= 2])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("paired", [16, 1])
def test_links_keep_every_component(spark, monkeypatch, bits, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    r = random.Random(bits)
    fps = {r.getrandbits(64) for _ in range(40)}
    for _ in range(300):
        f = r.choice(sorted(fps))
        for _ in range(r.randint(1, 3)):
            f ^= 1 << r.randrange(64)
        fps.add(f)
    nodes = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(n, f - (1 << 64) if f >> 63 else f) for n, f in nodes], "node long, fp long")
    links = [(x["a"], x["b"]) for x in simhash.fingerprint_links(df, bits).collect()]
    want = brute_groups(range(len(nodes)), [(a, b) for (a, f), (b, g) in combinations(nodes, 2) if (f ^ g).bit_count() <= bits])
    assert brute_groups(range(len(nodes)), links) == want


def test_components_of_a_long_chain_and_a_star(spark):
    e = [(i, i + 1) for i in range(100, 160)] + [(0, k) for k in range(200, 260)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert {v for k, v in got.items() if 100 <= k <= 160} == {100} and {v for k, v in got.items() if k >= 200 or k == 0} == {0}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_components_of_random_graphs(spark, monkeypatch, seed):
    r = random.Random(seed)
    e = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000, 1000), (7, 7)]  # repeats, both directions, loops
    kept = []
    keep = graph.Scratch.keep
    monkeypatch.setattr(graph.Scratch, "keep", lambda self, df, name, *a: kept.append((name, out := keep(self, df, name, *a), out.count())) or out)
    got = {x["node"]: x["label"] for x in graph.components(spark.createDataFrame(e + e[:50], "a long, b long")).collect()}
    assert got == brute_groups({x for p in e for x in p}, e)
    n = [rows for name, _, rows in kept if name == "edges"]
    assert n[-1] == 0 and all(b < a for a, b in zip(n, n[1:], strict=False)) and sum(n) <= 3 * n[0]


def test_near_duplicates_by_similarity(docs_of, prose):
    r = random.Random(3)
    rows = []
    for d in range(120):
        w = prose(1000 + d // 4, 300).split()
        for _ in range(d % 4):
            w[r.randrange(len(w))] = f"w{r.random()}"
        rows.append((d, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "  "), (203, rows[8][1].upper()), (None, rows[0][1]), (204, "short text"), (205, "short  text")]
    sets = {d: frozenset(simhash.shingle_hashes(simhash.words_of(t), 5).tolist()) for d, t in rows if d is not None}
    same = lambda a, b: simhash.words_of(dict(rows)[a]) == simhash.words_of(dict(rows)[b])
    linked = [(a, b) for a, b in combinations(sorted(sets), 2) if same(a, b) or (sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)]
    want = brute_groups(sets, linked)
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(docs_of(rows)).collect()}
    assert got == want
    kept = simhash.keep_one(docs_of(rows))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({v for v in want.values()})
    assert kept.columns == docs_of(rows).columns and kept.where("doc_id is null").count() == 1


def test_a_key_full_of_unlike_nodes(docs_of, prose, monkeypatch):
    """All nodes share every Golay key: the shingles tell the groups."""
    monkeypatch.setattr(simhash.golay, "home", lambda w: np.zeros_like(w))
    rows = [(d, prose(d // 3, 200) + (f" more{d}" if d % 3 else "")) for d in range(30)]
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicate_groups(docs_of(rows)).collect()}
    assert got == {d: d // 3 * 3 for d in range(30)}


def test_sizes_and_parities_rule_out_no_alike_pair():
    r = np.random.default_rng(4)
    for _ in range(300):
        n = int(r.integers(1, 3000))
        a = r.integers(0, 1 << 63, n, np.uint64)
        b = np.unique(np.concatenate([a[: int(n * r.uniform(0.8, 1))], r.integers(0, 1 << 63, int(n * r.uniform(0, 0.2)), np.uint64)]))
        a = np.unique(a)
        apart = sum(int(x).bit_count() for x in (simhash.parity(a) ^ simhash.parity(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))
        if simhash.similarity(a, b) >= 0.8:
            assert apart <= (len(a) + len(b)) * 0.2 / 1.8 + 1e-6 and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) - 1e-6
            assert np.intersect1d(simhash.prefix(a, a[::3], 0.8), simhash.prefix(b, a[::3], 0.8)).size


@pytest.mark.parametrize("copies", [40, 160])
def test_rows_stay_in_proportion_to_a_group_of_near_copies(docs_of, prose, monkeypatch, copies):
    """Copies of one text, each changed in its own way and often unlike each other: pairs looked at a copy don't grow."""
    w, r, rows = prose(77, 200).split(), random.Random(8), []
    for d in range(copies):
        v = list(w)
        for at in r.sample(range(200), 4 if d else 0):
            v[at] = f"w{d}x{at}"
        rows.append((d, " ".join(v)))
    looked = []
    real = simhash.Verifier.candidates

    def counted(self, pairs, scratch):
        looked.append(pairs.distinct().count())
        return real(self, pairs, scratch)

    monkeypatch.setattr(simhash.Verifier, "candidates", counted)
    got = {x["doc_id"]: x["group_id"] for x in simhash.near_duplicate_groups(docs_of(rows)).collect()}
    assert set(got.values()) == {0} and sum(looked) <= 8 * copies


def test_columns_whose_names_clash(spark, prose):
    rows = [(1, prose(1, 50), "x"), (2, prose(1, 50), "y"), (None, prose(1, 50), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string").selectExpr("*", "gone as node", "gone as key", "gone as GONE_")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["gone"] for r in kept.collect()) == ["x", "z"]


def test_intermediate_tables_are_deleted(spark, docs_of, prose):
    from rasterloom.llm import common

    base = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(base))
    simhash.near_duplicate_groups(docs_of([(d, prose(d // 2, 60)) for d in range(8)])).collect()
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(base)) - before} == {"rasterloom-groups"}


def test_no_documents(docs_of):
    assert simhash.fingerprint_groups(docs_of([])).count() == 0
    assert simhash.keep_one(docs_of([])).count() == 0


@pytest.mark.parametrize("change", ["substituted", "appended", "truncated"])
@pytest.mark.parametrize("frequent", [False, True])
def test_every_near_pair_is_found(docs_of, prose, monkeypatch, change, frequent):
    """Pairs of a similarity of 0.80 to 0.90 and a little under 0.80, by brute force."""
    if frequent:  # whatever the order, no pair is lost
        monkeypatch.setattr(simhash, "frequent_shingles", lambda docs, id_col, text_col, size: np.unique(np.concatenate([np.array(sorted(s)[:: 3], np.uint64) for s in sets.values()])))
    r = random.Random(5)
    texts = {}
    for k in range(60):
        w = prose(9000 + k, 300).split()
        least = r.uniform(0.78, 0.9)
        if change == "substituted":
            v = list(w)
            for at in r.sample(range(300), round(300 * (1 - least) / (1 + least) / 5)):
                v[at] = f"w{r.random()}"
        elif change == "appended":
            v = w + prose(19000 + k, round(300 / least) - 300).split()
        else:
            v = w[: round(300 * least)]
        texts[2 * k], texts[2 * k + 1] = " ".join(w), " ".join(v)
    sets = {d: frozenset(simhash.shingle_hashes(simhash.words_of(t), 5).tolist()) for d, t in texts.items()}
    linked = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert 30 < len(linked) < 60
    got = {x["doc_id"]: x["group_id"] for x in simhash.near_duplicate_groups(docs_of(list(texts.items()))).collect()}
    assert got == brute_groups(texts, linked)


def test_pair_of_unlike_vocabularies(docs_of):
    """Many shingles of few words, then few shingles of many words: alike by shingles, unlike by words."""
    r = random.Random(6)
    w = [r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1000)]
    rows = [(1, " ".join(w)), (2, " ".join(w + [f"w{k}" for k in range(200)]))]
    assert {x["group_id"] for x in simhash.near_duplicate_groups(docs_of(rows)).collect()} == {1}
