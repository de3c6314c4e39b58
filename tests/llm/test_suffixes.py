"""Removal of repeats against sets of all 50-byte strings."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm import common, suffixes


def brute(rows):
    least = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                least[b[p : p + 50]] = min(i, least.get(b[p : p + 50], i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - 49):
                if least[b[p : p + 50]] < i:
                    gone[p : p + 50] = b"\1" * 50
        edge = [k for k in range(len(b) + 1) if (gone[k - 1] if k else 0) != (gone[k] if k < len(b) else 0)]
        out.append((i, len(b), edge[::2], edge[1::2], bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def ours(docs, batches=4):
    with common.Scratch() as scratch:
        return sorted(((r[0], r[1], list(r[2]), list(r[3]), bytes(r[4])) for r in suffixes.remove_repeats(docs, scratch, batches=batches).collect()), key=str)


@pytest.fixture(scope="module")
def corpus(prose):
    r = random.Random(4)
    base = [prose(k, 120) for k in range(12)]
    rows = []
    for i in range(90):
        t = r.choice(base)
        a = r.randrange(len(t) - 60)
        mid = t[a : a + r.choice([49, 50, 51, 80, 300])]  # on either side of the least length
        rows.append((i, prose(1000 + i, r.randrange(1, 30)) + " " + mid + prose(2000 + i, r.randrange(0, 30))))
    line = "a line that every third page shows, with some words more to be long enough"
    rows = [(i, f"{t}\n{line}\n{t[:20]}" if i % 3 == 0 else t) for i, t in rows]
    rows += [(200 + i, rows[5][1]) for i in range(10)]  # copies
    rows += [(220, "é" * 70), (221, "x" + "é" * 70), (222, "a" * 400), (223, "b" + "a" * 700), (224, "\0" * 60), (225, "\0" * 61 + "a")]
    rows += [(230, None), (231, ""), (232, "short"), (None, rows[5][1]), (None, rows[5][1]), (5, rows[5][1]), (233, rows[7][1]), (233, rows[7][1]), (-9, rows[8][1])]
    return rows


@pytest.mark.parametrize(("batches", "piece", "shard", "often"), [(4, 2 << 20, 1 << 20, 64), (7, 1500, 900, 2), (1, 4000, 1 << 20, 1)])
def test_brute_force(spark, monkeypatch, docs_of, corpus, batches, piece, shard, often):
    for name, x in (("PIECE", piece), ("SHARD", shard), ("OFTEN", often)):
        monkeypatch.setattr(suffixes, name, x)
    assert ours(docs_of(corpus), batches) == brute(corpus)


def test_empty_table_and_one_row(spark, docs_of, prose):
    assert ours(docs_of([])) == []
    one = [(1, prose(1, 4000))]
    assert ours(docs_of(one)) == brute(one)
    within = [(1, one[0][1] * 2)]  # a document takes nothing from itself
    assert ours(docs_of(within))[0][2] == []


def test_very_long_texts(spark, docs_of, prose):
    long = prose(9, 60_000)
    rows = [(1, long), (2, "x" + long[1000:250_000] + "y"), (3, prose(10, 50) + long[-5000:])]
    got = {r[0]: r for r in ours(docs_of(rows))}
    assert got[1][2] == [] and got[2][4] == b"xy" and got[3][4] == prose(10, 50).encode()


def test_scratch_is_gone(spark, docs_of, corpus):
    ours(docs_of(corpus))
    assert not [t for t in spark.catalog.listTables() if "pieces" in t.name]


def test_levels_merge_geometrically_and_hold_a_content_once():
    r = np.random.default_rng(0)
    text = r.integers(97, 123, 4000).astype(np.uint8)
    places = np.arange(len(text) - 49)
    order = np.argsort(suffixes._suffixes(text, places), kind="stable")
    level = suffixes.Level(text, places[order])
    again = level.merged(suffixes.Level.read(level.packed()))
    assert len(again.order) == len(level.order)
    s = again.suffixes()
    assert all(bytes(a) < bytes(b) for a, b in zip(s, s[1:]))


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    text = np.frombuffer(b"a" * 30 + bytes(range(97, 117)) + b"b" * 30 + b"z" * 40, np.uint8)
    p = suffixes.Piece(np.array([1], np.int64), np.array([len(text)], np.int64), text)
    same = np.zeros(2, np.uint64)
    monkeypatch.setattr(suffixes, "_BYTE", [np.ones(256, np.uint64)] * 2)  # every byte hashes alike
    s = suffixes.Stretches(p, np.array([0, 30]), np.array([1, 1]), same)
    assert len(s.first) == 2


def test_second_minimizers_only_where_strings_are_split(monkeypatch):
    """Keys are those of the whole text's second minimizers, which are worked out over the split places alone."""
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 40_000).astype(np.uint8)
    piece = suffixes.Piece(np.array([1, 2], np.int64), np.array([25_000, 15_000], np.int64), text)
    marks, _ = piece.marks()
    codes = np.ones(len(marks), np.uint8)
    codes[:: max(1, len(marks) // 20)] = 2
    worked, plain = [], suffixes.minimizers
    monkeypatch.setattr(suffixes, "minimizers", lambda t, which=0: (worked.append(len(t)), plain(t, which))[1])
    got = piece.stretches(marks, codes)
    code = np.where(piece.whole, codes[np.searchsorted(marks, piece.keys).clip(max=len(marks) - 1)], 0)
    keys = np.where(code == 2, suffixes._mixed(piece.keys * np.uint64(3) + plain(text, 1)), piece.keys)
    assert (keys[got.at] == got.keys).all() and got.n.sum() == (code > 0).sum()
    assert sum(worked) < len(text) // 2


def test_verdicts_name_places_so_the_last_pass_hashes_nothing(monkeypatch):
    """Spans come from the places of the verdicts alone: no minimizers, codes or stretches are worked out a second time."""
    rng = np.random.default_rng(5)
    line = rng.integers(97, 123, 90).astype(np.uint8).tobytes()
    docs = [(i, rng.integers(97, 123, 200).astype(np.uint8).tobytes() + line + b"!" * (i % 3)) for i in range(1, 41)] + [(50, b""), (51, b"short"), (52, line[:49])]
    whole = suffixes.Piece(np.array([i for i, _ in docs], np.int64), np.array([len(t) for _, t in docs], np.int64), np.frombuffer(b"".join(t for _, t in docs), np.uint8))
    marks, several = whole.marks()
    s = whole.stretches(marks, several.astype(np.uint8))
    classes = np.arange(len(s.first))
    least, most = np.minimum.reduceat(s.doc, s.first), np.maximum.reduceat(s.doc, s.first)
    found, _ = suffixes.scanned([s.packed(classes, least, most)], [])
    monkeypatch.setattr(suffixes, "minimizers", None)
    row = pa.RecordBatch.from_pylist([{"ids": whole.ids.tobytes(), "sizes": whole.sizes.tobytes(), "text": whole.text.tobytes(), "verdicts": found}])
    (got,) = suffixes._cleaned(iter([row]))
    rows = [(r["id"], r["n_bytes"], r["starts"], r["ends"], r["kept"]) for r in got.to_pylist()]
    assert sorted(rows, key=str) == brute([(i, t.decode()) for i, t in docs])
    assert sum(len(r[2]) for r in rows) == 39


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_places_are_in_the_order_of_their_bytes(monkeypatch, letters):
    rng = np.random.default_rng(letters)
    text = np.tile(rng.integers(97, 97 + letters, 900).astype(np.uint8), 3)
    text[1100] = 255
    places = rng.permutation(len(text) - suffixes.LENGTH + 1)
    want = [text[p : p + suffixes.LENGTH].tobytes() for p in places]
    for narrow in (suffixes._narrow, lambda x, most: x):  # many groups aren't sorted by radix
        monkeypatch.setattr(suffixes, "_narrow", narrow)
        order, new = suffixes._ordered(text, places)
        got = [want[i] for i in order]
        assert got == sorted(want)
        assert new.tolist() == [k == 0 or got[k] != got[k - 1] for k in range(len(got))]
    assert [len(x) for x in suffixes._ordered(text, places[:0])] == [0, 0]


def test_sampled_hashes_that_are_alike_are_told_apart_by_bytes(monkeypatch):
    rng = np.random.default_rng(6)
    text = rng.integers(97, 123, 600).astype(np.uint8)
    text[300:360] = text[100:160]
    piece = suffixes.Piece(np.array([1], np.int64), np.array([len(text)], np.int64), text)
    at, n = np.array([0, 100, 200, 300]), np.full(4, 5)
    assert len(suffixes.Stretches(piece, at, n, np.zeros(4, np.uint64)).first) == 3
    monkeypatch.setattr(suffixes, "_sampled", lambda t, a, z: np.zeros(len(a), np.uint64))
    s = suffixes.Stretches(piece, at, n, np.zeros(4, np.uint64))
    classes = [{text[p : p + 54].tobytes() for p in s.at[a : a + m]} for a, m in zip(s.first, s.count)]
    assert sum(s.count) == 4 and all(len(c) == 1 for c in classes)
