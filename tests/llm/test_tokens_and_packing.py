"""Ids, the file format, and packing."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import common, packing, tokens


@pytest.fixture(scope="module")
def enc():
    return tokens.WordEncoder(tokens.default_vocabulary())


def ids(enc, text):
    return enc.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sré1²½_-.<|>")), max_size=40))
def test_words_make_the_ids_of_the_text(text):
    e = tokens.encoder(tokens.default_vocabulary())
    assert np.frombuffer(e.documents([text])[0], e.kind).tolist() == [*ids(e, text), 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "</s>", "<s>", "[INST]", "<|end", "of", "text|>", " ", "\n", "it's", "<|", "|>", "日"]), st.text(max_size=6)), max_size=8).map("".join))
def test_ids_are_those_of_the_plain_library_call(text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_vocabulary())
    e = tokens.encoder(tokens.default_vocabulary())
    assert np.frombuffer(e.documents([text])[0], e.kind).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


def test_control_texts_are_single_ids(enc):
    got = np.frombuffer(enc.documents(["a <|endoftext|> b"])[0], enc.kind).tolist()
    assert 50256 in got and len(got) < 8


def test_forgetting_words_changes_nothing(enc, monkeypatch, prose):
    monkeypatch.setattr(tokens, "WORDS_KEPT", 20)
    for k in range(10):
        t = [prose(k, 30) + "\n\n  it's", None, prose(k + 1, 9) + " 12, ('x') 日"]
        assert [np.frombuffer(x, enc.kind).tolist() for x in enc.documents(t)] == [[*ids(enc, x or ""), 2] for x in t]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.integers(0, 70000), max_size=50))
def test_codes_round_trip(codes):
    c = np.array(codes, np.uint32)
    a, b = tokens.pack_codes(c)
    assert (tokens.unpack_codes(a, b, len(c)) == c).all() and len(a) == -(-len(c) // 4)
    d, n, k = tokens.read_shard(tokens.shard_bytes(np.array([7]), np.array([len(c)]), c))
    assert (d.tolist(), n.tolist(), k.tolist()) == ([7], [len(c)], codes)


def test_files(spark, docs_of, prose, enc):
    rows = [(d, prose(d, d % 40)) for d in range(300, -1, -1)] + [(301, None), (302, "日本 <|endoftext|>"), (None, "x"), (5, "again"), (303, prose(9, 20000))]
    folder = common.fresh_dir(spark, "t")
    m = tokens.write_token_files(docs_of(rows), folder, shard_docs=50)
    got = tokens.read_token_files(spark, m, f"{folder}/ranks.u4").orderBy("start").collect()
    assert m.count() > 1 and len(got) == len(rows)
    assert [r["doc_id"] for r in got if r["doc_id"] is not None] == sorted(r[0] for r in rows if r[0] is not None)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = {}
    for d, t in rows:
        raw = np.array([*ids(enc, t or ""), 2], "<u4").tobytes()
        want.setdefault(d, []).append((len(raw) // 4, zlib.crc32(raw)))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_alike_rows_go_to_several_shards(spark, docs_of, enc, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP", 2)
    folder = common.fresh_dir(spark, "t")
    m = tokens.write_token_files(docs_of([(7, "all alike")] * 80).repartition(4), folder, shard_docs=20)
    n = len(ids(enc, "all alike")) + 1
    assert m.count() >= 3 and m.agg({"docs": "max"}).first()[0] <= 40
    assert sorted(r["start"] for r in tokens.read_token_files(spark, m, f"{folder}/ranks.u4").collect()) == [n * k for k in range(80)]


def test_no_documents(spark, docs_of):
    folder = common.fresh_dir(spark, "t")
    m = tokens.write_token_files(docs_of([]), folder)
    assert tokens.read_token_files(spark, m, f"{folder}/ranks.u4").count() == 0
    assert packing.pack_documents(docs_of([])).count() == 0


def check(rows, cap):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= cap.tokens and len(own) <= cap.docs and sum(r["length"] ** 2 for r in own) <= cap.attention
    return len(by)


def test_packing(docs_of, prose, enc):
    rows = [(d, prose(d, (d * 37) % 700)) for d in range(400)] + [(400, None), (401, prose(1, 9000)), (None, "a"), (7, prose(7, 259))]
    got = packing.pack_documents(docs_of(rows), group_docs=100).collect()
    n = check(got, packing.Capacity())
    assert n <= 1.02 * sum(r["length"] for r in got) / 1024 + 6
    of = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == 401)
    all_ids = np.array([*ids(enc, rows[401][1]), 2], "<u4")
    at = 0
    for k, (piece, start, length, crc) in enumerate(of):
        assert (piece, start) == (k, at) and crc == zlib.crc32(all_ids[at : at + length].tobytes()) and (k == 0 or length == 1024)
        at += length
    assert at == len(all_ids)
    assert sum(1 for r in got if r["doc_id"] == 7) == 2 or rows[7][1] != rows[403][1]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("cap", [(100, 3, 10**9), (100, 100, 6000), (100, 4, 5000)])
def test_every_constraint_holds(rule, cap):
    c = packing.Capacity(*cap, rule=rule)
    n = np.random.default_rng(1).integers(1, 60, 500)
    bins, at = packing.pack(n, c)
    rows = [{"sequence_id": b, "offset": o, "length": int(x)} for b, o, x in zip(bins, at, n, strict=True)]
    check(rows, c)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_documents_and_attention_choose_between_sequences(rule):
    """Against a brute force that looks at every open sequence."""
    n = np.random.default_rng(3).integers(1, 900, 300)
    c = packing.Capacity(rule=rule)
    t, d, a = c.tokens, c.docs, c.attention
    open_: list[list[int]] = []
    want = [0] * len(n)
    for i in np.argsort(-n, kind="stable").tolist():
        x = int(n[i])
        scored = []
        for k, (used, docs, att) in enumerate(open_):
            if used + x <= t and docs < d and att + x * x <= a:
                left = ((t - used - x) / t, (d - docs - 1) / d, (a - att - x * x) / a)
                now = (x * (t - used) / t**2, (d - docs) / d**2, x * x * (a - att) / a**2)
                scored.append((sum(w * v * v for w, v in zip(c.weights, left, strict=True)) if rule == "norm" else -sum(w * v for w, v in zip(c.weights, now, strict=True)), k))
        k = min(scored)[1] if scored else len(open_)
        if k == len(open_):
            open_.append([0, 0, 0])
        want[i] = k
        open_[k] = [open_[k][0] + x, open_[k][1] + 1, open_[k][2] + x * x]
    got = packing.pack(n, c)[0]
    assert got.max() + 1 == len(open_)
    kinds = lambda b: sorted(tuple(sorted(n[np.asarray(b) == k].tolist())) for k in range(max(b) + 1))
    assert kinds(got) == kinds(want)
    if rule == "norm":
        assert kinds(got) != kinds(packing.pack(n, packing.Capacity(weights=(1.0, 0.0, 0.0)))[0])


def test_norm_is_best_fit_when_tokens_alone_count():
    c = packing.Capacity(10, 100, 10**6, (1.0, 0.0, 0.0))
    bins, _ = packing.pack(np.array([6, 5, 4, 4, 3]), c)
    assert bins.max() + 1 == 3 and bins[0] == bins[2]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("cap,binds", [((1024, 3, 10**9), "docs"), ((1024, 1024, 20_000), "attention")])
def test_documents_and_attention_bind_when_set_lower(docs_of, prose, rule, cap, binds):
    rows = [(d, prose(d, 5 + d % 20)) for d in range(120)]
    c = packing.Capacity(*cap, rule=rule)
    got = packing.pack_documents(docs_of(rows), capacity=c).collect()
    n = check(got, c)
    free = check(packing.pack_documents(docs_of(rows)).collect(), packing.Capacity())
    assert n > free
    assert n >= (len(got) / 3 if binds == "docs" else sum(r["length"] ** 2 for r in got) / 20_000)
