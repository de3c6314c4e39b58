"""Held-out accuracy and the defined cases of language identification and toxicity."""

from __future__ import annotations

import random
import zlib

import pytest
from support import DATA
from pyspark.sql import functions as F

from rasterloom.llm import langid, toxicity

MEDIUM = DATA.replace("0.001", "0.1")
LANGS = {"aa": "ba de ki lo mu na".split(), "bb": "po ri su te vo za".split(), "cc": "привет мир да".split()}


def text_in(lang, seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice(LANGS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def tagger():
    return langid.fit([(text_in(k, s), k) for k in LANGS for s in range(20)])


def test_spans_of_mixed_text(tagger):
    t = langid.Tagger(tagger)
    mixed = f"{text_in('aa', 100)} -- {text_in('bb', 101)}! {text_in('cc', 102)}"
    spans = t.spans(mixed)
    assert [s[2] for s in spans] == ["aa", "bb", "cc"]
    assert mixed[spans[1][0] : spans[1][1]] == text_in("bb", 101)
    assert t.spans("123 !?") == t.spans(None) == t.spans("") == []


def test_a_foreign_word_does_not_switch(tagger):
    w = text_in("aa", 200).split()
    w[30] = "za"
    assert {s[2] for s in langid.Tagger(tagger).spans(" ".join(w))} == {"aa"}


def test_scripts_narrow(tagger):
    t = langid.Tagger(tagger)
    assert t.predict(["Незнакомое слово"])[0] == ["cc"]
    assert t.predict(["日本語"])[0][0] in LANGS  # nothing is learned of this script: all languages stay


def viterbi(model, words):
    """Every path, the slow way."""
    t = langid.Tagger(model)
    score = [float(x) for x in t.word_scores(words[0])]
    back = []
    for w in words[1:]:
        best = max(range(t.n), key=lambda k: (score[k], -k))
        s = t.word_scores(w)
        came = [best if score[best] - langid.SWITCH > score[k] else k for k in range(t.n)]
        score = [max(score[k], score[best] - langid.SWITCH) + float(s[k]) for k in range(t.n)]
        back.append(came)
    k = max(range(t.n), key=lambda k: (score[k], -k))
    path = [k]
    for came in reversed(back):
        k = came[k]
        path.append(k)
    return path[::-1]


def test_the_batched_search_is_viterbi(tagger):
    texts = [f"{text_in('aa', s, s % 7)} {text_in('bb', s, s % 5)} {text_in('aa', s + 9, 3)}".split() for s in range(30)]
    for w, path in zip(texts, langid.Tagger(tagger).paths(texts), strict=True):
        assert path.tolist() == viterbi(tagger, w)


def test_language_rows(spark, docs_of):
    rows = [(d, text_in(k, d), "s", k) for d, k in enumerate(list(LANGS) * 30)] + [(500, None, "s", "aa"), (501, "1 2 3", "s", "aa"), (504, "½ ²", "s", None), (502, "ba de", "s", None), (503, text_in("bb", 1, 30000), "s", None), (502, "ba de", "s", None)]
    docs = docs_of(rows)
    m = langid.train(docs, training=F.col("doc_id") % 4 != 2)
    got = langid.identify(docs, m).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by[500] == by[501] == by[504] == ("und", 0.0) and by[503][0] == "bb" and all(by[d][0] == k for d, _, _, k in rows[:90])
    assert all(0 <= s <= 1 for _, s in by.values())
    spans = langid.label_spans(docs, m)
    assert spans.where("doc_id = 500").count() == 0 and spans.where("doc_id = 503").count() == 1
    none = langid.train(docs_of([]))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs_of([]), m).count() == 0


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    m = langid.train(docs, training=toxicity.bucket(F.col("doc_id"), 4) != 2)
    d = langid.identify(docs, m).join(docs.select("doc_id", "lang"), "doc_id").where((toxicity.bucket(F.col("doc_id"), 4) == 2) & F.col("lang").isNotNull())
    assert d.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_the_bucket_is_the_crc_of_the_decimal_text(spark):
    got = {r[0]: r[1] for r in spark.range(200).select("id", toxicity.bucket(F.col("id"), 5)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(200)}


BAD = ["snarf", "grobble", "zutwix"]


def said(seed, bad, n=80):
    w = text_in("aa", seed, n).split()
    if bad:
        w[seed % n] = BAD[seed % 3]
    return " ".join(w)


@pytest.fixture(scope="module")
def judge():
    return toxicity.fit([(said(s, s % 2), s % 2, 1.0) for s in range(600)])


def test_rare_bad_words_are_found(judge):
    s = judge.scorer()
    got = [s.score(said(s_, s_ % 2)) >= 0.5 for s_ in range(1000, 1200)]
    assert sum(g == bool(k % 2) for g, k in zip(got, range(1000, 1200), strict=True)) >= 196


def test_toxicity_cases(judge):
    s = judge.scorer()
    assert 0 <= s.score(None) == s.score("") < 0.5
    assert 0 <= s.score("y" * 500_000) <= 1
    assert s.score(said(3, True) + " " + text_in("aa", 5, 3000)) > s.score(text_in("aa", 5, 3000))
    assert toxicity.fit([]).scorer().score("x") < 0.5 and toxicity.fit([("x", 1, 1.0)]).scorer().score("x") > 0.5


def test_forgetting_windows_changes_nothing(judge, monkeypatch):
    a = [judge.scorer().score(said(k, k % 2)) for k in range(10)]
    monkeypatch.setattr(toxicity, "WINDOWS_KEPT", 10)
    s = judge.scorer()
    assert [s.score(said(k, k % 2)) for k in range(10)] == a


def test_the_bound_on_plain_windows_holds(judge):
    s = judge.scorer()
    for k in range(2000):
        w = random.Random(k).randbytes(random.Random(k).randint(1, 64)).replace(b" ", b"x")
        assert len(s.plain(toxicity.CARRIER + b" " + w + b" " + toxicity.CARRIER)) <= s.most[len(w)]


def test_toxicity_rows(spark, docs_of):
    rows = [(d, said(d, d % 2)) for d in range(500)] + [(600, None), (601, ""), (3, "again"), (None, "none")]
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(500)] + [(3, 1, 0), (None, 1, 0), (600, None, 1)], "doc_id long, toxic int, quality int")
    docs = docs_of(rows)
    m = toxicity.train(docs, labels)
    got = toxicity.score(docs, m).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.reject(docs, m)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {600, 601}
    assert toxicity.score(docs_of([]), m).count() == 0 and toxicity.reject(docs_of([]), m).count() == 0


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    b = toxicity.bucket(F.col("doc_id"), 5)
    m = toxicity.train(docs, labels, training=b != 0)
    d = toxicity.score(docs, m).join(labels.select("doc_id", "toxic"), "doc_id").where(b == 0).where("toxic is not null")
    r = d.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int")).alias("a"), (F.count_if((F.col("score") >= 0.5) & (F.col("toxic") == 1)) / F.count_if(F.col("toxic") == 1)).alias("r")).first()
    assert r["a"] > 0.96 and r["r"] > 0.85


def test_ordinary_samples_leave_out_no_end_of_the_alphabet():
    count = toxicity.Counter({f"{c}{k}".encode(): 1 + k % 30 for c in "abyzéя" for k in range(200)})
    whole, few, fewest = (toxicity.ordinary_samples(count, n) for n in (400_000, 3000, 600))
    assert whole == [b" " + w + b" " for w in sorted(count) for _ in range(min(count[w], 20))]
    assert len(few) <= 3000 and set(few) == set(whole)
    assert len(fewest) == 600 and all(60 < sum(s.decode()[1] == c for s in fewest) < 140 for c in "abyzéя")
