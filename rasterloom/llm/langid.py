"""Language identification of mixed texts.

A word's script, told by code point ranges, narrows the languages to those whose
training texts use it; each is then scored by log likelihoods of the word under
the language's word counts and, for other words, its character trigrams.  Over
the words of a text, Viterbi with a penalty for each switch finds the best
sequence of languages, whose runs are the labelled spans.  The text's language is
that of most letters.

Training looks at text and non-null language of the training rows only: a
sample of ``TRAIN_DOCS`` texts over all languages, as many of each, chosen by a
hash, of at most ``TRAIN_BYTES`` each; this alone bounds what a model holds.  Prediction looks at whole texts, and at
nothing but the text.

Defined results: ``und`` with score 0 for a null text or one without a letter;
else a learned language; without any training text everything is ``und``; words
without letters belong to the span around them; rows with one doc_id are
predicted each; ties go to the language first by name; only the named columns
are read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import pieces

TRAIN_DOCS, TRAIN_BYTES = 4000, 50_000
SWITCH, WORST, BARRED = 8.0, -6.0, -12.0
WORDS_KEPT = 400_000
#: Of a language in a path.
PLACE = np.int32
UNDETERMINED = "und"
#: First code points of script ranges (fixed values of Unicode): (start, end, script).
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
)
WORD = re.compile(r"[^\W\d_]+")


def script_of(word: str) -> str:
    c = ord(word[0])
    return next((s for a, z, s in SCRIPTS if a <= c <= z), "Other")


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    scripts: dict[str, list[bool]] = field(default_factory=dict)
    words: dict[str, list[float]] = field(default_factory=dict)
    grams: dict[str, list[float]] = field(default_factory=dict)
    floor: list[float] = field(default_factory=list)


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def fit(rows: list[tuple[str, str]], least: int = 5) -> Model:
    """``rows``: (text, language).  Words seen less than ``least`` times in all are too rare for counts: their trigrams score them."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for text, lang in rows:
        counts[lang].update(WORD.findall(text.lower()))
    langs = sorted(k for k, c in counts.items() if c)
    if not langs:
        return Model()
    total = np.array([sum(counts[k].values()) for k in langs], float)
    every: Counter = Counter()
    grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
    scripts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
    for i, k in enumerate(langs):
        every.update(counts[k])
        for w, n in counts[k].items():
            scripts[script_of(w)][i] += n
            for g in trigrams(w):
                grams[g][i] += np.sqrt(n)  # so that a few frequent words don't make the trigrams
    kinds = len(grams)
    all_grams = sum(grams.values())
    log = lambda n, t, v: np.log((n + 0.1) / (t + 0.1 * v))
    words = {w: log(np.array([counts[k][w] for k in langs]), total, len(every)) for w, n in sorted(every.items()) if n >= least}
    return Model(
        langs,
        {s: (n >= 0.01 * total).tolist() for s, n in scripts.items()},
        {w: (v - v.max()).tolist() for w, v in words.items()},
        {g: log(n, all_grams, kinds).tolist() for g, n in grams.items()},
        log(np.zeros(len(langs)), all_grams, kinds).tolist(),
    )


class Tagger:
    """A model with the scores of the words met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.n = len(model.langs)
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, self.n), np.float32)
        self.floor = np.array(model.floor)
        self.grams = {g: np.array(v) for g, v in model.grams.items()}

    def word_scores(self, word: str) -> np.ndarray:
        """Relative to the best language, no worse than ``WORST``; ``BARRED`` where the script doesn't fit."""
        known = self.model.words.get(word)
        s = np.array(known) if known else sum(self.grams.get(g, self.floor) for g in trigrams(word))
        fits = np.array(self.model.scripts.get(script_of(word), [True] * self.n))
        if not fits.any():
            fits[:] = True
        s = np.maximum(s - s[fits].max(), WORST)
        return np.where(fits, s, BARRED)

    def ids(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = set(words).difference(self.at)
            n = len(self.at)
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for k, w in enumerate(new, n):
                self.rows[k] = self.word_scores(w)
                self.at[w] = k
            return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def paths(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The languages of the words of each text.

        Step by step over word places, for all texts that are long enough at once.
        """
        if len(self.at) > WORDS_KEPT:
            self.at.clear()
        ids = [self.ids(w) for w in texts]
        order = sorted(range(len(texts)), key=lambda i: -len(ids[i]))
        sizes = np.array([len(ids[i]) for i in order])
        longest = int(sizes.max(initial=0))
        if not longest:
            return [np.zeros(0, PLACE) for _ in texts]
        live = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with more than t words
        starts = np.concatenate([[0], np.cumsum(live)])
        flat = np.empty(int(starts[-1]), np.int64)  # by place, then text
        for k, i in enumerate(order):
            flat[starts[: sizes[k]] + k] = ids[i]
        best_of = np.zeros(len(flat), PLACE)
        moved = np.zeros((len(flat), self.n), bool)
        state = np.zeros((len(texts), self.n), np.float32)
        last = np.zeros(len(texts), PLACE)
        for t in range(longest):
            a, m = starts[t], live[t]
            now = state[:m]
            top = now.argmax(axis=1)
            jump = now[np.arange(m), top] - SWITCH
            if t:
                best_of[a : a + m] = top
                moved[a : a + m] = jump[:, None] > now
                now = np.maximum(now, jump[:, None])
            state[:m] = now + self.rows[flat[a : a + m]]
            done = live[t + 1] if t + 1 < longest else 0
            last[done:m] = state[done:m].argmax(axis=1)
        tags = np.empty(len(flat), PLACE)
        cur = last.copy()
        for t in range(longest - 1, -1, -1):
            a, m = starts[t], live[t]
            tags[a : a + m] = cur[:m]
            if t:
                go = moved[np.arange(a, a + m), cur[:m]]
                cur[:m] = np.where(go, best_of[a : a + m], cur[:m])
        out: list[np.ndarray] = [np.zeros(0, PLACE)] * len(texts)
        for k, i in enumerate(order):
            out[i] = tags[starts[: sizes[k]] + k]
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) over the characters of a text, from the first letter to the last."""
        found = list(WORD.finditer(text or ""))
        if not found or not self.n:
            return []
        path = self.paths([[m[0].lower() for m in found]])[0]
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        return [(found[a].start(), found[z - 1].end(), self.model.langs[path[a]]) for a, z in zip(cuts, cuts[1:], strict=False)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [WORD.findall(t.lower()) if t and self.n else [] for t in texts]
        langs, scores = [], []
        for w, path in zip(words, self.paths(words), strict=True):
            if not any(any(map(str.isalpha, x)) for x in w):  # numerals beyond 0-9 match like letters
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            letters = np.bincount(path, np.fromiter(map(len, w), np.int64, len(w)), self.n)
            k = int(letters.argmax())
            langs.append(self.model.langs[k])
            scores.append(float(letters[k] / letters.sum()))
        return langs, scores


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", training: Column | None = None) -> Model:
    rows = docs.select(id_col, F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull())
    rows = rows.where(training) if training is not None else rows
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row a language
    each = TRAIN_DOCS / max(1, len(counts))
    share = F.lit(1.0)
    for k, n in counts.items():
        share = F.when(F.col("l") == k, min(1.0, each / n)).otherwise(share)
    unit = F.pmod(F.xxhash64("t"), F.lit(1 << 30)) / float(1 << 30)  # copies are chosen or left together
    chosen = rows.where((F.octet_length("t") <= TRAIN_BYTES) & (unit < share)).select("t", "l").distinct()
    return fit([(r["t"], r["l"]) for r in chosen.collect()])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for b in pieces(batches):
            langs, scores = tagger.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def label_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, lang): the labelled spans of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for b in pieces(batches):
            rows = [(d, *s) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s in tagger.spans(t)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "start", "end", "lang"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, start long, end long, lang string")
