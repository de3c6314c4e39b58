"""Toxicity by compression distance.

Two zstandard dictionaries are trained separately: one on ordinary text, one on
toxic text.  What counts as toxic text is found among the texts labelled so: the
words that many of them show in contexts of their own and few others do (copies
of a text repeat its contexts, so they don't count).  A window is a word, or 64
bytes at every 32nd of a longer one, between two fixed carriers that both dictionaries hold;
without these, zstd stores so short an input as it is.  A window's gain is what
the toxic dictionary saves against the better of the ordinary dictionary and of
the carriers alone.  How many distinct windows reach each of several gains, and
the text's length, go through a logistic scale fitted on labelled texts that
trained no dictionary; it calibrates the thresholds.

Only text and labels of the training rows are looked at: at most
``TRAIN_DOCS`` texts of each label, of at most ``TRAIN_BYTES`` each, chosen by a
hash.  The ordinary dictionary has ``SAMPLES`` samples at most: beyond, words
repeat less often, then a hash chooses them.  Scoring looks at whole texts.

Defined results: a null text is empty; texts without a gain, empty ones too,
all get one score; no labels, or labels of one kind only, give a model that scores 0 (or 1);
rows with one doc_id are scored each; a document with several labels trains with
the largest; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import random
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import broadcast_if_small, pieces

TRAIN_DOCS, TRAIN_BYTES = 2000, 50_000
#: Standard errors by which the toxic texts that show a word must be more, for as many texts, than the others.
SURPLUS = 5.0
LEVEL, WINDOW = 19, 64
ORDINARY_SIZE = 16_384
#: Samples of the ordinary dictionary at most, which bounds the driver's memory.
SAMPLES = 400_000
GAINS = (2, 3, 4, 5, 6, 7)
CARRIER = b"\n0123456789abcdefghijklmnopqrstuvwxyz\n"
WINDOWS_KEPT = 300_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def contents(samples: list[bytes], size: int, seed: int) -> bytes:
    """What a dictionary trained on the samples holds, after its tables, which end with the three offsets 1, 4 and 8."""
    import zstandard

    samples = list(samples)
    random.Random(seed).shuffle(samples)
    try:
        raw = zstandard.train_dictionary(size, samples, k=32, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: they are the dictionary
        return b"".join(dict.fromkeys(samples))[-size:]
    return raw[raw.index(struct.pack("<III", 1, 4, 8)) + 12 :]


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0] * (len(GAINS) + 2))
    bias: float = -50.0

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A model with its compressors and the gains of the windows met so far."""

    def __init__(self, model: Model):
        import zstandard as z

        self.model = model
        self.gains: dict[bytes, int] = {}

        def compressor(held: bytes):
            held += CARRIER
            p = z.ZstdCompressionParameters.from_level(LEVEL, source_size=2 * len(CARRIER) + WINDOW, dict_size=len(held), write_content_size=False, write_checksum=False, write_dict_id=False)
            return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(held, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=p).compress

        self.plain, self.toxic, self.ordinary = map(compressor, (b"", model.toxic, model.ordinary))
        # what windows of each length take if nothing in them repeats: no window takes more
        self.most = [len(self.plain(CARRIER + b" " + bytes(range(128, 128 + n)) + b" " + CARRIER)) for n in range(WINDOW + 1)]

    def gain(self, word: bytes) -> int:
        best = 0
        for at in range(0, max(1, len(word) - WINDOW // 2), WINDOW // 2):  # halves overlap, so that no term is cut
            part = word[at : at + WINDOW]
            x = CARRIER + b" " + part + b" " + CARRIER
            t = len(self.toxic(x))
            if self.most[len(part)] - t > max(best, GAINS[0] - 1):
                best = max(best, min(len(self.plain(x)), len(self.ordinary(x))) - t)
        return best

    def features(self, text: str | None) -> list[float]:
        words = words_of(text)
        own = set(words)
        gains = self.gains
        new = own.difference(gains)
        if len(gains) + len(new) > WINDOWS_KEPT:
            gains = self.gains = {}
            new = own
        for w in new:
            gains[w] = self.gain(w)
        high = [g for g in map(gains.__getitem__, own) if g >= GAINS[0]]
        return [*(float(np.log1p(sum(g >= t for g in high))) for t in GAINS), float(max(high, default=0)), float(np.log1p(len(words))) if high else 0.0]

    def score(self, text: str | None) -> float:
        s = float(np.dot(self.features(text), self.model.weights)) + self.model.bias
        return float(1 / (1 + np.exp(-max(-60.0, min(60.0, s)))))


def contexts(texts: list[str]) -> Counter:
    """How many texts show each word between neighbours that no text before did."""
    seen: set[tuple[bytes, bytes, bytes]] = set()
    count: Counter = Counter()
    for t in texts:
        w = [b"", *words_of(t), b""]
        new = set(zip(w, w[1:], w[2:], strict=False)).difference(seen)
        seen |= new
        count.update({x[1] for x in new})
    return count


def surplus(n: int, a: int, m: int, b: int) -> float:
    """Standard errors between the shares n of a and m of b."""
    p = (n + m) / max(1, a + b)
    return (n / max(1, a) - m / max(1, b)) / max(1e-9, (p * (1 - p) * (1 / max(1, a) + 1 / max(1, b))) ** 0.5)


def ordinary_samples(ordinary: Counter, most: int = SAMPLES) -> list[bytes]:
    """Words as often as they count, 20 times at most; to stay within ``most``, less often, then those of the smallest hashes."""
    times = next((k for k in range(20, 0, -1) if sum(min(n, k) for n in ordinary.values()) <= most), 1)
    words = ordinary if len(ordinary) <= most else sorted(ordinary, key=lambda w: hashlib.blake2b(w, digest_size=8).digest())[:most]
    return [b" " + w + b" " for w in sorted(words) for _ in range(min(ordinary[w], times))]


def fit(rows: list[tuple[str, int, float]], seed: int = 7) -> Model:
    """``rows``: (text, label, weight).  Even rows train the dictionaries, odd ones the scale."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    random.Random(seed).shuffle(rows)
    rows.sort(key=lambda r: r[1])
    model = Model()
    kinds = {r[1] for r in rows}
    if kinds != {0, 1}:
        model.bias = 50.0 if kinds == {1} else -50.0
        return model
    tox, ordinary = contexts([r[0] for r in rows[::2] if r[1]]), contexts([r[0] for r in rows[::2] if not r[1]])
    a, b = sum(r[1] for r in rows[::2]), sum(1 - r[1] for r in rows[::2])
    chosen = [w for w, n in tox.items() if n >= 2 and surplus(n, a, ordinary[w], b) >= SURPLUS]
    samples = [b" " + w + b" " for w in sorted(chosen) for _ in range(min(tox[w], 50))]
    model.toxic = contents(samples, max(1024, 6 * sum(len(w) + 2 for w in chosen)), seed) if samples else b""
    missed = [w for w in sorted(chosen) if b" " + w + b" " not in model.toxic]  # what the trainer's segments left out
    model.toxic += b"".join(b" " + w + b" " for w in missed)
    model.ordinary = contents(ordinary_samples(ordinary), ORDINARY_SIZE, seed)
    scorer = model.scorer()
    x = np.array([scorer.features(r[0]) for r in rows[1::2]])
    y, w = np.array([r[1] for r in rows[1::2]], float), np.array([r[2] for r in rows[1::2]])
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / dev, np.ones(len(x))])
    beta = np.zeros(z.shape[1])
    w = w / w.mean()
    for _ in range(50):  # Newton, with a small penalty
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (w * (p - y)) + 0.5 * beta
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = (beta[:-1] / dev).tolist()
    model.bias = float(beta[-1] - (beta[:-1] * mean / dev).sum())
    return model


def bucket(doc_id: Column, of: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(of))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", training: Column | None = None) -> Model:
    """Fit on a sample of the labelled texts for which ``training`` (of the id column) holds."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.where(training) if training is not None else known
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col)).cast("int").alias("__y"))
    counts = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, TRAIN_DOCS / n) for y, n in counts.items()}
    unit = F.pmod(F.xxhash64("__id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(unit < F.when(F.col("__y") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    few = sum(min(n, 2 * TRAIN_DOCS) for n in counts.values()) + 1
    texts = docs.where(F.octet_length(text_col) <= TRAIN_BYTES).select(F.col(id_col).alias("__id"), F.col(text_col).alias("t"))
    texts = texts.join(broadcast_if_small(chosen, few, 24), "__id")  # TRAIN_DOCS of a label, give or take the hash
    return fit([(r["t"], r["__y"], 1 / share[r["__y"]]) for r in texts.select("t", "__y").collect()])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, all columns kept, that score under the threshold."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in pieces(batches):
            yield b.filter(pa.array([scorer.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
