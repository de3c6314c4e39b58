"""SimHash near-duplicates with Golay-code fuzzy hashing.

``fingerprint_groups`` (64 bits, exact): equal fingerprints are one node.  The
64 bits are cut into three segments.  Two fingerprints that differ in at most
two bits have, by pigeonhole, a segment without an error followed (cyclically)
by one with at most one: the first is taken as it is, the second by its Golay
codeword indices, which gives a home key and up to six keys to look it up by.
Joined keys are verified by counting bits.  Keys with many nodes aren't paired
up: their nodes meet instead in the 65 fingerprints within one bit of each, of
which two nodes share one if and only if they differ in two bits or less, and
at most 65 nodes share any; so no link is lost and rows stay linear.

``near_duplicate_groups`` (similarity 0.8 of five-word shingle sets): texts of equal
word sequences are one node, with a 184-bit SimHash of its distinct words in eight
segments.  A key is the Golay homes of two segments with one of the up to six
codeword indices near a third; the nodes of a key are compared with the smallest.
The fingerprints of alike texts can differ in any number of bits, so no set of
Golay keys reaches every pair.  Shingles are keys too, then: in any one order of all
shingles, two sets of similarity t share one among the first n - ceil(t n) + 1 of
either (n its size).  A sample shows which are frequent, and these come last in the
order, else it is a hash.  In each key whose nodes are in several components one node
is compared with the others, first that with the largest share of shared keys (together
with the Golay keys' pairs), in the next round another one, until a round adds next to
no links (``SETTLED``).  Where a key still has nodes in several components, those that the
leaders didn't bring together meet each other, by classes of size, and the pairs that sizes
and parities don't rule out are compared.  So every pair of similar texts shares a key, and
in that key its ends are in one component or are compared: no link is lost.  Sizes and parities of shingle sets rule candidates out
first, by bounds that hold for every pair; the rest are compared by their whole sets.

Defined results: null texts count as empty; texts without words are equal; rows
that share a doc_id are one document where one of a group is to stay; rows with
a null doc_id are linked to nothing and stay; an empty table gives no rows;
only the named columns are read, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import golay
from rasterloom.llm.common import Scratch, broadcast_if_small, let_go, materialize, pieces, unused
from rasterloom.llm.graph import components

SEED = 42
#: Nodes of a key that are paired up; keys of more go by the exact linear way.
PAIRED = 16
#: Segments of a fingerprint of shingle sets, and its bytes; longs of parity bits.
SEGMENTS, WIDE, PARITY = 8, 23, 8
#: Longs of parity bits of pairs that the leaders left unmet.
BROAD = 64
#: Rounds of leaders end when one adds no more than this share of the links; a last step finds what they leave.
SETTLED = 0.001
#: One document of so many shows which shingles are frequent, and at most so many are sent; both only settle an order, never a result.
SAMPLE, FREQUENT = 8, 200_000
WORDS_KEPT = 300_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between blanks; bytes.lower and bytes.split are just that on UTF-8."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every ``size``-word shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    from xxhash import xxh64_intdigest as h

    if len(words) <= size:
        return np.array([h(b" ".join(words), SEED)] if words else [], np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    return np.array([h(text[a:z], SEED) for a, z in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def ones(rows: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows of bytes; sums of 255 rows fit a byte."""
    total = np.zeros(rows.shape[1] * 8, np.int64)
    for at in range(0, len(rows), 255 * 256):
        bits = np.unpackbits(rows[at : at + 255 * 256], axis=1)
        for k in range(0, len(bits), 255):
            total += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return total


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if over half of the hashes set it; 0 without hashes."""
    if not len(hashes):
        return 0
    n = ones(hashes.astype(">u8").view(np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits(2 * n > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp long): 64-bit fingerprints, as signed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fps = [fingerprint(shingle_hashes(words_of(t), size)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, fp long")


#: (shift, bits) of the three segments.
CUTS = ((0, 22), (22, 21), (43, 21))


def fingerprint_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, fp, home): three home keys of each fingerprint and all keys it is looked up by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4096):
            node = b.column(0).to_numpy(zero_copy_only=False)
            fp = b.column(1).to_numpy(zero_copy_only=False)
            seg = [(fp >> s & (1 << n) - 1) for s, n in CUTS]
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for i in range(3):
                near = golay.keys(seg[(i + 1) % 3])
                for k in range(near.shape[1]):
                    at = near[:, k] >= 0
                    key = (i << 34) | (seg[i][at] << golay.INFO) | near[at, k]
                    for c, x in zip(cols, (key, node[at], fp[at], np.full(len(key), k == 0)), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["key", "node", "fp", "home"])

    return nodes.select("node", "fp").mapInArrow(run, "key long, node long, fp long, home boolean")


def fingerprint_links(nodes: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): links between nodes whose fingerprints differ in at most ``bits`` (0 to 2) bits, enough of them to keep every component."""
    if not 0 <= bits <= 2:
        raise ValueError("bits: 0 to 2")
    keys = materialize(fingerprint_keys(nodes), "keys")
    size = keys.groupBy("key").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where((F.col("n") > 1) & (F.col("homes") > 0))
    shared = materialize(keys.join(size, "key"), "shared")
    few = shared.where(F.col("n") <= PAIRED)
    a = few.where("home").select("key", F.col("node").alias("a"), F.col("fp").alias("fa"))
    b = few.select("key", F.col("node").alias("b"), F.col("fp").alias("fb"))
    pairs = a.join(b, "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= bits))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    many = shared.where(F.col("n") > PAIRED).select("node", "fp").distinct()
    if bits < 2:  # meeting within one bit isn't enough then: meet at the fingerprint, or at it and one-bit neighbours of one side
        flips = F.array(F.lit(0).cast("long"), *([F.lit(1 << k).cast("long") if k < 63 else F.lit(-(1 << 63)).cast("long") for k in range(64)] if bits else []))
        to = many.select(F.col("node").alias("a"), F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("fp"))
        star = to.join(many.select(F.col("node").alias("b"), "fp"), "fp").where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    else:
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") if k < 63 else F.lit(-(1 << 63)).cast("long") for k in range(64)])
        meet = many.select("node", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("at"))
        first = meet.groupBy("at").agg(F.min("node").alias("a"), F.count("*").alias("n")).where(F.col("n") > 1).select("at", "a")
        star = meet.join(first, "at").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b"))
    return pairs.union(star).distinct()


def fingerprint_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint hex, component_id): the smallest doc_id reachable over links of at most ``bits`` bits."""
    fps = materialize(fingerprints(docs, id_col, text_col, size), "fp")
    nodes = fps.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node"))
    nodes = materialize(nodes, "nodes")
    # a doc_id with several fingerprints joins them, as it is one document
    several = fps.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where(F.col("lo") != F.col("hi"))
    same = fps.join(several.select("doc_id"), "doc_id").join(nodes, "fp").select(F.least("doc_id", "node").alias("a"), F.greatest("doc_id", "node").alias("b")).where(F.col("a") != F.col("b"))
    found = components(fingerprint_links(nodes, bits).union(same))
    final = nodes.join(found, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    out = fps.join(final, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# ---- similarity of shingle sets --------------------------------------------


class WordBits:
    """Wide hashes of words, kept for the words met so far."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((1 << 12, WIDE), np.uint8)

    def __call__(self, words: set[bytes]) -> np.ndarray:
        from xxhash import xxh3_128_digest as h

        if len(self.at) > WORDS_KEPT:
            self.at.clear()
        new = [w for w in words if w not in self.at]
        if new:
            n = len(self.at)
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[n : n + len(new)] = np.frombuffer(b"".join((h(w, 1) + h(w, 2))[:WIDE] for w in new), np.uint8).reshape(-1, WIDE)
            self.at |= {w: n + i for i, w in enumerate(new)}
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(words_of(text), size))


def parity(hashes: np.ndarray, longs: int = PARITY) -> np.ndarray:
    """``longs`` longs whose bits say whether an odd number of the hashes fall on them.

    A shingle that only one of two sets holds changes one bit, so the bits in which
    two sets differ are never more than the shingles in which they differ.
    """
    odd = np.bincount((hashes % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix(hashes: np.ndarray, frequent: np.ndarray, least: float) -> np.ndarray:
    """The first n - ceil(least n) + 1 of the hashes, in an order that is the same for all sets: frequent ones last."""
    if not len(hashes):
        return hashes
    often = np.isin(hashes, frequent, assume_unique=True)
    return np.concatenate([hashes[~often], hashes[often]])[: len(hashes) - int(np.ceil(least * len(hashes) - 1e-9)) + 1]


SIGNED = "doc_id long, s1 long, s2 long, n int, sig binary, " + ", ".join(f"p{k} long" for k in range(PARITY)) + ", keys array<long>"


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, least: float) -> DataFrame:
    """One pass over the texts of non-null ids: hash of the word sequence (s1, s2), number of distinct shingles,
    SimHash of the distinct words, parities of the shingles, and the shingles that are keys."""
    frequent = frequent_shingles(docs, id_col, text_col, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        bits = WordBits()
        for b in pieces(batches, 256):
            same, n, sig, par, keys = [], [], [], [np.zeros((0, PARITY), np.int64)], [np.array([], np.uint64)]
            for t in b.column(1).to_pylist():
                w = words_of(t)
                u = set(w)
                h = np.unique(shingle_hashes(w, size))
                same.append(xxh3_128_digest(b" ".join(w)))
                n.append(len(h))
                sig.append(np.packbits(2 * ones(bits(u)) > len(u)).tobytes() if u else bytes(WIDE))
                par.append(parity(h)[None])
                keys.append(prefix(h, frequent, least))
            s = np.frombuffer(b"".join(same), np.int64).reshape(-1, 2)
            p = np.concatenate(par)
            ends = np.cumsum([len(k) for k in keys])
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            cols = [b.column(0), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(PARITY)), held]
            yield pa.RecordBatch.from_arrays(cols, [x.split(" ")[0] for x in SIGNED.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).where(F.col("doc_id").isNotNull()).mapInArrow(run, SIGNED)


def frequent_shingles(docs: DataFrame, id_col: str, text_col: str, size: int) -> np.ndarray:
    """Sorted hashes of shingles that many documents of a sample hold: a hint for the order of keys, so bounds in it lose no pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [shingle_set(t, size) for t in b.column(0).to_pylist()]
            h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.array([], np.uint64), np.array([], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

    sample = docs.where(F.pmod(F.xxhash64(id_col), F.lit(SAMPLE)) == 0).select(F.col(text_col).cast("string"))
    seen = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= SAMPLE)
    return np.sort(np.array([r["h"] for r in seen.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()], np.int64).view(np.uint64))


def segment_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): for each segment the homes of it and of the next one, with each of the Golay indices near the one after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2048):
            node = b.column(0).to_numpy(zero_copy_only=False)
            bits = np.unpackbits(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, WIDE), axis=1)
            words = bits.reshape(len(node), SEGMENTS, golay.LENGTH).astype(np.int64) @ (1 << np.arange(golay.LENGTH))
            at = golay.home(words)
            keys, of = [], []
            for i in range(SEGMENTS):
                near = golay.keys(words[:, (i + 2) % SEGMENTS])
                head = (i << golay.INFO | at[:, i]) << golay.INFO | at[:, (i + 1) % SEGMENTS]
                row, k = np.nonzero(near >= 0)
                keys.append(head[row] << golay.INFO | near[row, k])
                of.append(node[row])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(of))], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted distinct arrays; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


@dataclass(frozen=True)
class Verifier:
    """Compares candidates (a, b) of ``nodes`` (node, n, p0...) by the shingle sets of their texts."""

    nodes: DataFrame
    n_nodes: int
    docs: DataFrame
    id_col: str
    text_col: str
    size: int
    least: float

    def near(self) -> Column:
        """What sizes (n_a, n_b) and parities (a0..., b0...) say of a pair: no pair of ``least`` is ruled out."""
        apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(PARITY)), F.lit(0))
        return (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(self.least) - 1e-6) & (apart <= (F.col("n_a") + F.col("n_b")) * F.lit((1 - self.least) / (1 + self.least)) + 1e-6)

    def unmet(self, rest: DataFrame, scratch: Scratch) -> DataFrame:
        """(a, b): the pairs of two components in one key of ``rest`` (key, node, comp) that sizes and parities don't rule out, each once.

        Keys are split by size first: class g and the one below meet, as sets of ``least`` differ in
        size by one class at most.  The test is a condition of the join, so only what passes becomes a row.
        """
        several = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
        rest = scratch.keep(rest.join(several, "key"), "rest")
        ends = rest.select("node").distinct()
        told = scratch.keep(self.nodes.select("node", "n", *[f"p{k}" for k in range(PARITY)]).join(ends, "node", "left_semi"), "told")
        size = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.log(F.lit(1 / self.least)) + F.lit(1e-9))
        classed = rest.join(broadcast_if_small(told, told.count(), 12 + 8 * PARITY), "node").withColumn("size", size).withColumn("class", F.explode(F.array(F.col("size"), F.col("size") + 1)))
        named = lambda e: classed.select("key", "class", F.col("node").alias(e), F.col("comp").alias(f"comp_{e}"), F.col("size").alias(f"size_{e}"), F.col("n").alias(f"n_{e}"), *[F.col(f"p{k}").alias(f"{e}{k}") for k in range(PARITY)])
        fits = (F.col("x.a") < F.col("y.b")) & (F.col("x.comp_a") != F.col("y.comp_b")) & (F.greatest("x.size_a", "y.size_b") == F.col("x.class")) & self.near()
        pairs = named("a").alias("x").hint("merge").join(named("b").alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.class") == F.col("y.class")) & fits)
        return scratch.keep(pairs.select("a", "b").distinct(), "unmet")

    def candidates(self, pairs: DataFrame, scratch: Scratch) -> DataFrame:
        """Distinct pairs that sizes and parities don't rule out; neither test loses a pair of ``least``."""
        named = lambda end: broadcast_if_small(self.nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), *[F.col(f"p{k}").alias(f"{end}{k}") for k in range(PARITY)]), self.n_nodes, 12 + 8 * PARITY)
        near = self.near()
        both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return scratch.keep(both.join(named("a"), "a").join(named("b"), "b").where(near).select("a", "b").distinct(), "close")

    def texts(self, pairs: DataFrame, n: int) -> DataFrame:
        """(node, text) of the ends of ``n`` pairs."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        texts = self.docs.select(F.col(self.id_col).cast("long").alias("node"), F.col(self.text_col).cast("string").alias("text"))
        return texts.join(broadcast_if_small(ends, 2 * n, 16), "node", "left_semi")

    def closer(self, pairs: DataFrame, scratch: Scratch) -> DataFrame:
        """The pairs that parities on ``BROAD`` bits don't rule out either: half a kilobyte an end, where texts may take many."""
        size, least = self.size, self.least

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 256):
                sets = [shingle_set(t, size) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array([parity(h, BROAD).tobytes() for h in sets], pa.binary())], ["node", "n", "odd"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 2048):
                odd = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("x", "y")]
                apart = np.bitwise_count(odd[0] ^ odd[1]).sum(axis=1)
                n = b.column("n").to_numpy(zero_copy_only=False)
                at = pa.array(np.flatnonzero(apart <= n * (1 - least) / (1 + least) + 1e-6), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], ["a", "b"])

        sketches = scratch.keep(self.texts(pairs, pairs.count()).mapInArrow(sketch, "node long, n long, odd binary"), "sketches")
        both = pairs.join(sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("odd").alias("y")), "b").join(sketches.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("odd").alias("x")), "a")
        return scratch.keep(both.select("a", "b", "x", "y", (F.col("n_a") + F.col("n_b")).alias("n")).mapInArrow(run, "a long, b long"), "closer")

    def links(self, pairs: DataFrame, into: Scratch) -> DataFrame:
        """The pairs that are alike, kept in ``into``."""
        with Scratch() as scratch:
            close = self.candidates(pairs, scratch)
            n = close.count()
            texts = scratch.keep(self.texts(close, n), "texts")
            size, least = self.size, self.least

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                last: tuple[str | None, np.ndarray] = ("", np.array([], np.uint64))
                for b in pieces(batches, 256):
                    keep = []
                    for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                        if x != last[0]:  # rows of one end follow each other
                            last = (x, shingle_set(x, size))
                        keep.append(similarity(last[1], shingle_set(y, size)) >= least)
                    at = pa.array(np.flatnonzero(keep), pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

            both = close.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
            return into.keep(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, group_id), materialised: for every non-null doc_id the smallest doc_id of its group."""
    with Scratch() as scratch:
        sigs = scratch.keep(signatures(docs, id_col, text_col, size, least), "sigs")
        ids = scratch.keep(sigs.groupBy("s1", "s2").agg(F.min("doc_id").alias("node")), "ids")
        n = ids.count()
        same = ["s1", "s2"]
        own = sigs.withColumnRenamed("doc_id", "node").join(broadcast_if_small(ids, n, 32), [*same, "node"], "left_semi")
        nodes = scratch.keep(own.drop("keys", *same), "nodes")
        verifier = Verifier(nodes, n, docs, id_col, text_col, size, least)
        # a doc_id with several texts joins them, as it is one document
        apart = sigs.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in same for f in (F.min, F.max)]).where((F.col("min_s1") != F.col("max_s1")) | (F.col("min_s2") != F.col("max_s2")))
        links = scratch.keep(sigs.join(apart.select("doc_id"), "doc_id").join(ids, same).where(F.col("doc_id") != F.col("node")).select(F.col("node").alias("a"), F.col("doc_id").alias("b")), "several")

        keys = segment_keys(nodes)
        first = scratch.keep(keys.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("times")).where(F.col("times") > 1).select("key", "a"), "first")
        pairs = keys.join(broadcast_if_small(first, first.count(), 24), "key").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"))

        keys = own.select("node", "n", F.explode("keys").alias("key"))
        several = scratch.keep(keys.groupBy("key").agg(F.count("*").alias("times")).where(F.col("times") > 1).select("key"), "several")
        shared = scratch.keep(keys.join(several, "key"), "shared")
        # a node whose keys are all shared stands in the middle of its group, so it leads in its keys
        rank = shared.groupBy("node").agg((F.floor(F.count("*") * 100_000 / (F.max("n") * F.lit(1 - least) + 1)) * (1 << 40) + F.pmod(F.xxhash64("node"), F.lit(1 << 40))).alias("rank"))
        open_ = shared.select("key", "node").join(rank, "node").withColumn("comp", F.col("node"))
        total, found = 0, None
        while True:
            open_ = scratch.keep(open_, "open")
            lead = open_.groupBy("key").agg(F.max_by("node", "rank").alias("a"), F.max_by("comp", "rank").alias("comp_a"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi"))
            star = scratch.keep(open_.join(lead, "key").where(F.col("node") != F.col("a")).select("key", "node", "rank", "comp", "a", "comp_a"), "star")
            met = star.where(F.col("comp") != F.col("comp_a")).select("a", F.col("node").alias("b"))
            more = verifier.links(met if total else pairs.union(met), scratch)
            n_more = more.count()
            total += n_more
            if n_more or found is None:
                # what is joined up already goes on as one link a node
                known = links if found is None else found.where(F.col("node") != F.col("label")).select(F.col("label").alias("a"), F.col("node").alias("b"))
                found = components(known.union(more), scratch)
            let_go(docs.sparkSession)
            if n_more <= total * SETTLED:
                break
            open_ = star.select("key", "node", "rank").join(found, "node", "left").select("key", "node", "rank", F.coalesce("label", "node").alias("comp"))
        rest = star.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("label", "node").alias("comp"))
        unmet = verifier.unmet(rest, scratch)
        if unmet.limit(1).count():
            more = verifier.links(verifier.closer(unmet, scratch), scratch)
            found = components(found.where(F.col("node") != F.col("label")).select(F.col("label").alias("a"), F.col("node").alias("b")).union(more), scratch)
        groups = ids.join(found, "node", "left").select(*same, F.coalesce("label", "node").alias("group_id"))
        return materialize(sigs.select("doc_id", *same).join(groups, same).groupBy("doc_id").agg(F.min("group_id").alias("group_id")), "groups")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents less all but the smallest doc_id of each group, all columns kept."""
    gone = unused(docs, "gone")
    copies = near_duplicate_groups(docs, id_col, text_col, **how).where(F.col("doc_id") != F.col("group_id")).select(F.col("doc_id").alias(gone))
    copies = broadcast_if_small(copies, copies.count(), 16)
    return docs.join(copies, docs[id_col].cast("long") == F.col(gone), "left_anti")
