"""Token ids, and their binary file format.

Encoding: ``WordEncoder`` cuts a text as the vocabulary's own pre-tokenizer does
and keeps the ids of each word it has met, as a BPE never merges across words;
words met first are encoded by the tokenizers library, many in one call, and so
are whole texts with added tokens (control texts) or characters for which the cut isn't certain.

File format (``.rlti``), one file a shard, shards in ascending document order:
a header of magic, number of documents and of ids, then a control byte stream
(two bits an id: the bytes its code takes, 1 to 4), then the data stream (codes,
little-endian).  A code is the frequency rank of the id in the whole corpus, so
frequent ids take one byte; the rank table is a file of its own beside the
shards.  Decoding looks up, for each control byte, the lengths of its four
codes in a 256-row numpy table; no code is visited in Python.

Files are written on the executors with pyarrow's filesystems into the shared
folder, under names that depend on the shard alone and by a rename, so a lost or
repeated task leaves the same files.

Defined results: a null text is empty and has just the end id; documents of
one doc_id follow each other in the order of a hash of their ids; a null doc_id
comes first and is written as the least integer; an empty table gives
no shards and no rows; only the named columns are read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import MOST_TASKS, drop_written, fresh_dir, materialize, pieces

END_ID = 2
#: Stands for a null doc_id in the files.
NO_ID = -(1 << 63)
MAGIC = b"RLTI\x01\x00\x00\x00"
#: Words that an encoder keeps at most before it starts anew; bounds memory, not what is encoded.
WORDS_KEPT = 1_000_000
#: Documents whose words are cut and learnt together.
TOGETHER = 128


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Letters that a plain text may hold; in such a text the pattern below cuts as the vocabulary's own does.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = re.compile("[\\t\\n\\r\x20-\x7e¡-©«-±´¶-¸»¿-ɏ‐-‧€]*")
WORD = re.compile(f" ?[{LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\\s{LETTERS}0-9]+|\\s+(?!\\S)|\\s+", re.A)


class WordEncoder:
    """Ids of whole texts as little-endian bytes of numpy's ``kind``: two an id where the vocabulary allows, else four.

    Texts with characters beyond ``PLAIN``, or that hold one of the vocabulary's added tokens, go to the tokenizer as they are.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(vocabulary)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None  # cut out of a text before its words are
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.kept: dict[str, bytes] = {}
        self.blank = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        self.blank[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True  # ids that start with a blank
        self.newline = self.ids("\n").tolist()[0]
        self.end = np.array([END_ID], self.kind).tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)

    def learn(self, words: Iterable[str]) -> None:
        """One call encodes all words of a kind: a blank ahead keeps a word's bounds, and so do lines between the others."""
        led, plain = [], []
        for w in words:
            if w.isspace():
                self.kept[w] = self.ids(w).tobytes()
            else:
                (led if w[0] == " " else plain).append(w)
        if led:
            ids = self.ids("".join(led))
            starts = np.flatnonzero(self.blank[ids])
            self.keep(led, ids, starts, np.append(starts[1:], len(ids)))
        if plain:
            ids = self.ids("\n".join(plain))
            cuts = np.flatnonzero(ids == self.newline)
            self.keep(plain, ids, np.append(0, cuts + 1), np.append(cuts, len(ids)))

    def keep(self, words: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(starts) != len(words):  # the bounds can't be told
            self.kept |= {w: self.ids(w).tobytes() for w in words}
            return
        raw, size = ids.tobytes(), ids.itemsize
        self.kept.update(zip(words, [raw[a:z] for a, z in zip((size * starts).tolist(), (size * ends).tolist(), strict=True)], strict=True))

    def documents(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids and the end id; the words that haven't been met are learnt together."""
        words = [WORD.findall(t) if PLAIN.fullmatch(t) and not (self.added and self.added.search(t)) else None for t in (t or "" for t in texts)]
        every = set().union(*filter(None, words))
        new = every.difference(self.kept)
        if len(self.kept) + len(new) > WORDS_KEPT:
            self.kept.clear()
            new = every
        self.learn(new)
        of = self.kept.__getitem__
        return [(self.ids(t or "").tobytes() if w is None else b"".join(map(of, w))) + self.end for t, w in zip(texts, words, strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """One encoder a worker process."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = WordEncoder(vocabulary)
    return _encoders[vocabulary]


# ---- the coding -------------------------------------------------------------

#: Bytes of the four codes that a control byte stands for.
LENGTHS = (1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)).astype(np.uint8)


def pack_codes(codes: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit codes."""
    codes = np.ascontiguousarray(codes, dtype="<u4")
    more = (codes > 0xFF).view(np.uint8) + (codes > 0xFFFF).view(np.uint8) + (codes > 0xFFFFFF).view(np.uint8)
    at = np.cumsum(more, dtype=np.int64) - more + np.arange(len(codes))
    data = np.empty(len(codes) + int(more.sum(dtype=np.int64)), np.uint8)
    raw = codes.view(np.uint8).reshape(-1, 4)
    data[at] = raw[:, 0]
    for k in range(1, int(more.max(initial=0)) + 1):
        long = np.flatnonzero(more >= k)
        data[at[long] + k] = raw[long, k]
    more = np.concatenate([more, np.zeros(-len(more) % 4, np.uint8)]).reshape(-1, 4)
    return (more[:, 0] | more[:, 1] << 2 | more[:, 2] << 4 | more[:, 3] << 6).tobytes(), data.tobytes()


def unpack_codes(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The codes again: lengths by table lookup, then a gather for each byte place."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data, np.uint8)
    codes = raw[at].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=0))):
        long = np.flatnonzero(lengths > k)
        codes[long] |= raw[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return codes


def shard_bytes(doc_ids: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> bytes:
    control, data = pack_codes(codes)
    head = MAGIC + struct.pack("<QQQQ", len(doc_ids), len(codes), len(control), len(data))
    return head + np.asarray(doc_ids, "<i8").tobytes() + np.asarray(counts, "<u8").tobytes() + control + data


def read_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, counts, codes)."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, c, d = struct.unpack_from("<QQQQ", raw, 8)
    at = 40
    ids = np.frombuffer(raw, "<i8", docs, at)
    counts = np.frombuffer(raw, "<u8", docs, at + 8 * docs)
    at += 16 * docs
    return ids, counts, unpack_codes(raw[at : at + c], raw[at + c : at + c + d], n)


# ---- files ------------------------------------------------------------------


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, raw: bytes) -> None:
    """Whole or not at all: written beside and renamed."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    beside = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(beside) as f:
        f.write(raw)
    fs.move(beside, path)


def get_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


# ---- the operator -----------------------------------------------------------


def encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """(doc_id, ids binary): each document's ids and the end id, in the encoder's kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = encoder(vocabulary).documents
        for b in pieces(batches, TOGETHER):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(documents(b.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids binary")


#: Bytes of ids of a shard, on average.
SHARD_BYTES = 32 << 20


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, shard_docs: int = 4096) -> DataFrame:
    """Encode every text and write the shards; returns the manifest (shard, first_doc_id, docs, n_ids, path), materialised.

    One pass encodes and keeps the ids; their frequencies, a table no longer than
    the vocabulary, give the ranks; then the ids go to shards by ranges of doc_id.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    kept = fresh_dir(spark, "ids")

    kind = encoder(vocabulary).kind
    encoded(docs, id_col, text_col, vocabulary).write.option("compression", "zstd").parquet(kept)
    ids = spark.read.schema("doc_id long, ids binary").parquet(kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in pieces(batches):
            c = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind))
            if len(c) > len(total):
                c, total = total, c
            total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    freq = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # as long as the vocabulary at most
    order = sorted(freq, key=lambda r: (-r["n"], r["id"]))
    by_rank = np.array([r["id"] for r in order], dtype="<u4")
    put_file(f"{folder}/ranks.u4", by_rank.tobytes())
    ranks = f"{folder}/ranks.u4"

    size = ids.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)).alias("b")).first()
    parts = max(1, -(-size["n"] // shard_docs), -(-size["b"] // SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        rank_of = None
        doc_ids, counts, codes = [], [], []
        for b in batches:
            if rank_of is None:
                order = np.frombuffer(get_file(ranks), "<u4")
                rank_of = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
                rank_of[order] = np.arange(len(order), dtype=np.uint32)
            doc_ids += [NO_ID if x is None else x for x in b.column(0).to_pylist()]
            raw = b.column(1).to_pylist()
            counts += [len(x) // np.dtype(kind).itemsize for x in raw]
            codes.append(rank_of[np.frombuffer(b"".join(raw), kind)])
        if doc_ids:
            path = f"{folder}/shard-{shard:08d}.rlti"
            put_file(path, shard_bytes(np.array(doc_ids), np.array(counts), np.concatenate(codes)))
            yield pa.RecordBatch.from_pydict({"shard": [shard], "first_doc_id": [doc_ids[0]], "docs": [len(doc_ids)], "n_ids": [int(sum(counts))], "path": [path]})

    by = ["doc_id", "h", "m"]  # the last one lets ranges part rows that are all alike
    ordered = ids.withColumn("h", F.xxhash64("ids")).withColumn("m", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).select("doc_id", "ids")
    out = materialize(ordered.mapInArrow(write, "shard long, first_doc_id long, docs long, n_ids long, path string"), "manifest")
    drop_written(spark, kept)
    return out


#: Shards whose sizes are summed in one task.
GROUP = 4096


def read_token_files(spark: SparkSession, manifest: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shards."""
    # sums of what stands before: of groups of shards first, then within a group
    shards = manifest.withColumn("of", F.floor(F.col("shard") / GROUP))
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    groups = shards.groupBy("of").agg(F.sum("n_ids").alias("n")).select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("of").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    todo = shards.withColumn("own", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(groups, "of").select("path", (F.col("before") + F.col("own")).alias("base"))
    todo = todo.repartition(max(1, min(manifest.count(), MOST_TASKS)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = None
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if order is None:
                    order = np.frombuffer(get_file(ranks), "<u4")
                doc_ids, counts, codes = read_shard(get_file(path))
                raw = memoryview(order[codes].astype("<u4").tobytes())
                ends = np.cumsum(counts.astype(np.int64))
                starts = ends - counts.astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(starts + start), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
