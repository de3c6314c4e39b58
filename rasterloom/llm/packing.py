"""Best-fit packing of token pieces into sequences.

Vector best fit, decreasing: a sequence has three capacities, tokens, documents
and attention cost (the sum of squared piece lengths).  Pieces come in falling
length; each goes to the open sequence that holds it under every constraint and
that scores best, by the weighted norm of what would be left (smallest) or the
weighted dot product of piece and residual (largest).

Pieces are dealt by a hash (of their place too, so that rows that are all alike part)
to groups, one for every ``group_docs`` documents, each
packed in one task; a group wastes half a sequence on average, whatever the group count,
and one long document or source is spread over all groups.  In a group, open
sequences are kept by residual tokens; for the norm the search goes up from the
tightest level and stops when the tokens left alone exceed the best norm, for
the dot product down from the emptiest.

Defined results: a null text has no ids but the end id; an empty table gives no
rows; rows that share a doc_id are packed each; a null doc_id is kept.  Only
the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import pieces
from rasterloom.llm.tokens import TOGETHER, default_vocabulary, encoder


@dataclass(frozen=True)
class Capacity:
    """Of one sequence.  At the defaults tokens alone bind (documents and attention when set lower), but the loads of all three choose between sequences."""

    tokens: int = 1024
    docs: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"


def pieces_of(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, size: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, at): only documents of over ``size`` ids are cut, the first piece takes the rest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, kind = encoder(vocabulary).documents, encoder(vocabulary).kind
        for b in pieces(batches, TOGETHER):
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), documents(b.column(1).to_pylist()), strict=True):
                raw = memoryview(np.frombuffer(ids, kind).astype("<u4").tobytes())
                n = len(raw) // 4
                first = n if n <= size else n % size or size
                cuts = [0, *range(first, n + 1, size)]
                rows += [(doc, k, a, z - a, zlib.crc32(raw[4 * a : 4 * z])) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, all of which are at most ``cap.tokens``; longest first."""
    order = np.argsort(-lengths, kind="stable").tolist()
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    levels: list[list[tuple[int, int, int]]] = [[] for _ in range(cap.tokens + 1)]  # by residual tokens: (attention used, documents, bin)
    held = 0  # bit r: level r is not empty
    wt, wd, wa = cap.weights
    T, D, A = float(cap.tokens), float(cap.docs), float(cap.attention)
    opened = 0
    for i in order:
        size = int(lengths[i])
        cost = size * size
        best, where = float("inf"), None
        rest = held >> size
        while rest:
            if cap.rule == "norm":  # upwards: the tokens left only grow
                r = size + (rest & -rest).bit_length() - 1
                bound = wt * ((r - size) / T) ** 2
            else:  # downwards: the product with the tokens only falls
                r = size + rest.bit_length() - 1
                bound = -(wt * size * r / T**2 + wd / D + wa * cost / A)
            if bound >= best:
                break
            rest ^= 1 << (r - size)
            for x in levels[r]:
                att, n, _ = x
                if n < cap.docs and att + cost <= cap.attention:
                    if cap.rule == "norm":
                        s = bound + wd * ((D - n - 1) / D) ** 2 + wa * ((A - att - cost) / A) ** 2
                    else:
                        s = -(wt * size * r / T**2 + wd * (D - n) / D**2 + wa * cost * (A - att) / A**2)
                    if s < best:
                        best, where = s, (r, x)
        if where is None:
            r, (att, n, k) = cap.tokens, (0, 0, opened)
            opened += 1
        else:
            r, (att, n, k) = where
            levels[r].remove(where[1])
            if not levels[r]:
                held ^= 1 << r
        bins[i], offsets[i] = k, cap.tokens - r
        if r > size:
            levels[r - size].append((att + cost, n + 1, k))
            held |= 1 << (r - size)
    return bins, offsets


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: Capacity | None = None, group_docs: int = 4096) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cap = capacity or Capacity()
    groups = max(1, -(-docs.count() // group_docs))
    pieces = pieces_of(docs, id_col, text_col, vocabulary or default_vocabulary(), cap.tokens)
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = pack(pdf["length"].to_numpy(), cap)
        return pdf.assign(sequence_id=pdf["grp"].to_numpy() * (1 << 32) + bins, offset=offsets).drop(columns="grp")

    return pieces.groupBy("grp").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
