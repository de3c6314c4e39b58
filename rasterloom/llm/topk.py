"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors become integers, floor(scale * x).  Candidates are dealt to blocks of
bounded size.  A block's row holds its index, built once: the postings (vector,
value) of each dimension, in segments of falling quantised impact, the power of
two of the component.  For a block of queries the segments are processed from
the highest impact on; each posting adds its part to the scores of its vector,
and nothing else is touched.  What a candidate can still gain or lose after a
segment is bounded by Cauchy and Schwarz over the components that haven't been
processed.  A query stops when the candidates that may still be among the k are
few, which is a proof for all the others, and takes no part in later segments;
the possible members are then scored exactly in integers.

The first block of candidates is searched first.  Its k-th score is a floor for
the k-th score of the whole, which every other block starts from: there a query
may be done after the first segment.

Queries meet every block of candidates by a join on the block number, to which
each block of queries is copied; blocks are binary rows, so no row is made for a
pair of vectors.  Each pair of blocks yields k rows a query at most, cut again
by a rank limit before the last shuffle.

Defined results: vectors that are null, or hold null or non-finite components,
and rows without an id take no part; vectors of unequal length count as padded
with zeros; a vector's own are the rows of its id; repeated rows of one id and
vector count once; ties go to the smaller id; scores outside 64 bits are cut to
its ends; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, BLOCK = 512, 4096
#: Below this the products and their sums are exact in float64.
EXACT = 1 << 53
#: Levels of impact; the last one takes all that is smaller.
SEGMENTS = 8
#: Once no more than this part of a block may be among the k, exact scores cost less than the segments that are left.
FEW = 4
#: Every so manieth candidate is looked at first.
SOME = 16
#: Blocks of queries that meet a block of candidates in one group; beyond this it is copied.
TOGETHER = 4
INDEX = ("c_places", "c_cuts", "c_left")


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int, *carried: str) -> DataFrame:
    """(vec_id, v array<double>, ...): whole numbers; rows that take no part are gone."""
    bad = F.exists(F.col(vec_col).cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(~bad)
    whole = F.transform(F.col(vec_col).cast("array<double>"), lambda c: F.when(F.abs(c * scale) < float(EXACT), F.floor(c * scale).cast("double")).otherwise(c * scale))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"), *carried).distinct()


def blocks(rows: DataFrame, n: int, name: str) -> DataFrame:
    """(block, ids, dims, values): vectors of ``n`` blocks, each one binary row."""

    def run(key, t):
        t = t.sort_by("vec_id")
        vecs = t.column("v").to_pylist()
        dims = max(map(len, vecs), default=0)
        m = np.zeros((len(vecs), dims))
        for i, x in enumerate(vecs):
            m[i, : len(x)] = x
        ids = np.array(t.column("vec_id").to_pylist(), np.int64)
        return pa.table({name: [key[0].as_py()], f"{name}_ids": pa.array([ids.tobytes()], pa.binary()), f"{name}_dims": [dims], f"{name}_values": pa.array([m.tobytes()], pa.binary())})

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(n)))
    return dealt.groupBy(name).applyInArrow(run, f"{name} long, {name}_ids binary, {name}_dims long, {name}_values binary")


class ImpactIndex:
    """Postings of one block of candidates, in segments of falling quantised impact.

    The impact is the power of two below which the component lies, counted down
    from the largest; zero components have no postings.  A posting is the place of its
    component in the block's values, so the index is ``places`` and where each
    dimension of each segment begins (``cuts``), beside the norms of what a vector
    has left after each segment (``left``).
    """

    def __init__(self, values: np.ndarray, places: np.ndarray, cuts: np.ndarray, left: np.ndarray):
        self.values, self.places, self.cuts, self.left = values, places, cuts, left

    @classmethod
    def build(cls, values: np.ndarray, segments: int = SEGMENTS) -> ImpactIndex:
        n, dims = values.shape
        vec, dim = np.nonzero(values)
        size = np.abs(values[vec, dim])
        level = np.minimum(segments - 1, np.floor(np.log2(size.max(initial=1.0)) - np.log2(size)).astype(np.int64))
        order = np.argsort(level * dims + dim, kind="stable")
        cuts = np.searchsorted((level * dims + dim)[order], np.arange(segments * dims + 1))
        squares = np.zeros((segments, n))
        np.add.at(squares, (level, vec), size**2)
        left = np.zeros((segments, n))
        left[:-1] = np.cumsum(squares[:0:-1], axis=0)[::-1]  # from the last segment on, so that nothing is ever taken away
        return cls(values, (vec * dims + dim)[order].astype(np.int64), cuts.astype(np.int64), np.sqrt(left))

    def add(self, segment: int, weights: np.ndarray, scores: np.ndarray) -> int:
        """Add the segment's postings, times each query's weights (dimensions x queries), to the scores (vectors x queries); how many postings it took."""
        dims, taken = len(weights), 0
        for d in np.flatnonzero(weights.any(axis=1)):
            at = self.places[self.cuts[segment * dims + d] : self.cuts[segment * dims + d + 1]]
            if len(at):
                scores[at // dims] += self.values.ravel()[at][:, None] * weights[d][None, :]
                taken += len(at)
        return taken


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, cut to 64 bits where they exceed them."""
    if max(np.abs(q).max(initial=0), 1) * max(np.abs(c).max(initial=0), 1) * max(1, q.shape[-1]) < EXACT:
        return (c @ q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(q.tolist(), row, strict=True)) for row in c.tolist()]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in whole], np.int64)


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, index: ImpactIndex, k: int, floor: np.ndarray | None = None, counts: dict | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of the k best of the block for each query, its own id left out.

    ``floor``: scores that k candidates elsewhere are known to reach; what lies below may be left out.
    ``counts["postings"]`` gets the postings taken, once for each query that took them.
    """
    values = index.values
    dims = values.shape[1]
    n, few = min(k, len(ids)), max(2 * k, len(ids) // FEW)
    live = np.arange(len(q))
    # a candidate has nothing in dimensions beyond its block's
    weights = np.pad(q, ((0, 0), (0, max(0, dims - q.shape[1]))))[:, :dims].T
    norms = np.sqrt((weights * weights).sum(axis=0))
    least = np.full(len(q), -np.inf) if floor is None else floor
    scores = np.zeros((len(ids), len(q)))
    members: dict[int, np.ndarray] = {}
    for segment, left in enumerate(index.left):
        taken = index.add(segment, np.ascontiguousarray(weights[:, live]), scores)
        if counts is not None:
            counts["postings"] = counts.get("postings", 0) + taken * len(live)
        last = segment == len(index.left) - 1
        # no lower bound exceeds the highest score; where many of some candidates may reach that, the others needn't be looked at yet
        over = np.maximum(scores.max(axis=0, initial=-np.inf), least[live])
        near = np.ones(len(live), bool) if last else (scores[::SOME] + left[::SOME, None] * norms[live] >= over).sum(axis=0) <= few // SOME + 2
        done = np.zeros(len(live), bool)
        for at in np.array_split(np.flatnonzero(near), 1 + near.sum() // 64):
            part = np.ascontiguousarray(scores[:, at].T)
            slack = norms[live[at], None] * left[None, :]
            slack += 1e-9 * (np.abs(part) + slack) + 1e-9  # for rounding, on the safe side
            own = q_ids[live[at], None] == ids[None, :]
            bar = least[live[at]]
            if n == k:
                low = np.where(own, -np.inf, part - slack)
                high = (low >= bar[:, None]).sum(axis=1) >= k  # else the floor is the higher of the two
                if high.any():
                    bar[high] = np.maximum(bar[high], np.partition(low[high], len(ids) - n, axis=1)[:, len(ids) - n])
            possible = (part + slack >= bar[:, None]) & ~own
            ends = (possible.sum(axis=1) <= few) | last
            done[at] = ends
            members.update((int(live[at[j]]), np.flatnonzero(possible[j])) for j in np.flatnonzero(ends))
        if done.any():
            live, scores = live[~done], np.compress(~done, scores, axis=1)
        if not len(live):
            break
    for i, at in sorted(members.items()):
        s = exact_scores(weights[:, i], values[at])
        best = np.lexsort((ids[at], -s))[:k] if s.min(initial=0) > -(1 << 63) else np.array(sorted(range(len(at)), key=lambda j: (-int(s[j]), int(ids[at[j]])))[:k], int)
        yield int(q_ids[i]), ids[at][best], s[best]


def indexed(cand: DataFrame) -> DataFrame:
    """Blocks of candidates with their index beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x = ImpactIndex.build(np.frombuffer(r["c_values"]).reshape(-1, r["c_dims"]) if r["c_dims"] else np.zeros((len(r["c_ids"]) // 8, 0)))
                yield pa.RecordBatch.from_pylist([{**r, "c_places": x.places.tobytes(), "c_cuts": x.cuts.tobytes(), "c_left": x.left.tobytes()}], schema=pa.schema([*b.schema, *[pa.field(c, pa.binary()) for c in INDEX]]))

    return cand.mapInArrow(run, "c long, c_ids binary, c_dims long, c_values binary, c_places binary, c_cuts binary, c_left binary")


def searched(pairs: DataFrame, k: int) -> DataFrame:
    """(q, query_id, vec_id, score) of pairs of a block of queries, with its floor or null, and a block of candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):  # one pair at a time: blocks are large
                r = b.slice(at, 1).to_pylist()[0]
                q_ids, ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64)
                q = np.frombuffer(r["q_values"]).reshape(len(q_ids), r["q_dims"])
                c = np.frombuffer(r["c_values"]).reshape(len(ids), r["c_dims"])
                index = ImpactIndex(c, np.frombuffer(r["c_places"], np.int64), np.frombuffer(r["c_cuts"], np.int64), np.frombuffer(r["c_left"]).reshape(SEGMENTS, len(ids)))
                floor = None
                if r["floors"]:
                    known = {f["query_id"]: float(f["score"]) for f in r["floors"]}
                    floor = np.array([known.get(int(i), -np.inf) for i in q_ids])
                found = list(search_block(q_ids, q, ids, index, k, floor))
                ends = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([np.full(len(v), i) for i, v, _ in found], [v for _, v, _ in found], [s for _, _, s in found])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends[0]), r["q"]), pa.int64()), *[pa.array(x, pa.int64()) for x in ends]], ["q", "query_id", "vec_id", "score"])

    return pairs.select("q", "floors", "q_ids", "q_dims", "q_values", "c_ids", "c_dims", "c_values", *INDEX).mapInArrow(run, "q long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id ``every`` divides."""
    rows = quantised(vectors, id_col, vec_col, scale)
    size = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    n, m = max(1, -(-size["n"] // BLOCK)), max(1, -(-size["q"] // QUERY_BLOCK))
    cand = indexed(blocks(rows, n, "c"))
    query = blocks(rows.where(F.col("vec_id") % every == 0), m, "q")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    groups = -(-m // TOGETHER)
    query = query.withColumn("g", F.pmod("q", F.lit(groups)))
    cand = cand.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    none = F.lit(None).cast("array<struct<query_id:long,score:long>>").alias("floors")
    found = searched(query.withColumn("c", F.pmod("q", F.lit(1))).join(cand.where("c = 0"), ["c", "g"]).select("*", none), k)
    if n > 1:
        # scores at the ends of 64 bits may have been cut, and are no floor; 512 rows at most a block of queries
        kth = found.withColumn("rank", F.row_number().over(best)).where((F.col("rank") == k) & (F.abs("score") < EXACT))
        floors = kth.groupBy("q").agg(F.collect_list(F.struct("query_id", (F.col("score") - 1).alias("score"))).alias("floors"))
        more = query.join(floors, "q", "left").withColumn("c", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n - 1).cast("long"))))
        # behind the explode Spark takes the copies for as few bytes as the queries, and without the hint sends all of them to the driver
        found = found.unionByName(searched(more.join(cand.hint("merge"), ["c", "g"]), k))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
