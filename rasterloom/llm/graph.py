"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Scratch

#: Rows that one task writes at least.
ROWS_A_TASK = 200_000


def components(edges: DataFrame, into: Scratch | None = None) -> DataFrame:
    """(node, label): for each end of the edges (a, b) the smallest node it reaches.

    A round puts the nodes in an order of its own and moves each to the first of itself and its
    neighbours; edges go between the places their ends moved to, each once, and those within a
    place end.  So each round works on a smaller graph: a component loses a node a round at least,
    and a good part of them as a rule.  The first order is that of the nodes themselves, in which
    links to the smallest node of a group end at once; then it is a hash, which has no long runs.
    Moves are then followed from the last round to the first.
    Minima are taken before the shuffle; joins on a hub are left to the runtime's skew handling.
    Each round is written to the shared folder and dropped at the end; the result goes with ``into``.
    """
    with Scratch() as scratch:
        left = scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        n, moves = left.count(), []
        while n or not moves:
            tasks = n // ROWS_A_TASK + 1
            first = lambda c, k=len(moves): F.struct((F.xxhash64(F.lit(k), c) if k else F.col(c)).alias("rank"), F.col(c).alias("to"))
            both = left.select("a", "b").union(left.select("b", "a"))
            low = both.groupBy(F.col("a").alias("node")).agg(F.min(first("b")).alias("low"))
            moved = scratch.keep(low.select("node", F.least("low", first("node"))["to"].alias("to")).coalesce(tasks), "moves")
            moves.append(moved)
            end = lambda c, m=moved: m.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
            ends = left.join(end("a"), "a").join(end("b"), "b").where(F.col("a_to") != F.col("b_to"))
            left = scratch.keep(ends.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct().coalesce(tasks), "edges")
            n = left.count()
        found = moves.pop()
        while moves:  # a node without edges in the next round moves no further
            further = found.select(F.col("node").alias("to"), F.col("to").alias("last"))
            found = moves.pop().join(further, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
        labels = found.join(found.groupBy("to").agg(F.min("node").alias("label")), "to").select("node", "label")
        return (into or Scratch()).keep(labels, "labels")
