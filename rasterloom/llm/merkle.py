"""A Merkle manifest of a table: block by block, with array functions of SQL alone.

A row's leaf is the hash of its fields.  The leaves of a source, ascending by id,
are cut into blocks of ``3 ** LEVELS``; each block is one ordered array, which
``sequence``, ``transform``, ``slice`` and ``aggregate`` collapse level by level.
The block roots are the leaves of the next round, so a source with any share of
all rows is spread over its blocks, and no group holds more than a block.  The
roots of the sources go the same way.  What a leaf needs to reach the root, its
left and right neighbours on each level, comes back down by joins of blocks.

Places in a source are the rows of earlier parts of a range-dealt, written table
plus the place in the part, so no window runs over a source.

Defined results: a null field counts as ``-``; null sources come first, and are
one source; null ids come first in their source and are never tampered with;
rows alike in id and leaf stand side by side in any order, which changes nothing
in the hashes; other rows of one id are ordered by their leaf; columns that the
leaf doesn't name play no part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import Scratch, broadcast_if_small, materialize

#: Levels that a block collapses, and its leaves.
LEVELS = 5
BLOCK = 3**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of a row of ``climb``, at most: a path of two hashes a level.
PATH_BYTES = 8192


def digest(values: list[Column]) -> Column:
    """Hex SHA-256 of the values, each with its byte count before it, or ``-``."""
    shown = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in (c.cast("string") for c in values)]
    return F.sha2(F.concat(*shown), 256)


def ranked(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """The rows of (g, ...) with their place ``pos`` in g, from 0, and the size ``n`` of g."""
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    placed = scratch.keep(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftrightunsigned("at", 33)), "ranked")
    runs = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    of = Window.partitionBy("g")  # a row for each part that the group reaches
    before = F.sum("rows").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = scratch.keep(runs.select("g", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(of).alias("n")), "runs")
    size = runs.agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("g")), F.lit(0)).alias("b")).first()
    runs = broadcast_if_small(runs, size["n"], size["b"] + 64)
    return placed.join(runs, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


_COLLAPSE = """
aggregate(slice(sequence(1, {levels}), 1, depth), array(transform(entries, e -> e.digest)), (done, l) -> concat(done, array(
  transform(sequence(0, cast((size(element_at(done, -1)) - 1) div 3 as int)),
    i -> sha2(array_join(slice(element_at(done, -1), 3 * i + 1, 3), ''), 256)))))
""".format(levels=LEVELS)  # noqa: UP032


def blocks(rows: DataFrame, *carried: str) -> DataFrame:
    """(g, block, n, entries, depth, levels) of rows (g, pos, n, digest, ...): an ordered array of leaves and all levels above it.

    A block of a group of several collapses ``LEVELS`` times, even if one node is left sooner.
    """
    entry = F.sort_array(F.collect_list(F.struct("pos", "digest", *carried))).alias("entries")
    dealt = rows.groupBy("g", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.max("n").alias("n"), entry)
    depth = F.lit(LEVELS)
    for d in reversed(range(LEVELS)):
        depth = F.when(F.col("n") <= 3**d, d).otherwise(depth)
    return dealt.withColumn("depth", depth).withColumn("levels", F.expr(_COLLAPSE))


_PATH = """
transform(slice(sequence(0, {last}), 1, depth), l -> transform(array(cast((e.pos - block * {block}) div element_at({powers}, l + 1) as int)),
  i -> named_struct('left', array_join(slice(levels[l], i - i % 3 + 1, i % 3), ''), 'right', array_join(slice(levels[l], i + 2, 2 - i % 3), '')))[0])
""".format(last=LEVELS - 1, block=BLOCK, powers="array(" + ", ".join(str(3**d) for d in range(LEVELS)) + ")")  # noqa: UP032


def expand(dealt: DataFrame, above: DataFrame) -> DataFrame:
    """(g, e, path, ...): each entry of the blocks with its neighbours up to the root; ``above`` has (g, block, way, ...)."""
    out = dealt.join(above, ["g", "block"])
    return out.select("*", F.explode("entries").alias("e")).withColumn("path", F.concat(F.expr(_PATH), "way")).drop("entries", "levels", "way", "n", "depth", "block")


def climb(dealt: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, block, root, way): the root of each block's group, and the neighbours on the way from the block to it."""
    top = F.element_at(F.element_at("levels", -1), 1)
    if (dealt.agg(F.max("n").alias("n")).first()["n"] or 0) <= BLOCK:
        return dealt.select("g", "block", top.alias("root"), F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("way"))
    up = scratch.keep(blocks(dealt.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), top.alias("digest"))), "blocks")
    return expand(up, climb(up, scratch)).select("g", F.col("e.pos").alias("block"), "root", F.col("path").alias("way"))


def fold(leaf: Column, path: Column) -> Column:
    return F.aggregate(path, leaf, lambda at, by: F.sha2(F.concat(by["left"], at, by["right"]), 256))


def manifest(rows: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    ``tampered``: the text that each row is checked with; by default its own.
    """
    changed = [tampered if f == text_col and tampered is not None else F.col(f) for f in fields]
    group = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit(""))  # keeps bytewise order, null first
    with Scratch() as scratch:
        leaves = scratch.keep(rows.select(group.alias("g"), F.col(id_col).alias("id"), digest([F.col(f) for f in fields]).alias("digest"), digest(changed).alias("checked")), "leaves")
        docs = scratch.keep(blocks(ranked(leaves, ["id", "digest"], scratch), "id", "checked"), "blocks")
        within = scratch.keep(climb(docs, scratch), "within")
        subroots = within.where("block = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("digest"))
        groups = scratch.keep(blocks(ranked(subroots, ["name"], scratch), "name"), "groups")
        across = scratch.keep(expand(groups, climb(groups, scratch)).select(F.col("e.name").alias("g"), F.col("root").alias("whole"), F.col("path").alias("rest")), "across")
        above = within.join(broadcast_if_small(across, across.count(), PATH_BYTES), "g").select("g", "block", F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("way", "rest").alias("way"))
        proof = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
        out = expand(docs, above).select(
            F.col("e.id").alias("doc_id"), F.col("e.digest").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), fold(F.col("e.checked"), F.col("path")).alias("folded_root"),
        )
        return materialize(out.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")
