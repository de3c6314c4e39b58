"""Site-relative line de-duplication.

For each host, the pages that contain a line are divided by the host's pages;
lines above the ratio are boilerplate and are dropped from every page of that
host.  Counting goes over 64-bit line hashes, once a page and pre-aggregated, so
a host with a third of all pages is spread by its lines; the lines behind the
few hashes that pass are then counted by their text, which makes it exact.

The lines found go back to the pages by a broadcast if their counted size is
within bounds, of any host too; else pages are taken apart, their lines joined on (host, line)
and put together again, page by page.

Defined results: a line is what stands between line feeds, compared without
blanks at its ends; blank lines are never counted or dropped; null hosts are one
host; a null text counts as a page without lines and stays null; repeated rows
are pages each, or with ``once`` equal texts of a host are one page, so that copies
don't make each other's lines boilerplate; hosts without ``least_pages`` pages that
share a line lose none, unless a ``share`` is given: a line of two pages or more and
over that share of its host's is boilerplate on hosts of any size;
a page may lose all its lines and is then empty; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, materialize, unused

RATIO, LEAST_PAGES = 0.01, 5
#: Lines of a host that each of its pages is searched for; hosts of more go by the join.
LINES_A_HOST = 256
#: Of a host's pages, for hosts of few; below it two near copies would lose what they share.
SHARE = 0.25


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _bare(line: Column) -> Column:
    return F.trim(line)


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, once: bool = False, share: float | None = None) -> DataFrame:
    """(host, line, pages, total): lines in more than ``ratio`` of the host's pages and in ``least_pages`` at least, or in two and more than ``share``."""
    n, of = F.col("pages"), F.col("total")
    passes = (n >= least_pages) & (n > of * ratio)
    if share is not None:
        passes = passes | ((n >= 2) & (n > of * share))
    page = F.struct(F.xxhash64(text_col), F.length(text_col)).alias("page") if once else F.lit(0).alias("page")
    count = F.count_distinct("page") if once else F.count("*")
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")
    bare = F.array_distinct(F.filter(F.transform(_lines(F.col(text_col)), _bare), lambda x: x != ""))
    total = docs.select(host, page).groupBy("host").agg(count.alias("total"))
    hashed = docs.select(host, page, F.explode(F.transform(bare, lambda x: F.xxhash64(x))).alias("h"))
    seen = hashed.groupBy("host", "h").agg(count.alias("pages")).where(n >= (least_pages if share is None else min(2, least_pages)))
    often = materialize(seen.join(total, "host").where(passes), "often")
    texts = docs.select(host, page, F.explode(bare).alias("line")).withColumn("h", F.xxhash64("line"))
    side = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
    exact = texts.join(side, ["host", "h"]).groupBy("host", "line").agg(count.alias("pages"), F.first("total").alias("total"))
    return exact.where(passes)


def drop_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast: bool | None = None, once: bool = False, share: float | None = None) -> DataFrame:
    """The documents, all columns kept, without their host's boilerplate lines.

    ``broadcast``: None decides by size; False takes the way for sets of any size.
    """
    h, ln, bad, row, at, raw, null, kept = (unused(docs, c) for c in ("host_", "line_", "bad_", "row_", "at_", "raw_", "null_", "kept_"))
    found = materialize(boilerplate(docs, host_col, text_col, ratio, least_pages, once, share).select(F.col("host").alias(h), F.col("line").alias(ln)), "boilerplate")
    host = F.coalesce(docs[host_col].cast("string"), F.lit(""))
    if broadcast is None:
        hosts = found.groupBy(h).agg(F.count("*").alias("n"), F.sum(F.octet_length(ln) + F.octet_length(h) + 32).alias("b"))
        size = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
        broadcast = size["n"] <= BROADCAST_ROWS and size["b"] <= BROADCAST_BYTES and size["most"] <= LINES_A_HOST
    if broadcast:
        of = F.broadcast(found.groupBy(h).agg(F.collect_set(ln).alias(bad)))
        left = F.array_join(F.filter(_lines(docs[text_col]), lambda x: ~F.array_contains(F.col(bad), _bare(x))), "\n")
        text = F.when(F.col(bad).isNull(), docs[text_col]).otherwise(left)
        return docs.join(of, host == F.col(h), "left").select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
    names = docs.columns
    rows = materialize(docs.withColumn(row, F.struct(F.monotonically_increasing_id(), F.xxhash64(text_col))), "rows")
    parts = rows.select(row, F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias(h), F.posexplode(_lines(F.col(text_col))).alias(at, raw)).withColumn(ln, _bare(F.col(raw)))
    left = parts.join(found, [h, ln], "left_anti")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, raw))), lambda x: x[raw]), "\n")
    back = left.groupBy(row).agg(text.alias(kept))
    joined = rows.drop(text_col).join(rows.select(row, F.col(text_col).isNull().alias(null)), row).join(back, row, "left")
    return joined.select(*[F.when(~F.col(null), F.coalesce(kept, F.lit(""))).alias(c) if c == text_col else F.col(c) for c in names])
