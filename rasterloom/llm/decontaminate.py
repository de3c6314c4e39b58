"""Benchmark decontamination with DataFrame functions only.

The benchmark's texts become windows of 13 consecutive words.  Wherever such a
window stands in a document, one of the document's 7-word runs at every seventh
word lies wholly in it; so only those runs are hashed and looked up among the
7-word runs of the windows (for shorter windows, runs and steps of half their
length), and the windows around a hit are then looked up and verified word by
word.  The sets are broadcast when their counted size allows.  Otherwise only the
places and hashes of the runs are shuffled, in proportion to the texts; the words of
documents with a hit are joined back, and only their windows are looked up.  The few
verified spans are gathered per document.

Defined results: a null or word-less text has no windows, no hits and is never
contaminated.  A document that occurs twice is judged twice, alike.  Item ids
that occur on several rows count once; a null item id counts as ''.  An empty
benchmark leaves every document clean.  Only the named columns are read, so
extra columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import ascii_lower, fits_broadcast, materialize, unused

#: A word of a lower-cased text is a run of ASCII letters, digits and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What stands between words, one by one: Java tests such a class by a table, and ranges one after another.
BETWEEN = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
WINDOW = 13


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")).cast("long")


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(h, gram array<string>, items array<string>): each distinct window with the items that hold it."""
    item = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w"))
    item = item.where(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(window)))
    grams = item.select("item", "w", "k", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("at"))
    grams = grams.select("item", F.slice("w", F.col("at"), F.col("k")).alias("gram"))
    return grams.groupBy("gram").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.xxhash64("gram").alias("h"), "gram", "items")


def window_hits(docs: DataFrame, grams: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, spans, items) of the documents in which windows occur.

    ``spans``: array of (start word, words).  The verification is written as two
    inequalities so that it stays a condition on hash hits and doesn't become a
    join key that every window of the corpus would have to build.
    """
    grams = materialize(grams, "grams")
    stats = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("m"), F.collect_set(F.size("gram")).alias("ks")).first()
    lengths = sorted(stats["ks"]) or [WINDOW]
    small = fits_broadcast(stats["n"], 64 * WINDOW + 64 * (stats["m"] // max(1, stats["n"]) + 1)) and fits_broadcast(stats["n"] * WINDOW, 16)
    side = F.broadcast(grams) if small else grams
    run = lambda k: F.floor((k + 2) / 2).cast("int")
    size = F.size("gram")
    runs = grams.select(F.explode(F.transform(F.sequence(F.lit(1), size - run(size) + 1), lambda j: F.xxhash64(size, F.slice("gram", j, run(size))))).alias("rh")).distinct()
    runs = F.broadcast(runs) if small else runs

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("w"))
    scan = texts
    scan = scan.withColumn("k", F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*map(F.lit, lengths))))
    scan = scan.where(F.size("w") >= F.col("k")).withColumn("g", run(F.col("k")))
    scan = scan.select("id", "text_hash", "w", "k", "g", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("g") + 1, F.col("k") - F.col("g") + 1)).alias("p"))
    scan = scan.withColumn("h1", F.xxhash64("k", F.slice("w", F.col("p"), F.col("g"))))
    if small:
        near = scan.join(runs, F.col("h1") == F.col("rh"))
    else:  # a document's places are no more than its words
        places = scan.select("id", "text_hash", "k", "g", "p", "h1").join(runs, F.col("h1") == F.col("rh")).groupBy("id", "text_hash").agg(F.collect_set(F.struct("k", "g", "p")).alias("places"))
        places = places.withColumnsRenamed({"id": "place_id", "text_hash": "place_hash"})
        near = texts.dropDuplicates(["id", "text_hash"]).join(places, F.col("id").eqNullSafe(F.col("place_id")) & (F.col("text_hash") == F.col("place_hash"))).select("id", "text_hash", "w", F.inline("places"))
    starts = F.sequence(F.greatest(F.lit(1), F.col("p") + F.col("g") - F.col("k")), F.least(F.col("p"), F.size("w") - F.col("k") + 1))
    near = near.select("id", "text_hash", "w", "k", F.explode(starts).alias("at")).withColumn("wh", F.xxhash64(F.slice("w", F.col("at"), F.col("k"))))
    seen = F.slice("w", F.col("at"), F.col("k"))
    if not small:
        near, seen = near.select("id", "text_hash", "k", "at", "wh", seen.alias("seen")), F.col("seen")
    hits = near.join(side, (F.col("wh") == F.col("h")) & (seen >= F.col("gram")) & (seen <= F.col("gram")))
    hits = hits.select("id", "text_hash", F.struct(F.col("at").alias("s"), F.col("k").alias("k")).alias("span"), "items")
    return hits.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["s"] + x["k"] - F.greatest(x["s"], a["end"]))).cast("long").alias("n"),
        F.greatest(a["end"], x["s"] + x["k"]).alias("end"),
    )
    return F.aggregate(spans, start, step, lambda a: a["n"])


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, share: int = 20) -> DataFrame:
    """A row for each document: n_words, n_hit, n_items, items, contaminated (hit words at least 1/``share`` of all), spans, text_hash."""
    hits = window_hits(docs, benchmark_windows(benchmark, item_col, text_col, window), id_col, text_col)
    hits = hits.withColumnsRenamed({"id": "hit_id", "text_hash": "hit_hash"})
    every = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), count_words(F.col(text_col)).alias("n_words"))
    joined = every.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    none = F.array().cast("array<string>")
    out = joined.select(
        "id", "text_hash", "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.sort_array(F.coalesce("items", none)).alias("items"),
        "spans",
    )
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` less the words in ``spans`` and what stands before each of them."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(?:(?!{ANY_WORD}).)*{ANY_WORD}|(?s)(?:(?!{ANY_WORD}).)+$"), F.lit(0))
    inside = lambda i: F.exists(spans, lambda s: (i + 1 >= s["s"]) & (i + 1 < s["s"] + s["k"]))
    return F.array_join(F.filter(pieces, lambda _, i: ~inside(i)), "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "drop", **how) -> DataFrame:
    """The documents, all columns kept, less contaminated ones (``drop``) or less the hit words of those (``cut``)."""
    if mode not in ("drop", "cut"):
        raise ValueError(f"mode: {mode}")
    b_id, b_hash, b_spans = (unused(docs, c) for c in ("bad_id", "bad_hash", "bad_spans"))
    bad = judge(docs, benchmark, id_col, text_col, **how).where("contaminated").select(F.col("id").alias(b_id), F.col("text_hash").alias(b_hash), F.col("spans").alias(b_spans)).dropDuplicates([b_id, b_hash])
    same = docs[id_col].eqNullSafe(bad[b_id]) & (F.xxhash64(docs[text_col]) == bad[b_hash])
    if mode == "drop":
        return docs.join(bad, same, "left_anti")
    cut = F.when(F.col(b_spans).isNull(), docs[text_col]).otherwise(without_spans(docs[text_col], F.col(b_spans)))
    return docs.join(bad, same, "left").select(*[cut.alias(c) if c == text_col else docs[c] for c in docs.columns])
