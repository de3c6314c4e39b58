"""The queries of this subpackage, their SQL, and which of them have none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import chat, common, decontaminate, langid, lines, merkle, negatives, packing, simhash, suffixes, tokens, topk, toxicity, warc

table = common.table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, training=toxicity.bucket(F.col("doc_id"), 4) != 2)
    return langid.identify(docs, model).select("doc_id", (toxicity.bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_turns(turns.unionByName(extra)))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line de-duplication by source, with what it had and has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_before"))
    out = lines.drop_lines(docs)
    return out.select("doc_id", "n_lines", "n_before", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.fresh_dir(spark, "tokens")
    manifest = tokens.write_token_files(table(spark, sf_dir, "documents"), folder)
    return tokens.read_token_files(spark, manifest, f"{folder}/ranks.u4")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_groups(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), training=toxicity.bucket(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), F.when(odd, F.translate("text", "\n", "")).otherwise(F.col("text")))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with common.Scratch() as scratch:
        out = suffixes.remove_repeats(table(spark, sf_dir, "documents"), scratch)
        removed = F.aggregate(F.zip_with("starts", "ends", lambda a, z: z - a), F.lit(0).cast("long"), lambda n, x: n + x)
        return common.materialize(out.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")), "repeats")


OP2_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, '<|start|>' || replace(replace(role, '\', '\\'), '<|', '<\|') || '<|content|>' || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|end|>' as shown from t
), g as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
    coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
    string_agg(shown, '' order by turn, role, text) as formatted
  from e group by conv_id
)
select cast(conv_id as bigint) as conv_id, cast(n_turns as bigint) as n_turns, sha256(turns) as turns_sha256,
  cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(length(formatted) as bigint) as formatted_chars
from g
"""

OP4_SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(source, '') as host, text from documents),
l as (select rid, doc_id, host, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d),
total as (select host, count(*) as total from d group by host),
bad as (
  select host, bare from (select host, trim(line, ' ') as bare, count(distinct rid) as pages from l where trim(line, ' ') <> '' group by all)
  join total using (host) where pages >= {lines.LEAST_PAGES} and pages > total * {lines.RATIO!r}::double
),
kept as (
  select rid, string_agg(line, chr(10) order by pos) as text from l
  where not exists (select 1 from bad where bad.host = l.host and bad.bare = trim(l.line, ' ')) group by rid
)
select d.doc_id, cast(len(string_split(coalesce(d.text, ''), chr(10))) as bigint) as n_lines, cast(length(coalesce(d.text, '')) as bigint) as n_before,
  cast(length(coalesce(kept.text, '')) as bigint) as n_kept, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (rid)
"""

_LOWER = f"translate(%s, '{common.UPPER}', '{common.LOWER}')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS % "coalesce(text, '')"} as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {_WORDS % "coalesce(text, '')"} as w from benchmark),
bw as (
  select distinct item, k, array_to_string(w[pos : pos + k - 1], ' ') as gram
  from (select item, w, least(len(w), 13) as k, unnest(range(1, len(w) - least(len(w), 13) + 2)) as pos from b where len(w) > 0)
),
dw as (
  select rid, k, pos, array_to_string(w[pos : pos + k - 1], ' ') as gram
  from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as pos from d, (select distinct k from bw) where len(w) >= k)
),
hits as (select rid, pos, k, item from dw join (select distinct item, k, gram from bw) using (k, gram)),
words as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(pos, pos + k)) as p from (select distinct rid, pos, k from hits)) group by rid),
items as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from hits) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (rid) left join items using (rid)
"""

OP9_SQL = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select cast(query_id as bigint) as query_id, cast(rank as int) as rank, cast(vec_id as bigint) as vec_id, score from r where rank <= 20
"""

OP10_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select cast(page_id as bigint) as page_id, cast(n as bigint) as payload_bytes, p.d as payload_digest,
  case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then cast(first as bigint) end as refers_to
from p left join f on p.d = f.d and n >= 100
"""

OP11_SQL = """
with r as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select a.vec_id as anchor_id, c.vec_id as other, a.label = c.label as same, cast(list_dot_product(a.v, c.v) as bigint) as score
  from r a join r c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0
),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, other) as k from s where same) where k <= 5),
n as (
  select p.anchor_id, p.other as positive_id, s.other as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.other order by s.score desc, s.other) as rank
  from p join s on p.anchor_id = s.anchor_id and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score
)
select cast(anchor_id as bigint) as anchor_id, cast(positive_id as bigint) as positive_id, cast(rank as int) as rank, cast(negative_id as bigint) as negative_id, positive_score, negative_score
from n where rank <= 5
"""

_FIELD = "coalesce(cast(strlen(cast(%s as varchar)) as varchar) || ':' || cast(%s as varchar), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD % (f, f) for f in ("doc_id", "source", "lang", "n_chars", "%s")) + ")"
#: The CRC of the id's digits, bit by bit; the last step's complement is left to the reader of its last bit.
_CRC = "list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))))"

OP12_SQL = f"""
with recursive d as (
  select row_number() over (partition by source order by doc_id nulls first, {_LEAF % ("text", "text")}) - 1 as pos, coalesce('s' || source, '') as g, doc_id, {_LEAF % ("text", "text")} as leaf,
    case when xor({_CRC}, 4294967295) % 2 = 0 then {_LEAF % (("replace(text, chr(10), '')",) * 2)} else {_LEAF % ("text", "text")} end as checked from documents
),
t as (
  select 0 as lvl, g, pos, leaf as h, count(*) over (partition by g) as n from d
  union all
  select lvl + 1, g, pos // 3, sha256(string_agg(h, '' order by pos)), (any_value(n) + 2) // 3 from t where n > 1 group by lvl, g, pos // 3
),
u0 as (select g as name, h, row_number() over (order by g) - 1 as pos, count(*) over () as n from t where n = 1),
u as (
  select 0 as lvl, name, pos, h, n from u0
  union all
  select lvl + 1, null, pos // 3, sha256(string_agg(h, '' order by pos)), (any_value(n) + 2) // 3 from u where n > 1 group by lvl, pos // 3
),
nodes as (
  select 0 as part, lvl, g, pos, h, n from t
  union all select 1, lvl, '', pos, h, n from u
),
run as (
  select a.part, a.lvl, a.g, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (where b.pos < a.pos), '') as l, coalesce(string_agg(b.h, '' order by b.pos) filter (where b.pos > a.pos), '') as r
  from nodes a join nodes b on a.part = b.part and a.lvl = b.lvl and a.g = b.g and a.pos // 3 = b.pos // 3 where a.n > 1 group by all
),
step as (
  select d.g, d.pos, part, lvl, l, r from d join run on part = 0 and run.g = d.g and run.pos = d.pos // cast(pow(3, lvl) as bigint)
  union all
  select d.g, d.pos, part, lvl, l, r from d join u0 on u0.name = d.g join run on part = 1 and run.pos = u0.pos // cast(pow(3, lvl) as bigint)
),
way as (select *, row_number() over (partition by g, pos order by part, lvl) as k from step),
fold as (
  select g, pos, 0 as k, checked as h from d
  union all
  select f.g, f.pos, f.k + 1, sha256(l || h || r) from fold f join way w on w.g = f.g and w.pos = f.pos and w.k = f.k + 1
),
proof as (select g, pos, string_agg(l || r, '' order by k) as p from way group by g, pos),
folded as (select g, pos, arg_max(h, k) as h from fold group by g, pos)
select doc_id, leaf, u0.h as subroot, top.h as root, sha256(coalesce(p, '')) as proof_sha256, folded.h as folded_root, folded.h = top.h as verified
from d join u0 on u0.name = d.g join (select h from u where n = 1) top on true join folded on folded.g = d.g and folded.pos = d.pos left join proof on proof.g = d.g and proof.pos = d.pos
"""

#: Bytes as pairs of hex digits; strings of 50 bytes at every place.
OP13_SQL = """
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select rid, doc_id, unnest(range(len(x) // 2 - 49)) as p, x from d where len(x) >= 100),
s as (select rid, doc_id, p, substr(x, 2 * p + 1, 100) as s from w),
hit as (select rid, p from s join (select s, min(doc_id) as least from s group by s) using (s) where least < doc_id),
mark as (select rid, p, coalesce(p > lag(p) over (partition by rid order by p) + 50, true) as new from hit),
grp as (select rid, p, count(*) filter (new) over (partition by rid order by p) as k from mark),
span as (select rid, k, min(p) as a, max(p) + 50 as z from grp group by rid, k),
gap as (
  select rid, coalesce(lag(z) over (partition by rid order by a), 0) as a, a as z from span
  union all select rid, max(z), 1000000000 from span group by rid
),
kept as (select rid, string_agg(substr(x, 2 * a + 1, 2 * (z - a)), '' order by a) as x from gap join d using (rid) group by rid),
lost as (select rid, cast(sum(z - a) as bigint) as n, count(*) as k from span group by rid)
select doc_id, cast(len(d.x) // 2 as bigint) as n_bytes, coalesce(n, 0) as n_removed, coalesce(k, 0) as n_spans, sha256(unhex(coalesce(kept.x, d.x))) as kept_sha256
from d left join kept using (rid) left join lost using (rid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return {**own, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": OP2_SQL, "op4_line_dedup": OP4_SQL, "op8_decontamination": OP8_SQL, "op9_exact_topk": OP9_SQL, "op10_warc": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_suffix_dedup": OP13_SQL}
