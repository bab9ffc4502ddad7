"""Registered queries of the thirteen operators: each applies its operator to whole tables and derives the digest columns from the
operator's outputs. SQL is given where DuckDB can express the result on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_repeats, decontaminate, exact_dedup, hard_negatives, jaccard, licences, line_crf, quality_rank, ranked_search, tool_calls, toxicity, word_repeats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def span_total(spans: str) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def fold(count: int) -> F.Column:
    """The part of a document by its id, which keeps rows to test on out of what labels teach."""
    return F.crc32(F.col("doc_id").cast("string")) % count


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The operator's columns with n_hit and the contract's verdict: some words hit, and a twentieth of all at least."""
    found = decontaminate.find_contamination(documents, benchmark).withColumn("n_hit", span_total("hits"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), "contaminated")


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    done = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.character_model(docs)
    evidence = toxicity.learn_evidence(docs, table(spark, sf_dir, "labels").where(fold(4) != 2), model, "doc_id", "text", "toxic")
    done = toxicity.score_texts(docs, model, evidence)
    return done.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text_sha256", "license_id", F.size("notices").cast("long").alias("n_notices"), F.concat_ws(",", "notices").alias("notices"))


@query
def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranking = quality_rank.fit_ranking(docs, table(spark, sf_dir, "labels").where(fold(5) != 0), "doc_id", "text", "quality")
    return quality_rank.rank(docs, ranking).select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: What the calls made of conversation turns may hold.
SCHEMAS = (("answer", "limit", "integer", True), ("answer", "text", "string", True), ("answer", "urgent", "boolean", False), ("instruct", "text", "string", True))


@query
def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and system turns are calls, which come after the turn two before; an assistant turn is the result of the turn before it."""
    turns = table(spark, sf_dir, "conversations")
    at = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    asked = F.to_json(F.struct(F.coalesce(F.length("text"), F.lit(0)).alias("limit"), "text", F.contains("text", F.lit("!")).alias("urgent")))
    calls = turns.where("role in ('user', 'system')").select(at(0).alias("call_id"), at(2).alias("after"), F.when(F.col("role") == "user", "answer").otherwise("instruct").alias("tool"),
                                                           F.when(F.col("role") == "user", asked).otherwise(F.to_json(F.struct("text"))).alias("arguments"))
    results = turns.where("role = 'assistant'").select(at(1).alias("call_id"), F.col("text").alias("content"))
    done = tool_calls.link_calls(calls, results, spark.createDataFrame(list(SCHEMAS), "tool string, field string, type string, required boolean"))
    return done.select("call_id", "n_calls", "n_results", "step", "valid", "json")


@query
def op8_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = byte_repeats.remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), span_total("removed").alias("n_removed"),
                       F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = word_repeats.remove_repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", span_total("removed").alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def line_field(spark: SparkSession, docs: DataFrame, sf_dir: str) -> line_crf.Field:
    return line_crf.fit_field(docs, table(spark, sf_dir, "labels").where(fold(5) != 0), "doc_id", "text", "quality")


@query
def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_crf.judge_lines(docs, line_field(spark, docs, sf_dir))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_copies(table(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are shifted; every hundredth row is an anchor."""
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


ORACLES["op1_decontaminate"] = r"""
with cut as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
bench as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
passages as (
  select distinct item_id, least(len(ws), 13) as size, array_to_string(ws[p : p + least(len(ws), 13) - 1], ' ') as passage
  from (select item_id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) as p from bench where len(ws) > 0)),
sizes as (select distinct size from passages),
grams as (
  select doc_id, size, p, array_to_string(ws[p : p + size - 1], ' ') as passage
  from (select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) as p from cut, sizes where len(ws) >= size)),
found as (select g.doc_id, g.size, g.p, b.item_id from grams g join passages b on g.size = b.size and g.passage = b.passage),
hit as (select doc_id, count(distinct p + k) as n_hit from (select distinct doc_id, size, p from found) f, range(13) t(k) where k < size group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from (select distinct doc_id, item_id from found) group by doc_id)
select c.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from cut c left join hit using (doc_id) left join named using (doc_id)
"""

ORACLES["op4_licences"] = (r"""
with known as (select * from (values """ + ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in licences.KNOWN) + r""") as k(license_id, text)),
texts as (select 0 as known, doc_id, cast(null as varchar) as license_id, coalesce(text, '') as text from documents union all select 1, null, license_id, text from known),
a as (select known, doc_id, license_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from texts),
b as (select known, doc_id, license_id, regexp_replace(t, '(?m)^[ \t#*/;-]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*', '', 'g') as t from a),
c as (select known, doc_id, license_id, regexp_replace(replace(replace(replace(t, 'licence', 'license'), 'sub-license', 'sublicense'), 'non-commercial', 'noncommercial'), 'copyright (?:owner|holder)s?', 'copyright holder', 'g') as t from b),
d as (select known, doc_id, license_id, regexp_replace(regexp_replace(regexp_replace(t, 'https?://', 'http ', 'g'), '[^\p{L}\p{N}\n]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g') as t from c),
form as (select *, sha256(trim(replace(t, chr(10), ' '))) as sha from d),
sure as (select sha, min(license_id) as license_id from form where known = 1 group by sha),
line as (select doc_id, sha256(trim(unnest(string_split(t, chr(10))))) as sha from form where known = 0),
named as (select doc_id, count(distinct license_id) as n, string_agg(distinct license_id, ',' order by license_id) as ids from line join sure using (sha) group by doc_id)
select f.doc_id, f.sha as text_sha256, s.license_id, coalesce(n, 0)::bigint as n_notices, coalesce(ids, '') as notices
from form f left join sure s on f.sha = s.sha left join named m on f.doc_id = m.doc_id where known = 0
""")

ORACLES["op7_tool_calls"] = r"""
with recursive calls as (
  select conv_id, turn, conv_id || ':' || turn as call_id, conv_id || ':' || (turn - 2) as after, case role when 'user' then 'answer' else 'instruct' end as tool,
    case role when 'user' then json_object('limit', length(text), 'text', text, 'urgent', contains(text, '!')) else json_object('text', text) end as arguments
  from conversations where role in ('user', 'system')),
depth as (
  select c.call_id, c.conv_id, c.turn, 0 as step from calls c where not exists (select 1 from calls p where p.call_id = c.after)
  union all select c.call_id, c.conv_id, c.turn, d.step + 1 from calls c join depth d on c.after = d.call_id),
answers as (select conv_id || ':' || (turn - 1) as call_id, text from conversations where role = 'assistant')
select c.call_id, 1::bigint as n_calls, (case when a.call_id is null then 0 else 1 end)::bigint as n_results, d.step::bigint as step, true as valid,
  json_object('after', c.after, 'arguments', c.arguments, 'id', c.call_id, 'result', a.text, 'step', d.step, 'tool', c.tool, 'valid', true)::varchar as json
from calls c left join depth d using (call_id) left join answers a using (call_id)
"""

ORACLES["op9_word_repeats"] = r"""
with cut as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
grams as (select doc_id, p, array_to_string(ws[p : p + 34], ' ') as gram from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as p from cut where len(ws) >= 35)),
twice as (select gram from grams group by gram having count(*) > 1),
gone as (select distinct doc_id, p + k as p from (select doc_id, p from grams join twice using (gram)), range(35) t(k)),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from cut),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as text from words anti join gone using (doc_id, p) group by doc_id)
select c.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from cut c left join kept k using (doc_id)
"""

ORACLES["op11_ranked_search"] = r"""
with cut as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
corpus as (select count(*)::bigint as n, sum(len(ws))::bigint as l from cut where len(ws) > 0),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
entries as (select doc_id, size, term, count(*)::bigint as tf from (select doc_id, len(ws)::bigint as size, unnest(ws) as term from cut) group by all),
weights as (select term, floor(1000 * ln((2 * max(n) + 2)::double / (2 * count(*) + 1)))::bigint as w from entries, corpus where term in (select term from asked) group by term),
scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * size * n) // l))))::bigint as score
  from asked join weights using (term) join entries using (term), corpus group by item_id, doc_id)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0) where rank <= 50
"""

ORACLES["op12_exact_dedup"] = r"""
with cut as (select doc_id, length(coalesce(text, '')) as size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as plain from documents),
grouped as (select *, first_value(doc_id) over (partition by plain order by size desc, doc_id) as keep_id, count(*) over (partition by plain) as group_size from cut)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(plain) as text_sha256 from grouped
"""

ORACLES["op13_hard_negatives"] = r"""
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select vec_id, label, unnest(v) as x, unnest(range(len(v))) as p from usable),
scores as (
  select a.vec_id as anchor_id, a.label = c.label as alike, c.vec_id, sum(a.x * c.x)::bigint as score
  from parts a join parts c on a.p = c.p and a.vec_id <> c.vec_id where a.vec_id % 100 = 0 group by all),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r from scores where alike) where r <= 5),
negatives as (
  select anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from positives join scores s using (anchor_id) where not alike and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from negatives where rank <= 10
"""
