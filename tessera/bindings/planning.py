"""Summary planning over documents as sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import lexicon
from tessera.bindings.retrieval import new_folder
from tessera.catalog import query, table
from tessera.functions import text as text_functions
from tessera.operators import planning, rendering

_NAMES = ["Item 1", "Item-1A", "ITEM 7", "Item  8", "Exhibits & Schedules"]
_WEIGHTS = ", ".join(f"('{k}', '{w}', {n})" for k, (w, n, _) in lexicon.SECTION_WEIGHTS.items())
_SECTIONS = f"SELECT doc_id, text, {list(_NAMES)!r}[(doc_id % 5 + 1)::INT] AS section FROM documents"
_KEY = "trim(regexp_replace(replace(replace(lower(trim(section)), '&', ' and '), '-', ' '), '\\s+', ' ', 'g'))"


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, _NAMES))
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("section"))


def _planned(high: int, other: int) -> str:
    """SQL of the plan: paragraphs, or the sentences of those too long, packed by their characters."""
    over = "u.opens OR g.size + u.size > u.most"
    return f"""WITH RECURSIVE w(k, weight, base) AS (VALUES {_WEIGHTS}), s AS (SELECT *, CASE weight WHEN 'high' THEN {high} ELSE {other} END AS most,
      'd' || doc_id || '_' || trim(regexp_replace(regexp_replace(replace(section, '&', '-and-'), '\\s', '-', 'g'), '-+', '-', 'g'), '-') AS name
      FROM (SELECT doc_id, section, text, coalesce(weight, 'medium') AS weight, coalesce(base, 800) AS base FROM ({_SECTIONS}) LEFT JOIN w ON k = {_KEY})),
    p AS (SELECT doc_id, most, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0) AS ps FROM s WHERE length(text) > most),
    e AS (SELECT doc_id, most, generate_subscripts(ps, 1) AS i, unnest(ps) AS t FROM p),
    x AS (SELECT doc_id, most, i, string_split(replace(t, '. ', '.' || chr(1)), chr(1)) AS xs FROM e WHERE length(t) + 2 > most),
    c AS (SELECT doc_id, most, i, 0 AS j, t, length(t) + 2 AS size, false AS opens FROM e WHERE length(t) + 2 <= most
      UNION ALL SELECT doc_id, most, i, j, t, length(t), j = 1 FROM (SELECT doc_id, most, i, generate_subscripts(xs, 1) AS j, unnest(xs) AS t FROM x)),
    u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM c),
    g AS (SELECT doc_id, k, size, 0 AS part FROM u WHERE k = 1
      UNION ALL SELECT u.doc_id, u.k, CASE WHEN {over} THEN u.size ELSE g.size + u.size END, CASE WHEN {over} THEN g.part + 1 ELSE g.part END FROM g JOIN u ON u.doc_id = g.doc_id AND u.k = g.k + 1),
    cut AS (SELECT doc_id, part, string_agg(t, chr(10) || chr(10) ORDER BY k) AS t FROM g JOIN u USING (doc_id, k) GROUP BY 1, 2 UNION ALL SELECT doc_id, 0, text FROM s WHERE length(text) <= most),
    n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS parts FROM cut)
    SELECT doc_id, weight, part::BIGINT AS part, parts, length(t)::BIGINT AS chars, md5(t) AS text, least(greatest(base, floor(floor(length(t) / 4) * 0.6))::INT, 32000) AS max_tokens,
    name || CASE WHEN parts > 1 THEN '_part' || (part + 1) ELSE '' END AS custom_id FROM n JOIN s USING (doc_id)"""


def _plan(spark: SparkSession, sf_dir: str, **limits) -> DataFrame:
    planned = planning.plan(_sections(spark, sf_dir), "section", "text", F.concat(F.lit("d"), F.col("doc_id")), planning.weights(spark), **limits)
    return planned.select("doc_id", "weight", F.col("part").cast("long").alias("part"), F.col("parts").cast("long").alias("parts"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("text"), "max_tokens", "custom_id")


@query(_planned(planning.HIGH_CHARS, planning.OTHER_CHARS))
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests within the limits of production."""
    return _plan(spark, sf_dir)


@query(_planned(4000, 2000))
def batch_plan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow limits, so that most documents are cut."""
    return _plan(spark, sf_dir, high_chars=4000, other_chars=2000)


@query("SELECT 'c' || conv_id AS section, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS summary, sum(length(text))::BIGINT AS tokens, bool_or(length(text) > 900) AS truncated, count(*) AS parts FROM conversations GROUP BY 1")
def batch_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as parts of a conversation's summary."""
    parts = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("_part"), F.col("turn") + 1).alias("custom_id"), F.col("text").alias("summary"), F.length("text").alias("tokens"), (F.length("text") > 900).alias("truncated"))
    return planning.regroup(parts)


@query("SELECT source || ' & ' || lang AS section, max(doc_id) FILTER (doc_id % 2 = 1) IS NOT NULL AS renewed FROM documents WHERE doc_id < 100000000 GROUP BY 1")
def section_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections named by source and language; those with an odd document come again under another spelling."""
    docs = table(spark, sf_dir, "documents")
    old = docs.select(F.concat_ws(" & ", "source", "lang").alias("section")).distinct().withColumn("renewed", F.lit(False))
    new = docs.where("doc_id % 2 = 1").select(F.concat_ws("-and-", F.upper("source"), "lang").alias("section")).distinct().withColumn("renewed", F.lit(True))
    merged = planning.merge_sections(old, new, "section")
    return merged.select(F.regexp_replace(F.lower("section"), "-and-", " & ").alias("section"), "renewed")


@query("SELECT DISTINCT source || ' & ' || lang AS section FROM documents EXCEPT SELECT source || ' & ' || lang FROM documents WHERE doc_id % 2 = 1")
def missing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    expected = docs.select(F.concat_ws(" & ", "source", "lang").alias("section")).distinct()
    made = docs.where("doc_id % 2 = 1").select(F.concat_ws("-and-", F.upper("source"), "lang").alias("section")).distinct()
    return planning.missing(expected, made, "section")


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(p_name || ' & (' || p_type || ')', '&', '-and-'), '[,():''\"]', '', 'g'), '[\\s/]', '-', 'g'), '-+', '-', 'g'), '-') AS custom_id FROM part")
def custom_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("p_name"), F.lit(" & ("), F.col("p_type"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", text_functions.custom_id(raw).alias("custom_id"))


@query("SELECT p_partkey, length(p_name) + 1 + length(p_brand) AS width FROM part")
def display_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("**"), F.col("p_name"), F.lit("** *"), F.col("p_brand"), F.lit("*"))
    return table(spark, sf_dir, "part").select("p_partkey", text_functions.display_width(shown).cast("long").alias("width"))


@query("SELECT lang, source, min(doc_id) AS first_doc, '[' || lang || ' (' || source || ')]' AS citation FROM documents GROUP BY 1, 2")
def citations_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of language and source once, with the first document that cites it."""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("first_doc")).withColumn("citation", F.format_string("[%s (%s)]", "lang", "source"))


_PROMPT = " ".join(f"WHEN '{w}' THEN {chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39)}" for w, p in rendering.PROMPTS.items())
_GUIDES = ", ".join(f"('{k}', '{w}', '{g}')" for k, (w, _, g) in lexicon.SECTION_WEIGHTS.items())


@query(
    f"""WITH w(k, weight, guidance) AS (VALUES {_GUIDES}) SELECT doc_id, CASE coalesce(weight, 'medium') {_PROMPT} END || CASE WHEN coalesce(guidance, '') = '' THEN '' ELSE chr(10) || chr(10) || 'For this section: ' || guidance END AS prompt
    FROM ({_SECTIONS}) LEFT JOIN w ON k = {_KEY}"""
)
def section_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = planning.with_weights(_sections(spark, sf_dir), "section", planning.weights(spark))
    return weighted.select("doc_id", rendering.section_prompt(F.col("weight"), F.col("guidance")).alias("prompt"))


_BASE = f"""SELECT doc_id, section, length(text) AS chars, coalesce(base, 800) AS base, 'd' || doc_id || '_' || trim(regexp_replace(regexp_replace(replace(section, '&', '-and-'), '\\s', '-', 'g'), '-+', '-', 'g'), '-') AS custom_id,
greatest(coalesce(base, 800), floor(floor(length(text) / 4) * 0.6))::INT AS lim FROM ({_SECTIONS}) LEFT JOIN (VALUES {_WEIGHTS}) w(k, weight, base) ON k = {_KEY} WHERE length(text) <= 50000"""


def _answers(requests: DataFrame) -> DataFrame:
    """Stands for a model that needs as many tokens as half of the characters."""
    return requests.select("doc_id", "custom_id", "max_tokens", (F.floor(F.length("text") / 2) > F.col("max_tokens")).alias("truncated"))


@query(f"SELECT doc_id, custom_id, least(floor(lim * 1.5)::INT, 32000) AS max_tokens FROM ({_BASE}) WHERE chars // 2 > least(lim, 32000)")
def resubmit_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose answer was cut off, planned again with half as much again; no others."""
    sections, weights, prefix = _sections(spark, sf_dir), planning.weights(spark), F.concat(F.lit("d"), F.col("doc_id"))
    first = _answers(planning.plan(sections, "section", "text", prefix, weights))
    return planning.resubmit(sections, first, "section", "text", prefix, weights).select("doc_id", "custom_id", "max_tokens")


@query(
    f"""WITH r AS (SELECT *, unnest(range(10)) AS round FROM ({_BASE})), t AS (SELECT *, least(CASE WHEN round = 0 THEN lim ELSE floor(lim * pow(1.5, round))::INT END, 32000) AS max_tokens FROM r)
    SELECT doc_id, custom_id, round::INT AS round, max_tokens, chars // 2 > max_tokens AS truncated FROM t WHERE NOT (chars // 2 > max_tokens AND max_tokens < 32000) QUALIFY row_number() OVER (PARTITION BY doc_id, custom_id ORDER BY round) = 1"""
)
def plan_until_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan, answer, and plan again what was cut off, with limits that rise until nothing is."""
    prefix = F.concat(F.lit("d"), F.col("doc_id"))
    return planning.until_whole(_sections(spark, sf_dir), "section", "text", prefix, planning.weights(spark), _answers, new_folder(spark, "rounds"))
