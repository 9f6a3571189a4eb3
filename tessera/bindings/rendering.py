"""Rendered texts over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.operators import rendering
from tessera.sources import files


@query("SELECT o_orderkey, '[' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) || '] ' || o_orderpriority || ' (' || o_orderdate::DATE || ') - ' || o_orderstatus AS citation FROM orders")
def citations_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").withColumn("nth", nth).select("o_orderkey", rendering.citation(F.col("o_orderpriority"), day, F.col("o_orderstatus"), F.col("nth")).alias("citation"))


@query("SELECT o_orderkey, monthname(o_orderdate) || ' ' || day(o_orderdate) AS year_end FROM orders")
def fiscal_year_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d")).otherwise(F.date_format("o_orderdate", "--MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rendering.fiscal_year_end(shown).alias("year_end"))


@query("SELECT c_nationkey, c_custkey // 200 AS block, list(DISTINCT 'Pat ' || c_mktsegment[1:1] || lower(c_mktsegment[2:]) ORDER BY 'Pat ' || c_mktsegment[1:1] || lower(c_mktsegment[2:])) AS members FROM customer GROUP BY 1, 2")
def board_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments as members named in tagged facts, a page for every 200 customer numbers of a nation."""
    tag = F.concat(F.lit('<xbrldi:explicitMember dimension="ecd:IndividualAxis">co:Pat'), F.initcap(F.lower("c_mktsegment")), F.lit("Member</xbrldi:explicitMember>"))
    customers = table(spark, sf_dir, "customer").withColumn("block", F.expr("c_custkey div 200"))
    pages = rendering.joined(customers, ["c_nationkey", "block"], "c_custkey", tag, "html")
    return pages.select("c_nationkey", "block", rendering.board_members(F.col("html")).alias("members"))


@query("SELECT conv_id, string_agg('[' || role || ' ' || turn || ']' || chr(10) || CASE WHEN length(text) > 4000 THEN text[1:4000] || '...' ELSE text END, chr(10) || '---' || chr(10) ORDER BY turn) AS context FROM conversations WHERE turn < 15 GROUP BY 1")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 turns of each conversation as hits, each of 4000 characters at most, as in production."""
    hits = table(spark, sf_dir, "conversations").withColumn("rank", F.col("turn") + 1)
    return rendering.prompt(hits, "conv_id", "rank", F.concat_ws(" ", "role", "turn"), F.col("text"))


@query("SELECT conv_id, 'Risk' AS section, 'Q1.' || (turn + 1) AS id, CASE role WHEN 'assistant' THEN 'answered' ELSE 'pending' END AS status, md5(q) AS question, CASE role WHEN 'assistant' THEN md5(q) END AS answer FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM conversations) WHERE q <> ''")
def question_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as questions, on one line each, written as a file and read again; what an assistant says is the answer, too."""
    said = F.trim(F.regexp_replace("text", r"\s+", " "))
    asked = table(spark, sf_dir, "conversations").select("conv_id", F.lit("Risk").alias("section"), F.concat(F.lit("Q1."), F.col("turn") + 1).alias("id"), F.lit("deep").alias("depth"), F.when(F.col("role") == "assistant", "answered").otherwise("pending").alias("status"), said.alias("question"), F.when(F.col("role") == "assistant", said).alias("answer"))
    read = files.questions(rendering.question_file(asked, "conv_id"), "conv_id", "text")
    return read.select("conv_id", "section", "id", "status", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query(
    """WITH s AS (SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1), r AS (SELECT source, sum(n)::BIGINT AS n, sum(chars)::BIGINT AS chars FROM s GROUP BY ROLLUP (source))
    SELECT string_agg(rpad(coalesce(source, 'TOTAL'), 30, ' ') || lpad(n::VARCHAR, 10, ' ') || lpad(chars::VARCHAR, 10, ' '), chr(10) ORDER BY source IS NULL, source) AS table FROM r"""
)
def stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return rendering.stats_table(stats, "source", ["n", "chars"])


@query(
    """WITH w AS (SELECT n_regionkey, greatest(3, max(length(n_name))) AS a, greatest(3, max(length(n_nationkey::VARCHAR))) AS b FROM nation GROUP BY 1)
    SELECT n_regionkey, string_agg('| ' || '**' || n_name || '**' || repeat(' ', (a - length(n_name))::INT) || ' | ' || rpad(n_nationkey::VARCHAR, b::INT, ' ') || ' |', chr(10) ORDER BY n_nationkey) AS text FROM nation JOIN w USING (n_regionkey) GROUP BY 1"""
)
def table_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.array(F.concat(F.lit("**"), F.col("n_name"), F.lit("**")), F.col("n_nationkey").cast("string")).alias("cells"))
    return rendering.align(rows, "n_regionkey", "n_nationkey", "cells")


@query()
def wrapped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents wrapped at 80 characters: number of lines, longest line, hash."""
    wrapped = table(spark, sf_dir, "documents").select("doc_id", rendering.wrap(F.col("text"), 80).alias("text"))
    lines = F.split("text", "\n")
    return wrapped.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.array_max(F.transform(lines, F.length)).cast("long").alias("longest"), F.md5("text").alias("hash"))


@query(
    """WITH s AS (SELECT source AS section, lang, CASE lang WHEN 'en' THEN 'high' WHEN 'fr' THEN 'medium' ELSE 'low' END AS weight, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1, 2),
    w AS (SELECT lang, weight, string_agg('### ' || section || ': ' || first || CASE WHEN n > 30 THEN ' (truncated)' ELSE '' END || chr(10) || chr(10) || n, chr(10) || chr(10) ORDER BY section) AS body FROM s GROUP BY 1, 2)
    SELECT lang, '# ' || lang || chr(10) || chr(10) || '## ' || upper(weight[1:1]) || weight[2:] || ' weight' || chr(10) || chr(10) || body AS text FROM w"""
)
def summary_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("lang") == "en", "high").when(F.col("lang") == "fr", "medium").otherwise("low")
    parts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("section"), "lang").agg(F.min("doc_id").cast("string").alias("title"), F.count(F.lit(1)).alias("n"))
    parts = parts.select("lang", "section", "title", weight.alias("weight"), F.col("n").cast("string").alias("summary"), (F.col("n") > 30).alias("truncated"))
    return rendering.summary(parts, "lang", F.concat(F.lit("# "), F.col("lang")))


@query(
    """WITH r AS (SELECT conv_id, turn + 1 AS rank, role AS filing_type, CASE WHEN turn % 2 = 0 THEN '2024-01-0' || (turn % 9 + 1) END AS filing_date, text, turn % 3 = 0 AS has_table FROM conversations WHERE turn < 10)
    SELECT conv_id, count(*)::INT AS result_count, string_agg(filing_type || '|' || coalesce(filing_date, '-') || '|' || md5(text) || '|' || CASE WHEN has_table THEN 'c' || rank ELSE '-' END, ',' ORDER BY rank) AS results FROM r GROUP BY 1"""
)
def results_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten turns of a conversation as results, exported as JSON and read again."""
    turns = table(spark, sf_dir, "conversations").where("turn < 10")
    results = turns.select("conv_id", (F.col("turn") + 1).alias("rank"), F.col("role").alias("filing_type"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("2024-01-0"), F.col("turn") % 9 + 1)).alias("filing_date"), F.lit("s").alias("section"), F.lit(0.5).alias("score"), "text", (F.col("turn") % 3 == 0).alias("has_table"), F.lit("<table>").alias("table_html"), F.concat(F.lit("c"), F.col("turn") + 1).alias("table_caption"))
    shown = rendering.results_json(results, "conv_id", "rank", {"query": F.lit("why?"), "mode": F.lit("hybrid"), "top_k": F.lit(10)})
    read = shown.select("conv_id", F.from_json("json", "result_count int, results array<struct<filing_type:string,filing_date:string,text:string,table_caption:string>>").alias("j"))
    line = F.transform("j.results", lambda r: F.concat_ws("|", r["filing_type"], F.coalesce(r["filing_date"], F.lit("-")), F.md5(r["text"]), F.coalesce(r["table_caption"], F.lit("-"))))
    return read.select("conv_id", "j.result_count", F.array_join(line, ",").alias("results"))


@query(
    """WITH s AS (SELECT source AS section, lang, CASE lang WHEN 'en' THEN 'high' WHEN 'fr' THEN 'medium' ELSE 'low' END AS weight, min(doc_id)::VARCHAR AS title, count(*) AS n FROM documents GROUP BY 1, 2)
    SELECT lang, lang || ' summary' AS head, section, title, weight, n > 30 AS truncated, n || chr(10) || chr(10) || 'documents' AS summary FROM s"""
)
def summary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries rendered and read again."""
    weight = F.when(F.col("lang") == "en", "high").when(F.col("lang") == "fr", "medium").otherwise("low")
    parts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("section"), "lang").agg(F.min("doc_id").cast("string").alias("title"), F.count(F.lit(1)).alias("n"))
    parts = parts.select("lang", "section", "title", weight.alias("weight"), F.concat(F.col("n"), F.lit("\n\ndocuments")).alias("summary"), (F.col("n") > 30).alias("truncated"))
    rendered = rendering.summary(parts, "lang", F.concat(F.lit("# "), F.col("lang"), F.lit(" summary")))
    return rendering.read_summary(rendered, "lang", "text").drop("at")


@query("SELECT doc_id, length(text) AS chars, CASE WHEN doc_id % 4 = 0 THEN rtrim(substr(text, 1, 500)) ELSE '' END AS note FROM (SELECT doc_id, replace(text, chr(10) || chr(10), chr(10)) AS text FROM documents)")
def marked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth document has a mark in front, without a blank line after it."""
    bare = F.replace("text", F.lit("\n\n"), F.lit("\n"))
    marked = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("**Note"), bare)).otherwise(bare)
    note = F.regexp_replace(rendering.marked_note(marked, "**Note", 506), r"^\*\*Note", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(bare).alias("chars"), F.when(F.col("doc_id") % 4 == 0, note).otherwise(F.lit("")).alias("note"))


_WIDE = "greatest(length(p_name), length(p_brand), 4)::INT"
_NARROW = "greatest(length(p_size::VARCHAR), 4)::INT"


@query(
    f"""SELECT p_partkey, 'Intro of ' || p_name || chr(10) || chr(10) || '| ' || rpad('name', {_WIDE}, ' ') || ' | **size** ' || repeat(' ', {_NARROW} - 4) || '|' || chr(10)
    || '| :' || repeat('-', {_WIDE} - 1) || ' | ' || repeat('-', {_NARROW} - 1) || ': |' || chr(10) || '| ' || rpad(p_name, {_WIDE}, ' ') || ' | **' || p_size || '**' || repeat(' ', {_NARROW} - length(p_size::VARCHAR)) || ' |' || chr(10)
    || '| _' || p_brand || '_' || repeat(' ', {_WIDE} - length(p_brand)) || ' | ' || repeat(' ', {_NARROW}) || ' |' || chr(10) || 'a | b' || chr(10) || '| x |' || chr(10) || '> | no table' AS text FROM part"""
)
def table_realign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with two tables between paragraphs, of several widths, with bold and italic cells and a row that is short."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("Intro of "), F.col("p_name"), F.lit("\n\n|name|**size**|\n|:--|-:|\n| "), F.col("p_name"), F.lit(" |**"), size, F.lit("**|\n  |_"), F.col("p_brand"), F.lit("_|\na | b\n|x|\n> | no table"))
    return table(spark, sf_dir, "part").select("p_partkey", rendering.realign(text).alias("text"))
