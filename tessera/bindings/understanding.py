"""Questions about orders, put together from the orders table, and what is understood of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import lexicon
from tessera.catalog import query, table
from tessera.operators import understanding

_ASK = """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'What was total revenue in Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) || '?'
 WHEN 1 THEN 'Compare FCF in FY' || lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') || ' with the prior year' WHEN 2 THEN 'Why did risk and guidance change in ' || year(o_orderdate) || '?'
 WHEN 3 THEN 'How has EPS grown over the past years, growth since ' || year(o_orderdate) WHEN 4 THEN 'Who is the CEO of Acme Holdings?'
 WHEN 5 THEN 'Explain cash flow and supply chain strategy' WHEN 6 THEN 'FY' || year(o_orderdate) || ' sales versus ' || (year(o_orderdate) - 1) ELSE o_orderpriority END AS q FROM orders"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, k = F.year("o_orderdate"), F.col("o_orderkey") % 8
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    text = (
        F.when(k == 0, said("What was total revenue in Q", F.quarter("o_orderdate"), " ", year, "?"))
        .when(k == 1, said("Compare FCF in FY", F.lpad((year % 100).cast("string"), 2, "0"), " with the prior year"))
        .when(k == 2, said("Why did risk and guidance change in ", year, "?"))
        .when(k == 3, said("How has EPS grown over the past years, growth since ", year))
        .when(k == 4, F.lit("Who is the CEO of Acme Holdings?"))
        .when(k == 5, F.lit("Explain cash flow and supply chain strategy"))
        .when(k == 6, said("FY", year, " sales versus ", year - 1))
        .otherwise(F.col("o_orderpriority"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("q"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _score(name: str) -> str:
    patterns, as_written = lexicon.QUERY_KINDS[name]
    seen = "q" if as_written else "lower(q)"
    return " + ".join(f"regexp_matches({seen}, {_sql(p)})::INT" for p in patterns)


_KINDS = list(lexicon.QUERY_KINDS)
_SCORED = f"SELECT o_orderkey, {', '.join(f'{_score(k)} AS {k}' for k in _KINDS)} FROM ({_ASK})"
_TOP = f"SELECT *, greatest({', '.join(_KINDS)}) AS top, list_sort([{', '.join(_KINDS)}], 'DESC')[2] AS second FROM ({_SCORED})"


@query(
    f"""SELECT o_orderkey, CASE WHEN top = 0 THEN 'default' {' '.join(f"WHEN {k} = top THEN '{k}'" for k in _KINDS)} END AS kind,
    round(CASE WHEN top = 0 THEN 0.5 WHEN second > 0 THEN least(0.9, 0.5 + 0.2 * (top - second)) ELSE least(0.9, 0.5 + 0.15 * top) END, 4)::DOUBLE AS confidence FROM ({_TOP})"""
)
def query_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("o_orderkey", understanding.classify(F.col("q")).alias("c")).select("o_orderkey", "c.kind", F.round("c.confidence", 4).alias("confidence"))


_ACRONYMS = ", ".join(f"({i}, {_sql(k)}, {_sql(v)})" for i, (k, v) in enumerate(lexicon.ACRONYMS.items()))
_SYNONYMS = ", ".join(f"({_sql(k)}, {_sql(s)})" for k, v in lexicon.SYNONYMS.items() for s in v)


@query(
    f"""WITH a(i, name, phrase) AS (VALUES {_ACRONYMS}), s(head, synonym) AS (VALUES {_SYNONYMS}), asked AS ({_ASK}),
    w AS (SELECT o_orderkey, q, unnest(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_&/-]+')) AS word FROM asked),
    found AS (SELECT o_orderkey, q, phrase AS x FROM w JOIN a ON upper(word) = name UNION SELECT o_orderkey, q, name FROM asked JOIN a ON contains(lower(q), lower(phrase))
      UNION SELECT o_orderkey, q, synonym FROM w JOIN s ON lower(word) = head WHERE NOT contains(head, ' ') UNION SELECT o_orderkey, q, synonym FROM asked JOIN s ON contains(lower(q), head) WHERE contains(head, ' '))
    SELECT o_orderkey, string_agg(x, '|' ORDER BY x) AS expansions FROM found WHERE NOT contains(lower(q), lower(x)) GROUP BY 1"""
)
def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _asked(spark, sf_dir).select("o_orderkey", F.array_sort(understanding.expand(F.col("q"))).alias("x"))
    return found.where(F.size("x") > 0).select("o_orderkey", F.array_join("x", "|").alias("expansions"))


_ORDERED = ", ".join(f"({h}, {i}, {_sql(k)}, {_sql(x)})" for h, (k, v) in enumerate(lexicon.SYNONYMS.items()) for i, x in enumerate(v))


@query(
    f"""WITH a(i, name, phrase) AS (VALUES {_ACRONYMS}), s(h, i, head, synonym) AS (VALUES {_ORDERED}), asked AS ({_ASK}),
    ws AS (SELECT o_orderkey, q, regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_&/-]+') AS ws FROM asked), w AS (SELECT o_orderkey, q, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM ws),
    found AS (SELECT o_orderkey, q, phrase AS x, pos AS place FROM w JOIN a ON upper(word) = name UNION ALL SELECT o_orderkey, q, name, 1000000 + i FROM asked JOIN a ON contains(lower(q), lower(phrase))
      UNION ALL SELECT o_orderkey, q, synonym, 2000000 + 1000 * pos + i FROM w JOIN s ON lower(word) = head WHERE NOT contains(head, ' ') UNION ALL SELECT o_orderkey, q, synonym, 3000000 + 1000 * h + i FROM asked JOIN s ON contains(lower(q), head) WHERE contains(head, ' ')),
    first AS (SELECT o_orderkey, x, min(place) AS place FROM found WHERE NOT contains(lower(q), lower(x)) GROUP BY 1, 2)
    SELECT asked.o_orderkey, any_value(q) || coalesce(string_agg(' OR ' || CASE WHEN contains(x, ' ') THEN '"' || x || '"' ELSE x END, '' ORDER BY place), '') AS text_query FROM asked LEFT JOIN first USING (o_orderkey) GROUP BY 1"""
)
def text_query_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    return _asked(spark, sf_dir).select("o_orderkey", understanding.text_query(q, understanding.expand(q)).alias("text_query"))


@query(
    f"""WITH asked AS ({_ASK}), f AS (SELECT o_orderkey, q, list_distinct(list_transform(regexp_extract_all(upper(q), '\\bFY\\s?(\\d{{4}}|\\d{{2}})\\b', 1), lambda y: CASE WHEN length(y) = 2 THEN '20' || y ELSE y END::INT)) AS fy,
      list_distinct(list_transform(regexp_extract_all(upper(q), '\\b((?:19|20)\\d{{2}})\\b', 1), lambda y: y::INT)) AS cy, regexp_extract_all(upper(q), '\\bQ[1-4] (?:19|20)\\d{{2}}\\b') AS qs FROM asked),
    r AS (SELECT o_orderkey, unnest(fy) AS year, NULL::INT AS quarter, 'fiscal' AS kind FROM f UNION ALL SELECT o_orderkey, unnest(list_filter(cy, lambda y: NOT list_contains(fy, y))), NULL, 'calendar' FROM f
      UNION ALL SELECT o_orderkey, x[4:7]::INT, x[2:2]::INT, 'quarter' FROM (SELECT o_orderkey, unnest(qs) AS x FROM f)) SELECT * FROM r"""
)
def temporal_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("o_orderkey", F.inline(understanding.temporal_refs(F.col("q"))))


@query(f"SELECT o_orderkey, regexp_matches(lower(q), '\\bcompar(e|ed|ing|ison)\\b|\\b(vs|versus)\\b|\\bchanged? (from|since)\\b|\\byear over year\\b') AS comparative FROM ({_ASK})")
def comparative_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("o_orderkey", understanding.is_comparative(F.col("q")).alias("comparative"))


@query(f"SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN (2000 + year(o_orderdate) % 100 - 1) || ',' || (2000 + year(o_orderdate) % 100) ELSE (year(o_orderdate) - 1) || ',' || year(o_orderdate) END AS years FROM orders WHERE o_orderkey % 8 IN (1, 6)")
def comparison_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    years = understanding.comparison_years(understanding.temporal_refs(q), understanding.is_comparative(q))
    return _asked(spark, sf_dir).where(understanding.is_comparative(q)).select("o_orderkey", F.array_join(years.cast("array<string>"), ",").alias("years"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE 2000 + (year(o_orderdate) % 100) END::INT AS year, CASE WHEN o_orderkey % 4 IN (1, 2) THEN quarter(o_orderdate) END::INT AS quarter FROM orders")
def fiscal_period_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, yy, q = F.col("o_orderkey") % 4, F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0"), F.quarter("o_orderdate").cast("string")
    shown = F.when(k == 0, F.concat(F.lit("FY"), yy)).when(k == 1, F.concat(F.lit("fy20"), yy, F.lit("Q"), q)).when(k == 2, F.concat(F.lit("Q"), q, F.lit("FY"), yy)).otherwise(F.lit("2024"))
    return table(spark, sf_dir, "orders").select("o_orderkey", understanding.fiscal_period(shown).alias("p")).select("o_orderkey", "p.year", "p.quarter")


@query("SELECT o_orderkey, date_trunc('quarter', o_orderdate)::DATE::VARCHAR AS first_day, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE::VARCHAR AS last_day FROM orders")
def quarter_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = understanding.quarter_range(F.year("o_orderdate"), F.quarter("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", span.alias("s")).select("o_orderkey", F.col("s.start").cast("string").alias("first_day"), F.col("s.end").cast("string").alias("last_day"))
