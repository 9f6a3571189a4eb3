"""Insider transactions, logs, statuses, duplicates, incremental loads and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import text as text_functions
from tessera.operators import analytics, filters, insider, similar
from tessera.plans import index
from tessera.sources import files

_TX = """SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'S' WHEN 'A' THEN 'P' ELSE 'J' END AS code, CASE l_linestatus WHEN 'O' THEN 'A' ELSE 'D' END AS sign,
l_quantity::DECIMAL(12,2) AS shares, CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice::DECIMAL(12,2) END AS price, l_shipdate::DATE AS date FROM lineitem"""


def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as transactions."""
    code = F.when(F.col("l_returnflag") == "R", "S").when(F.col("l_returnflag") == "A", "P").otherwise("J")
    price = F.when(F.col("l_tax") != 0, F.col("l_extendedprice").cast("decimal(12,2)"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", code.alias("code"), F.when(F.col("l_linestatus") == "O", "A").otherwise("D").alias("sign"), F.col("l_quantity").cast("decimal(12,2)").alias("shares"), price.alias("price"), F.col("l_shipdate").cast("date").alias("date"))


@query(f"SELECT l_suppkey, sum(CASE sign WHEN 'A' THEN shares ELSE -shares END)::DOUBLE AS net_shares FROM ({_TX}) GROUP BY 1")
def insider_net_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transactions(spark, sf_dir).groupBy("l_suppkey").agg(F.sum(insider.signed(F.col("shares"), F.col("sign"))).cast("double").alias("net_shares"))


@query(f"SELECT l_suppkey, round(coalesce(sum(shares * price), 0)::DOUBLE, 2) AS total_value FROM ({_TX}) GROUP BY 1")
def insider_total_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.coalesce(F.sum(F.col("shares") * F.col("price")).cast("double"), F.lit(0.0))
    return _transactions(spark, sf_dir).groupBy("l_suppkey").agg(F.round(value, 2).alias("total_value"))


@query(
    f"""SELECT code, sign, CASE code WHEN 'S' THEN 'Sale' WHEN 'P' THEN 'Purchase' ELSE 'Other' END AS kind, sign = 'A' AND code IN ('P','A','M','C','W','X') AS is_buy,
    sign = 'D' OR code IN ('S','F','G','U') AS is_sell, count(*) AS n FROM ({_TX}) GROUP BY 1, 2, 3, 4, 5"""
)
def insider_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, sign = F.col("code"), F.col("sign")
    flagged = _transactions(spark, sf_dir).select("code", "sign", insider.code_name(code).alias("kind"), insider.is_buy(code, sign).alias("is_buy"), insider.is_sell(code, sign).alias("is_sell"))
    return flagged.groupBy(*flagged.columns).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT l_orderkey, l_linenumber, code FROM ({_TX}) WHERE sign = 'A' AND code IN ('P','A','M','C','W','X') AND date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' UNION ALL SELECT l_orderkey, l_linenumber, code FROM ({_TX}) WHERE (sign = 'D' OR code IN ('S','F','G','U')) AND date BETWEEN DATE '1995-01-01' AND DATE '1995-06-30'")
def insider_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _transactions(spark, sf_dir)
    found = insider.chosen(every, "buy", "1995-01-01", "1999-12-31").unionByName(insider.chosen(every, "sell", "1995-01-01", "1995-06-30"))
    return found.select("l_orderkey", "l_linenumber", "code")


def _tag(name: str, *parts) -> Column:
    return F.concat(F.lit(f"<{name}>"), *(p.cast("string") for p in parts), F.lit(f"</{name}>"))


def _held(name: str, value: Column) -> Column:
    return _tag(name, _tag("value", value))


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as ownership forms: every third line number a derivative transaction, those numbered 5 and up holdings, the rest plain transactions."""
    nothing, n = F.lit(""), F.col("l_linenumber")
    price = F.coalesce(_held("transactionPricePerShare", F.format_number("price", 4)), nothing)
    security = _held("securityTitle", F.concat(F.lit("S"), F.col("l_suppkey")))
    shares = F.format_number("shares", 4)
    body = F.concat(
        security,
        _held("transactionDate", F.date_format("date", "MM/dd/yyyy")),
        _tag("transactionCoding", _tag("transactionCode", F.col("code"))),
        F.when(n % 3 == 0, _held("conversionOrExercisePrice", n)).otherwise(nothing),
        _tag("transactionAmounts", _held("transactionShares", shares), F.when(n % 2 == 0, price).otherwise(nothing), F.when(F.col("sign") == "D", _held("transactionAcquiredDisposedCode", F.col("sign"))).otherwise(nothing)),
    )
    after = _tag("postTransactionAmounts", _held("sharesOwnedFollowingTransaction", shares))
    held = F.concat(security, after, F.when(n % 2 == 0, _tag("ownershipNature", _held("directOrIndirectOwnership", F.lit("I")), _held("natureOfOwnership", F.lit("By Trust &amp; Co")))).otherwise(nothing))
    is_derivative, is_holding = n % 3 == 0, (n >= 5) & (n % 3 != 0)
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(is_holding, _tag("nonDerivativeHolding", held)).when(is_derivative, _tag("derivativeTransaction", body)).otherwise(_tag("nonDerivativeTransaction", body, after)).alias("x"), is_derivative.alias("d"))))
    part = lambda d: F.array_join(F.transform(F.filter("lines", lambda r: r["d"] == d), lambda r: r["x"]), "\n")
    forms = _transactions(spark, sf_dir).groupBy("l_orderkey").agg(lines.alias("lines"))
    k = F.col("l_orderkey")
    owner = _tag("reportingOwner", _tag("reportingOwnerId", _tag("rptOwnerCik", k % 97), _tag("rptOwnerName", F.concat(F.lit("Owner "), k % 97))), _tag("reportingOwnerRelationship", _tag("isDirector", k % 2), _tag("isOfficer", F.when(k % 3 == 0, "1").otherwise("0")), _tag("officerTitle", F.when(k % 6 == 0, "CFO").otherwise(""))))
    head = F.concat(_tag("periodOfReport", F.lit("2024-03-31")), _tag("issuer", _tag("issuerCik", k), _tag("issuerName", F.lit("A &amp; B")), _tag("issuerTradingSymbol", F.lit("AB"))), owner)
    xml = F.concat(F.lit('<?xml version="1.0"?>\n'), _tag("ownershipDocument", head, _tag("nonDerivativeTable", part(False)), _tag("derivativeTable", part(True))))
    return forms.select("l_orderkey", xml.alias("xml"))


@query(
    f"""SELECT l_orderkey, l_linenumber % 3 = 0 AS derivative, 'S' || l_suppkey AS security, date::VARCHAR AS date, code, shares::DOUBLE AS shares, sign,
    CASE WHEN l_linenumber % 2 = 0 AND price IS NOT NULL THEN price WHEN l_linenumber % 3 = 0 THEN l_linenumber END::DOUBLE AS price, CASE WHEN l_linenumber % 3 <> 0 THEN shares END::DOUBLE AS owned_after, 'Owner ' || l_orderkey % 97 AS owner FROM ({_TX}) WHERE l_linenumber < 5 OR l_linenumber % 3 = 0"""
)
def form4_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = insider.parse_form4(_forms(spark, sf_dir), "l_orderkey", "xml")
    return found.select("l_orderkey", "derivative", "security", F.col("date").cast("string").alias("date"), "code", "sign", *(F.col(c).cast("double").alias(c) for c in ("shares", "price", "owned_after")), "owner")


@query(f"SELECT l_orderkey, 'S' || l_suppkey AS security, shares::DOUBLE AS shares, CASE l_linenumber % 2 WHEN 0 THEN 'I' ELSE 'D' END AS ownership, CASE l_linenumber % 2 WHEN 0 THEN 'By Trust & Co' ELSE '' END AS nature FROM ({_TX}) WHERE l_linenumber >= 5 AND l_linenumber % 3 <> 0")
def form4_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = insider.holdings(insider.read_form4(_forms(spark, sf_dir), "l_orderkey", "xml"), "l_orderkey")
    return found.select("l_orderkey", "security", F.col("shares").cast("double").alias("shares"), "ownership", "nature")


@query(
    """SELECT l_orderkey, '2024-03-31' AS period, 'A & B' AS issuer, l_orderkey::VARCHAR AS issuer_cik, 'AB' AS ticker, 'Owner ' || l_orderkey % 97 AS owner, (l_orderkey % 97)::VARCHAR AS owner_cik, l_orderkey % 2 = 1 AS is_director, l_orderkey % 3 = 0 AS is_officer,
    CASE WHEN l_orderkey % 6 = 0 THEN 'CFO' ELSE '' END AS title, CASE WHEN l_orderkey % 6 = 0 THEN 'CFO' WHEN l_orderkey % 3 = 0 THEN 'Officer, Director' WHEN l_orderkey % 2 = 1 THEN 'Director' ELSE 'Unknown' END AS role FROM (SELECT DISTINCT l_orderkey FROM lineitem)"""
)
def form4_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = insider.filings(insider.read_form4(_forms(spark, sf_dir), "l_orderkey", "xml"), "l_orderkey")
    return found.withColumn("period", F.col("period").cast("string")).drop("is_ten_percent_owner", "is_other")


@query(
    """SELECT c_custkey, concat_ws(', ', CASE WHEN c_custkey % 5 = 0 THEN 'Treasurer' WHEN c_custkey % 3 = 0 THEN 'Officer' END, CASE WHEN c_custkey % 2 = 1 THEN 'Director' END, CASE WHEN c_custkey % 7 = 0 THEN '10% Owner' END, CASE WHEN c_custkey % 4 = 0 THEN 'Other' END) AS said,
    CASE WHEN said = '' THEN 'Unknown' ELSE said END AS role FROM customer"""
)
def form4_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as reporting owners of all kinds: a title with and without an office, directors, large owners, others."""
    k = F.col("c_custkey")
    flag = lambda name, yes: _tag(name, F.when(yes, "1").otherwise("0"))
    relation = _tag("reportingOwnerRelationship", flag("isDirector", k % 2 == 1), flag("isOfficer", k % 3 == 0), flag("isTenPercentOwner", k % 7 == 0), flag("isOther", k % 4 == 0), _tag("officerTitle", F.when(k % 5 == 0, "Treasurer").otherwise("")))
    owner = _tag("reportingOwner", _tag("reportingOwnerId", _tag("rptOwnerCik", k), _tag("rptOwnerName", F.col("c_name"))), relation)
    xml = _tag("ownershipDocument", _tag("periodOfReport", F.lit("2024-03-31")), owner)
    found = insider.filings(insider.read_form4(table(spark, sf_dir, "customer").select("c_custkey", xml.alias("xml")), "c_custkey", "xml"), "c_custkey")
    return found.select("c_custkey", F.when(F.col("role") == "Unknown", "").otherwise(F.col("role")).alias("said"), "role")


@query("SELECT o_orderpriority, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def latest_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.latest_per(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate"), ["o_orderpriority"], F.desc("o_orderdate"), F.col("o_orderkey"))


@query(
    """SELECT query_type, mode, count(*) AS searches, round(avg(num_results), 4) AS mean_results, count(*) FILTER (num_results < 3) AS low_results
    FROM (SELECT event_type AS mode, 't' || user_id % 5 AS query_type, floor(value)::BIGINT AS num_results FROM events) GROUP BY GROUPING SETS ((query_type), (mode), ())"""
)
def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.concat(F.lit("t"), F.col("user_id") % 5).alias("query_type"), F.floor("value").alias("num_results"))
    return analytics.feedback_summary(log)


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, count(*) AS total FROM orders GROUP BY 1")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.status_counts(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS answered, count(*) AS total FROM orders GROUP BY ROLLUP (o_orderpriority)")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("answered"), F.count(F.lit(1)).alias("total"))


@query("SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source)")
def inventory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"))


@query(
    """WITH k AS (SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS key FROM documents)
    SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS first_id FROM k) WHERE doc_id <> first_id"""
)
def question_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return analytics.exact_duplicates(docs, text_functions.question_key(F.col("text")), "doc_id").where("doc_id <> first_id").select("doc_id", "first_id")


@query("SELECT source || '/' || doc_id AS path, md5(text) AS hash FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0")
def incremental_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are new (ids by 3) or changed since (ids by 7)."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), F.md5("text").alias("hash"))
    manifest = files.where("doc_id % 3 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.col("hash")).alias("hash"))
    return analytics.changed(files, manifest).select("path", "hash")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN upper(lang) ELSE lang END AS lang FROM documents WHERE doc_id % 4 = 0 OR doc_id % 2 = 1")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    old = docs.where("doc_id % 2 = 1 or doc_id % 8 = 0")
    return analytics.upsert(old, docs.where("doc_id % 4 = 0").select("doc_id", F.upper("lang").alias("lang")), "doc_id")


@query("SELECT lang, doc_id, size, pick FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n, size) AS pick FROM (SELECT lang, doc_id, size, row_number() OVER (PARTITION BY lang, size ORDER BY doc_id) AS n FROM (SELECT lang, doc_id, CASE WHEN n_chars < 1000 THEN 'small' WHEN n_chars < 4000 THEN 'medium' ELSE 'large' END AS size FROM documents))) WHERE pick <= 12")
def diverse_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("n_chars") < 1000, "small").when(F.col("n_chars") < 4000, "medium").otherwise("large")
    return analytics.diverse_sample(table(spark, sf_dir, "documents").select("lang", "doc_id", size.alias("size")), "lang", "size", "doc_id", 12)


@query("SELECT lang, size, count(*) AS n FROM (SELECT lang, CASE WHEN n_chars < 1000 THEN 'small' WHEN n_chars < 4000 THEN 'medium' ELSE 'large' END AS size FROM documents) GROUP BY GROUPING SETS ((lang), (size), (lang, size))")
def corpus_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("n_chars") < 1000, "small").when(F.col("n_chars") < 4000, "medium").otherwise("large")
    docs = table(spark, sf_dir, "documents").select("lang", size.alias("size"))
    return docs.groupingSets([["lang"], ["size"], ["lang", "size"]], "lang", "size").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, round(greatest(0.3, 1 - (date_diff('day', o_orderdate::DATE, DATE '2002-01-01') / 365.0) / 7 * (1 - 0.3)), 6)::DOUBLE AS weight FROM orders")
def recency_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")) / 365.0
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(text_functions.recency(age, 7, 0.3), 6).alias("weight"))


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS parsed FROM orders WHERE o_orderkey % 4 <> 3")
def multi_format_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in one of three formats, or none, by key; only those that parse are left."""
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k == 2, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("n/a")
    return table(spark, sf_dir, "orders").select("o_orderkey", text_functions.parse_date(shown).cast("string").alias("parsed")).where("parsed is not null")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS amount FROM orders")
def decimal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("o_orderkey") % 5 == 0, "--").otherwise(F.format_number("o_totalprice", 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", text_functions.parse_decimal(shown).cast("double").alias("amount"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'answered' WHEN 'O' THEN 'pending' ELSE 'error' END AS status FROM orders WHERE o_orderstatus <> 'F'")
def runnable_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions: those still open, and failed ones again."""
    status = F.when(F.col("o_orderstatus") == "F", "answered").when(F.col("o_orderstatus") == "O", "pending").otherwise("error")
    return filters.runnable(table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status")), retry_errors=True)


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS filing_date FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-03-01' AND DATE '1997-10-15' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def results_between_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest orders of a span of days, days written as text."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(-F.col("o_totalprice"), "o_orderkey").alias("rank"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"))
    return filters.between(orders, "1996-03-01", "1997-10-15", 15).select("o_orderkey", "filing_date")


@query("SELECT o_orderpriority, max(o_orderdate)::DATE::VARCHAR AS filing_date FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) GROUP BY 1")
def latest_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of the priority that comes first."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("filing_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"), F.col("o_orderkey").alias("accession"))
    first = orders.agg(F.min("filing_type")).first()[0]
    return filters.latest_matching(orders, first).select(F.col("filing_type").alias("o_orderpriority"), "filing_date")


@query(
    """SELECT doc_id, lang AS filing_type, source, '' AS filing_date, 'text' AS content_type, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE (2000 + doc_id % 20)::INT END AS fiscal_year, 0 AS fiscal_quarter, false AS has_table, md5(text) AS text FROM documents"""
)
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks with few columns, stored with all of them; the rest comes back from the JSON."""
    docs = table(spark, sf_dir, "documents").select("text", F.col("lang").alias("doc_type"), "source", F.when(F.col("doc_id") % 3 != 0, 2000 + F.col("doc_id") % 20).alias("fiscal_year"), "doc_id")
    stored = index.records(docs)
    own = F.get_json_object("metadata_json", "$.doc_id").cast("long")
    return stored.select(own.alias("doc_id"), "filing_type", "source", "filing_date", "content_type", "fiscal_year", "fiscal_quarter", "has_table", F.md5("text").alias("text"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_VECTOR = f"list_transform(range(1, 27), lambda i: (length(lower(text)) - length(replace(lower(text), ('{_LETTERS}')[i], ''))) - length(text) / 40.0)"


@query(
    f"""WITH v AS (SELECT doc_id, {_VECTOR} AS v FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, v, sqrt(list_inner_product(v, v)) AS norm FROM v),
    d AS (SELECT min(doc_id) AS id, v, any_value(norm) AS norm FROM n WHERE norm > 0 GROUP BY v)
    SELECT a.id AS a, b.id AS b, round(list_inner_product(a.v, b.v) / (a.norm * b.norm), 6) AS similarity FROM d a JOIN d b ON a.id < b.id WHERE round(list_inner_product(a.v, b.v) / (a.norm * b.norm), 6) > 0.995"""
)
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose vectors (counts of letters, less a fortieth of the length) have a cosine above 0.995; equal vectors by their first document."""
    low = F.lower("text")
    counts = [F.length(low) - F.length(F.replace(low, F.lit(c))) - F.length("text") / 40.0 for c in _LETTERS]
    vectors = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array(*counts).alias("vector"))
    return similar.near_pairs(vectors, "doc_id", "vector", 0.995, miss=0)[0]


@query(
    """SELECT p_brand AS path, 'hash' || p_partkey AS hash, 'f' || p_size || '.md' AS file, 'Q1.' || p_partkey AS question FROM part"""
)
def manifest_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of question files, one a brand, of which every other has its hashes in the old list form."""
    k = F.col("p_partkey")
    entry = F.struct(F.concat(F.lit("hash"), k).alias("h"), F.concat(F.lit("f"), F.col("p_size"), F.lit(".md")).alias("f"), F.concat(F.lit("Q1."), k).alias("q"))
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    as_map = F.to_json(F.map_from_entries(F.transform("e", lambda x: F.struct(x["h"].alias("key"), F.array(x["f"], x["q"]).alias("value")))))
    as_list = F.to_json(F.transform("e", lambda x: F.array(x["h"], x["f"], x["q"])))
    text = F.concat(F.lit('{"ticker": "AB", "sections": {}, "question_hashes": '), F.when(F.substring("p_brand", -1, 1).cast("int") % 2 == 0, as_map).otherwise(as_list), F.lit("}"))
    return files.question_manifests(brands.select(F.col("p_brand").alias("path"), text.alias("text")))[1]
