"""Conversations written as call transcripts, and orders as report and file names, read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.operators import transcripts

_FLAT = "trim(replace(text, chr(10), ' '))"
_WHO = {"user": ("Ann User", "Analyst"), "assistant": ("Bob Helper", "Chief Executive Officer"), "system": ("Cy Keeper", "Operator")}


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transcript per conversation: turns 0 and 1 are the presentation, the rest questions and answers; texts on one line."""
    name = F.create_map(*(F.lit(x) for role, (n, _) in _WHO.items() for x in (role, n)))
    spoken = F.concat(F.try_element_at(name, F.col("role")), F.lit("\n"), F.regexp_replace("text", r"\n", " "), F.lit("\n"))
    headed = F.when(F.col("turn") == 2, F.concat(F.lit("Questions and Answers\n"), spoken)).otherwise(spoken)
    turns = F.array_sort(F.collect_list(F.struct("turn", headed.alias("x"))))
    k, year = F.col("conv_id"), 2000 + F.col("conv_id") % 25
    known = "".join(f"{n} - {t}\n" for n, t in _WHO.values())
    cover = F.concat(F.lit("Acme Corp (AC"), F.char(65 + k % 26), F.lit(")\nQ"), k % 4 + 1, F.lit(" "), year, F.lit(" Earnings Call\nJanuary "), k % 28 + 1, F.lit(", "), year, F.lit(f"\nParticipants\n{known}Presentation\n"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(cover, F.array_join(F.transform(turns, lambda t: t["x"]), "")).alias("call"))


@query(
    f"""SELECT conv_id, CASE WHEN turn < 2 THEN 'presentation' ELSE 'qa' END AS part, CASE role {' '.join(f"WHEN '{r}' THEN '{n}'" for r, (n, _) in _WHO.items())} END AS name,
    CASE role {' '.join(f"WHEN '{r}' THEN '{t}'" for r, (_, t) in _WHO.items())} END AS title, md5(trim(replace(text, chr(10), ' '))) AS text, turn + 1 AS block FROM conversations"""
)
def transcript_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = transcripts.speaker_blocks(_calls(spark, sf_dir), "conv_id", "call")
    return blocks.select("conv_id", "part", "name", "title", F.md5("text").alias("text"), "block")


@query(
    f"""SELECT conv_id, CASE WHEN turn < 2 THEN 'presentation' ELSE 'qa' END AS part, CASE role WHEN 'user' THEN 'Ann User' WHEN 'assistant' THEN 'Bob Helper' ELSE 'Operator' END AS name,
    CASE role WHEN 'user' THEN 'Managing Director of Equity Research' WHEN 'assistant' THEN 'Chief Executive Officer' END AS title, md5({_FLAT}) AS text, turn + 1 AS block FROM conversations"""
)
def transcript_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts in the other layout: titles on the lines below names, in the list and again where they speak; an operator whom nobody lists."""
    name = F.when(F.col("role") == "user", "Ann User").when(F.col("role") == "assistant", "Bob Helper\nChief Executive Officer").otherwise("Operator")
    spoken = F.concat(name, F.lit("\n"), F.regexp_replace("text", r"\n", " "), F.lit("\n"))
    headed = F.when(F.col("turn") == 2, F.concat(F.lit("Questions and Answers\n"), spoken)).otherwise(spoken)
    turns = F.array_sort(F.collect_list(F.struct("turn", headed.alias("x"))))
    listed = "Call Participants\nExecutives\nBob Helper\nChief Executive Officer\nAnalysts\nAnn User\nManaging Director\nPage 2\nof Equity Research\nPresentation\n"
    calls = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit(listed), F.array_join(F.transform(turns, lambda t: t["x"]), "")).alias("call"))
    return transcripts.speaker_blocks(calls, "conv_id", "call").select("conv_id", "part", "name", "title", F.md5("text").alias("text"), "block")


@query("SELECT DISTINCT conv_id, 'AC' || chr((65 + conv_id % 26)::INT) AS ticker, 'Q' || (conv_id % 4 + 1) || ' ' || (2000 + conv_id % 25) || ' Earnings Call' AS event, make_date(2000 + conv_id % 25, 1, conv_id % 28 + 1)::VARCHAR AS day FROM conversations")
def transcript_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _calls(spark, sf_dir).select("conv_id", transcripts.transcript_metadata(F.col("call")).alias("m"))
    return found.select("conv_id", "m.ticker", "m.event", F.col("m.date").cast("string").alias("day"))


_FIRMS = ["Morgan Stanley", "J.P. Morgan", "BofA", "UBS", "Piper Sandler", "Baird"]
_SAID = ["Buy", "Sell", "Hold", "Overweight", "Market Perform", "Equal Weight", "Reduce"]


@query(
    f"""SELECT o_orderkey, 'T' || chr(65 + (o_orderkey % 26)::INT) AS ticker, {_SAID}[(o_orderkey % 7 + 1)::INT] AS rating, floor(o_totalprice)::DOUBLE AS price_target,
    {_FIRMS}[(o_orderkey % 6 + 1)::INT] AS firm, o_orderdate::DATE::VARCHAR AS day FROM orders"""
)
def report_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as front pages of reports, of several firms, with the rating after a label or alone and the day in five forms."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    rating = F.when(k % 3 == 0, F.concat(F.lit("Rating: "), F.upper(pick(_SAID, 7)))).when(k % 3 == 1, F.concat(F.lit("We stay at "), F.lower(pick(_SAID, 7)))).otherwise(F.regexp_replace(pick(_SAID, 7), " ", "-"))
    forms = ["M/d/yyyy", "MMMM d, yyyy", "d MMMM yyyy", "yyyy-MM-dd", "MMMM d yyyy"]
    written = F.coalesce(*(F.when(k % 5 == i, F.date_format(day, form)) for i, form in enumerate(forms)))
    said = F.when(k % 2 == 0, "Price Target: $").otherwise("PT $")
    page = F.concat(pick(_FIRMS, 6), F.lit(" Research\nNYSE: T"), F.char(65 + k % 26), F.lit("\n"), written, F.lit("\n"), rating, F.lit("\n"), said, F.format_number(F.floor("o_totalprice"), 0))
    found = table(spark, sf_dir, "orders").select("o_orderkey", transcripts.report_metadata(F.array(page)).alias("m"))
    return found.select("o_orderkey", "m.ticker", "m.rating", "m.price_target", "m.firm", F.col("m.date").cast("string").alias("day"))


_OPENINGS = [("Our View", "Investment Thesis"), ("Sum-of-the-Parts", "Valuation"), ("Quarterly Estimates", "Financial Summary"), ("Near-Term Catalysts", "Catalysts"), ("3. Downside Risks", "Risks"), ("Competitive Landscape", "Industry"), ("Business Model", "Company Description"), ("Key Executives", "Management")]
@query(
    f"""SELECT doc_id, {[t for _, t in _OPENINGS]}[((doc_id + p - 1) % 8 + 1)::INT] AS title, p::INT AS page, md5(CASE p WHEN 1 THEN {_FLAT} ELSE 'second: ' || {_FLAT} END) AS content
    FROM documents, (SELECT unnest([1, 2]) AS p) WHERE length(CASE p WHEN 1 THEN {_FLAT} ELSE 'second: ' || {_FLAT} END) >= 100"""
)
def report_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports of two pages, each with a heading of the next of eight families."""
    flat, k = F.trim(F.regexp_replace("text", r"\n", " ")), F.col("doc_id")
    heading = lambda p: F.element_at(F.array(*(F.lit(h) for h, _ in _OPENINGS)), ((k + p) % 8 + 1).cast("int"))
    pages = F.array(F.concat(heading(0), F.lit("\n"), flat), F.concat(heading(1), F.lit("\nsecond: "), flat))
    reports = table(spark, sf_dir, "documents").select("doc_id", pages.alias("pages"))
    return transcripts.report_sections(reports, "doc_id", "pages").select("doc_id", "title", "page", F.md5("content").alias("content"))


@query("SELECT doc_id, 'Valuation' AS title, 1 AS page, md5(trim(replace(text, chr(10), ' '))) AS content FROM documents WHERE length(trim(replace(text, chr(10), ' '))) >= 100")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a report's valuation, after a heading with too little below it."""
    page = F.concat(F.lit("Front matter\nRisks\nfew\nValuation and target\n"), F.regexp_replace("text", r"\n", " "))
    reports = table(spark, sf_dir, "documents").select("doc_id", F.array(page, F.lit("second page")).alias("pages"))
    return transcripts.report_sections(reports, "doc_id", "pages").select("doc_id", "title", "page", F.md5("content").alias("content"))


@query("SELECT o_orderkey, 'call_' || o_orderdate::DATE::VARCHAR || '_Order_' || o_orderkey || '_summary.md' AS name FROM orders")
def summary_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names with the day written in one of two ways, or only known from the change."""
    k = F.col("o_orderkey") % 3
    day = F.when(k == 0, F.date_format("o_orderdate", "MMM d, yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("")
    name = F.concat(F.lit("Order "), F.col("o_orderkey"), F.lit(" "), day, F.lit(".pdf"))
    return table(spark, sf_dir, "orders").select("o_orderkey", transcripts.summary_name(name, "call", F.col("o_orderdate")).alias("name"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'earnings_Q' || quarter(o_orderdate) || '_FY' || lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') || '_' || o_orderdate::DATE WHEN 1 THEN 'conference_Morgan_Stanley_' || o_orderdate::DATE
    WHEN 2 THEN 'conference_Tech_Leaders_' || o_orderdate::DATE WHEN 3 THEN 'analyst_Piper_Sandler_' || o_orderdate::DATE WHEN 4 THEN 'analyst_' || o_orderdate::DATE || '_Acme_Own_Desk' || o_orderkey
    WHEN 5 THEN 'presentation_Capital_Markets_Day_' || o_orderdate::DATE WHEN 6 THEN 'presentation_' || o_orderdate::DATE || '_Acme_Deck_' || o_orderkey ELSE 'transcript_' || o_orderdate::DATE || '_Acme_call_' || o_orderkey END || '.md' AS name FROM orders"""
)
def summary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of all kinds of document, whose names tell quarter, host, firm or occasion, or nothing."""
    n, day = F.col("o_orderkey"), F.col("o_orderdate")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    k = n % 8
    stem = (
        F.when(k == 0, said("Acme, Q", F.quarter(day), " ", F.year(day), " Earnings Call, ", F.date_format(day, "MMM d, yyyy")))
        .when(k == 1, said("Acme Presents at Morgan  Stanley TMT Conference, ", F.date_format(day, "MMM-dd-yyyy"), " 09-00 AM"))
        .when(k == 2, said("Acme Presents at Tech Leaders' Forum, ", F.date_format(day, "MMMM-dd-yyyy")))
        .when(k == 3, said("Acme - PIPER SANDLER - Note ", n))
        .when(k == 4, said("Acme - Own Desk", n))
        .when(k == 5, said("Acme Capital Markets update ", n))
        .otherwise(F.when(k == 6, said("Acme (Deck) ", n)).otherwise(said("Acme call ", n)))
    )
    kind = F.when(k.isin(0, 7), "transcript").when(k.isin(1, 2), "conference").when(k.isin(3, 4), "analyst").otherwise("presentation")
    return table(spark, sf_dir, "orders").select("o_orderkey", transcripts.summary_file(kind, stem, day).alias("name"))


@query(
    f"""SELECT conv_id, turn AS chunk_index, CASE WHEN turn < 2 THEN 'presentation' ELSE 'qa' END AS section, CASE role {' '.join(f"WHEN '{r}' THEN '{n} - {t}'" for r, (n, t) in _WHO.items())} END AS speaker, md5(trim(replace(text, chr(10), ' '))) AS text FROM conversations"""
)
def call_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts as one chunk per speaker block."""
    chunks = transcripts.speaker_chunks(transcripts.speaker_blocks(_calls(spark, sf_dir), "conv_id", "call"), "conv_id")
    return chunks.select("conv_id", F.col("chunk_index").cast("long").alias("chunk_index"), "section", "speaker", F.md5("text").alias("text"))
