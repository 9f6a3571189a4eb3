"""Extraction of sections, tables and page parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import lexicon
from tessera.catalog import query, table
from tessera.operators import sections, tables
from tessera.operators.html_tables import page_tables



def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut in three under headers, after a table of contents."""
    part = lambda k: F.expr(f"substring(text, cast({k} * (n_chars div 3) + 1 as int), cast({'n_chars' if k == 2 else 'n_chars div 3'} as int))")
    contents = F.lit("Item 1. Business\nItem 1A. Risk Factors\nItem 7. Discussion\n")
    body = F.concat(contents, F.lit("Item 1. Business\n"), part(0), F.lit("\nItem 1A. Risk Factors\n"), part(1), F.lit("\nItem 7. Discussion\n"), part(2))
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("filing"))


_MDA = lexicon.TITLES["10-K"]["Item 7"].replace("'", "''")
_CUTS = f"SELECT doc_id, 'Item 1' AS key, 'Business' AS title, substr(text, 1, n_chars // 3) || chr(10) AS content FROM documents UNION ALL SELECT doc_id, 'Item 1A', 'Risk Factors', substr(text, n_chars // 3 + 1, n_chars // 3) || chr(10) FROM documents UNION ALL SELECT doc_id, 'Item 7', '{_MDA}', substr(text, 2 * (n_chars // 3) + 1) FROM documents"


@query(f"SELECT doc_id, key, title, md5(trim(content, chr(10) || ' ')) AS content FROM ({_CUTS}) WHERE length(trim(chr(10) || content, ' ')) >= 50")
def section_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of filings whose contents list names each item before it comes."""
    texts = _filings(spark, sf_dir)
    found = sections.headers(texts, "doc_id", "filing")
    best = sections.longest_sections(texts, found, "doc_id", "filing")
    return best.select("doc_id", "key", "title", F.md5(F.btrim("content", F.lit("\n "))).alias("content"))


#: Offsets: the contents have 17, 22 and 19 characters, and each part a line feed after it.
@query(
    f"""SELECT doc_id, 'Item 1' AS key, 'Business' AS title, unnest([0, 58]) AS start FROM documents UNION ALL SELECT doc_id, 'Item 1A', 'Risk Factors', unnest([17, 76 + n_chars // 3]) FROM documents
    UNION ALL SELECT doc_id, 'Item 7', '{_MDA}', unnest([39, 99 + 2 * (n_chars // 3)]) FROM documents"""
)
def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.headers(_filings(spark, sf_dir), "doc_id", "filing").select("doc_id", "key", "title", "start")


_THIRDS = "SELECT doc_id, {k} AS k, {key} AS key, {title} AS title, trim(regexp_replace(substr(text, {k} * (n_chars // 3) + 1, {size}), '\\s+', ' ', 'g')) AS content FROM documents"


def _thirds(keys: list[tuple[str, str]]) -> str:
    """SQL of three sections of a document on one line each."""
    sql = lambda x: "'" + x.replace("'", "''") + "'"
    each = [_THIRDS.format(k=k, key=sql(key), title=sql(title), size="n_chars" if k == 2 else "n_chars // 3") for k, (key, title) in enumerate(keys)]
    return " UNION ALL ".join(each)


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column]]:
    third = lambda k: F.trim(F.regexp_replace(F.expr(f"substring(text, cast({k} * (n_chars div 3) + 1 as int), cast({'n_chars' if k == 2 else 'n_chars div 3'} as int))"), r"\s+", " "))
    return table(spark, sf_dir, "documents"), [third(k) for k in range(3)]


_SPELLED = [("Item 1 - Business", "ITEM 1:", "Item 1\u2014Our Business"), ("Item 1A Risk Factors", "Item 1A", "item 1a. risks"), ("ITEM 7", "Item 7 Discussion and Analysis", "Item 7 \u2013 MD&A")]


@query(
    f"""SELECT doc_id, key, title, md5(trim(content, chr(10) || ' ')) AS content FROM ({_CUTS}) WHERE length(trim(chr(10) || content, ' ')) >= 50"""
)
def section_spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of filings whose headers are spelled in three ways: with a dash or another mark, with nothing before the title, without a title."""
    docs, cuts = table(spark, sf_dir, "documents"), [F.expr(f"substring(text, cast({k} * (n_chars div 3) + 1 as int), cast({'n_chars' if k == 2 else 'n_chars div 3'} as int))") for k in range(3)]
    header = lambda k: F.element_at(F.array(*map(F.lit, _SPELLED[k])), (F.col("doc_id") % 3 + 1).cast("int"))
    texts = docs.select("doc_id", F.concat(*(x for k in range(3) for x in (header(k), F.lit("\n"), cuts[k], F.lit("\n" if k < 2 else "")))).alias("filing"))
    best = sections.longest_sections(texts, sections.headers(texts, "doc_id", "filing"), "doc_id", "filing")
    return best.select("doc_id", "key", "title", F.md5(F.btrim("content", F.lit("\n "))).alias("content"))


_Q = [("Part I, Item 1", lexicon.TITLES["10-Q"]["Part I, Item 1"]), ("Part I, Item 2", lexicon.TITLES["10-Q"]["Part I, Item 2"]), ("Part II, Item 1", lexicon.TITLES["10-Q"]["Part II, Item 1"])]


@query(f"SELECT doc_id, key, title, md5(content) AS content FROM (SELECT doc_id, key, title, CASE k WHEN 1 THEN trim(content || chr(10) || 'Part II', chr(10)) WHEN 2 THEN trim('Legal matters: ' || content) ELSE content END AS content FROM ({_thirds(_Q)})) WHERE length(content) + 2 >= 50")
def section_quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly reports, where Item 1 of either part is a section of its own and an item that the form doesn't have is none."""
    docs, (a, b, c) = _lines(spark, sf_dir)
    filing = F.concat(F.lit("PART I\nItem 1. Statements\nItem 2. Discussion\nPART II\nItem 1. Legal\nPART I\nItem 1. Statements\n"), a, F.lit("\nItem 2. Discussion\n"), b, F.lit("\nPart II\nItem 1. Legal\nLegal matters: "), c, F.lit("\n"))
    texts = docs.select("doc_id", filing.alias("filing"))
    best = sections.longest_sections(texts, sections.headers(texts, "doc_id", "filing", "10-Q"), "doc_id", "filing")
    return best.select("doc_id", "key", "title", F.md5(F.btrim("content", F.lit("\n "))).alias("content"))


_STYLED_KEYS = [("Item 1", "Business"), ("Item 1A", "Risk Factors"), ("Item 99", "Other matters")]


@query(f"SELECT doc_id, key, title, md5(trim('ITEM ' || key[6:] || '. ' || CASE key WHEN 'Item 99' THEN 'Other matters' ELSE upper(title) END || chr(10) || content, chr(10))) AS content FROM ({_thirds(_STYLED_KEYS)}) WHERE length(content) >= 50")
def section_styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with bold headings after a table of contents of links."""
    docs, texts = _lines(spark, sf_dir)
    shown = ["ITEM 1. BUSINESS", "ITEM 1A. RISK FACTORS", "ITEM 99. Other matters"]
    escape = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    contents = "".join(f'<div><a href="#s{k}"><span style="font-weight:700">{h}</span></div></a>' for k, h in enumerate(shown))
    body = [F.concat(F.lit(f'<div><span style="color:black;font-weight: 700">{h}</span></div><div>'), escape(x), F.lit("</div>")) for h, x in zip(shown, texts, strict=True)]
    pages = docs.select("doc_id", F.concat(F.lit(f"<html><body>{contents}"), *body, F.lit("</body></html>")).alias("html"))
    found = sections.styled_sections(pages, "doc_id", "html", "10-K")
    return found.where(F.length(F.substring_index("content", "\n", -1)) >= 50).select("doc_id", "key", "title", F.md5("content").alias("content"))


_PROXY_KEYS = [("Proposal 1", "Election"), ("Executive Compensation", "Executive Compensation"), ("Board of Directors", "Board of Directors")]


@query(f"SELECT doc_id, key, title, md5(content) AS content FROM ({_thirds(_PROXY_KEYS)}) WHERE length(content) >= 50")
def section_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proxy statements as text; what the table of contents leaves between its lines is too short to be a section."""
    docs, (a, b, c) = _lines(spark, sf_dir)
    text = F.concat(F.lit("Proposal 1: Election\nExecutive Compensation\nBoard of Directors\n.\nPROPOSAL NO. 1: Election\n"), a, F.lit("\nExecutive Compensation\n"), b, F.lit("\nBOARD OF DIRECTORS\n"), c)
    found = sections.proxy_sections(docs.select("doc_id", text.alias("text")), "doc_id", "text", fragment=50)
    return found.select("doc_id", "key", "title", F.md5("content").alias("content"))


@query("SELECT conv_id, role AS key, min(turn) AS start, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS content FROM conversations WHERE length(text) >= 300 GROUP BY 1, 2")
def merge_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("key"), F.col("role").alias("title"), F.col("turn").alias("start"), F.col("text").alias("content"))
    return sections.merge_fragments(turns, "conv_id", 300).drop("title")


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1)) AS links FROM pages")
def html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", tables.html_title(html).alias("title"), F.size(tables.html_links(html)).cast("long").alias("links"))


_ENTITIES = "x"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _ENTITIES = f"replace({_ENTITIES}, '{_a}', '{_b}')"


@query(
    f"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|head)\\b.*?</(script|style|head)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS x FROM pages)
    SELECT page_id, md5(trim(regexp_replace({_ENTITIES}, '[ \\t\\r\\n]+', ' ', 'g'))) AS text FROM a"""
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tables.html_text(F.col("html"))).alias("text"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CAPTION = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Balance sheet: total assets' WHEN 1 THEN 'Board committees' WHEN 2 THEN 'Executive salary and bonus' WHEN 3 THEN 'Schedule of maturities' ELSE p_name END AS caption, p_type || ' ' || p_brand AS content FROM part"
_KIND_SCORES = ", ".join(f"({' + '.join(f'regexp_matches(seen, {_sql(p)})::INT' for p in v)}) AS {k}" for k, v in lexicon.TABLE_KINDS.items())


@query(
    f"""WITH s AS (SELECT p_partkey, {_KIND_SCORES} FROM (SELECT p_partkey, lower(caption || ' ' || substr(content, 1, 2000)) AS seen FROM ({_CAPTION})))
    SELECT p_partkey, CASE WHEN greatest({', '.join(lexicon.TABLE_KINDS)}) = 0 THEN 'other' {' '.join(f"WHEN {k} = greatest({', '.join(lexicon.TABLE_KINDS)}) THEN '{k}'" for k in lexicon.TABLE_KINDS)} END AS kind FROM s"""
)
def table_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    caption = F.when(k == 0, "Balance sheet: total assets").when(k == 1, "Board committees").when(k == 2, "Executive salary and bonus").when(k == 3, "Schedule of maturities").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", tables.classify(caption, F.concat_ws(" ", "p_type", "p_brand")).alias("kind"))


@query(
    """SELECT n_regionkey, '| key | name | part |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |  |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1"""
)
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region as a table whose rows are a cell short."""
    row = F.array(F.col("n_nationkey").cast("string"), F.concat(F.lit("  "), F.col("n_name")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"])
    head = F.array(F.array(F.lit("key"), F.lit("name"), F.lit("part")))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(rows.alias("rows")).select("n_regionkey", tables.markdown(F.concat(head, F.col("rows"))).alias("markdown"))


@query("SELECT s_suppkey, s_name || '  $' || floor(abs(s_acctbal))::BIGINT || '  n' || s_nationkey AS line FROM supplier")
def readable_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.col("s_name"), F.col("s_name"), F.lit(""), F.lit("$"), F.floor(F.abs("s_acctbal")).cast("string"), F.lit(" "), F.concat(F.lit("n"), F.col("s_nationkey")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", cells.alias("cells")).select("s_suppkey", tables.readable(F.col("cells")).alias("line"))


@query(
    """SELECT c_nationkey, block, 0 AS position, 'Customers of ' || c_nationkey || ' - Balance sheet' AS caption, (count(*) + 1)::INT AS n_rows, 2 AS n_cols, 'financial_statement' AS kind,
    md5('| key | balance |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || c_custkey || ' | ' || floor(c_acctbal)::BIGINT || ' |', chr(10) ORDER BY c_custkey)) AS markdown FROM (SELECT *, c_custkey // 1000 AS block FROM customer) GROUP BY c_nationkey, block"""
)
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 1000 customer numbers of a nation as a page with a table after a heading, read again."""
    row = F.concat(F.lit("<tr><td>"), F.col("c_custkey"), F.lit("</td><td> "), F.floor("c_acctbal"), F.lit("</td></tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("x")))), lambda r: r["x"]), "")
    pages = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.expr("c_custkey div 1000").alias("block")).agg(rows.alias("rows"))
    html = F.concat(F.lit("<html><body><p style='display: none'>no</p><h2>Balance sheet</h2><table><caption>Customers of "), F.col("c_nationkey"), F.lit("</caption><tr><th>key<th>balance</tr>"), F.col("rows"), F.lit("</table></body></html>"))
    key = F.struct("c_nationkey", "block").alias("key")
    found = page_tables(pages.select(key, html.alias("html")), "key", "html")
    return found.select("key.*", "position", "caption", "n_rows", "n_cols", "kind", F.md5("markdown").alias("markdown"))


_LABELLED = "CASE p_partkey % 7 WHEN 0 THEN 'Consolidated Balance Sheets' WHEN 1 THEN 'Director Nominees' WHEN 2 THEN 'Stock Option Awards' WHEN 3 THEN 'Revenue by Geographic Area' WHEN 4 THEN 'Reconciliation of figures' WHEN 5 THEN 'Highlights' ELSE 'Part' END"


@query(
    f"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'financial_statement' WHEN 1 THEN 'governance' WHEN 2 THEN 'compensation' WHEN 3 THEN 'segment_data' WHEN 4 THEN 'schedule' WHEN 5 THEN 'metrics'
    ELSE CASE WHEN p_size % 2 = 0 THEN 'comparison' ELSE 'other' END END AS label, p_size BETWEEN 2 AND 100 AS fit FROM (SELECT *, {_LABELLED} AS caption FROM part)"""
)
def corpus_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tables of as many rows as their size, half of which name a year."""
    k = F.col("p_partkey") % 7
    caption = F.element_at(F.array(*map(F.lit, ["Consolidated Balance Sheets", "Director Nominees", "Stock Option Awards", "Revenue by Geographic Area", "Reconciliation of figures", "Highlights", "Part"])), (k + 1).cast("int"))
    html = F.when(F.col("p_size") % 2 == 0, "<td>2024").otherwise("<td>x")
    rows = F.array_repeat(F.array(F.lit("a"), F.lit("b")), F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", tables.corpus_label(caption, html).alias("label"), tables.corpus_tables(rows, F.length(html)).alias("fit"))


_PLACES = [
    # what stands before the table, its attributes and own caption -> caption, title, section
    ("<h3>Item 7. Discussion</h3><h4>Sales by region</h4>", "", "", "Sales by region", "Untitled table", "Item 7. Discussion"),
    ("<h4>Far heading of the page</h4><div>{long}</div><ul><li>x</li></ul><hr>", "", "", "Table 1", "Untitled table", "Unknown"),
    ("<p>Part II</p><p>Costs of all the divisions</p><i>x</i><i>y</i>", "", "", "Costs of all the divisions", "Costs of all the divisions", "Part II"),
    ("<div>2024 is no title of a table</div><i>x</i><i>y</i><i>z</i>", " title='Named by attribute'", "", "Table 1", "Named by attribute", "Unknown"),
    ("<p>(in thousands of dollars)</p><div id='table_of_parts'>", "", "", "Table 1", "Table Of Parts", "Unknown"),
    ("<p>Near but <b>nested title of parts</b> here</p>", "", "<caption>Own caption</caption>", "Own caption - Near but nested title of parts here", "Own caption", "Unknown"),
    ("<div><p>Another division's words</p></div><section>", "", "", "Table 1", "Another division's words", "Unknown"),
]


def _quoted(*values: str) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query(
    f"""SELECT p_partkey, 0 AS position, ([{_quoted(*(p[3] for p in _PLACES))}])[(p_partkey % 7 + 1)::INT] AS caption, ([{_quoted(*(p[4] for p in _PLACES))}])[(p_partkey % 7 + 1)::INT] AS title, ([{_quoted(*(p[5] for p in _PLACES))}])[(p_partkey % 7 + 1)::INT] AS section FROM part"""
)
def table_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages with a table under near and far headings, in a division of its own, with and without a caption or title."""
    long = "Words that are no heading. " * 20
    pick = lambda k: F.element_at(F.array(*(F.lit(p[k].replace("{long}", long)) for p in _PLACES)), (F.col("p_partkey") % 7 + 1).cast("int"))
    html = F.concat(F.lit("<html><body>"), pick(0), F.lit("<table"), pick(1), F.lit(">"), pick(2), F.lit("<tr><td>name<td>size<tr><td>"), F.col("p_name"), F.lit("<td>"), F.col("p_size"), F.lit("</table></body></html>"))
    found = page_tables(table(spark, sf_dir, "part").select("p_partkey", html.alias("html")), "p_partkey", "html")
    return found.select("p_partkey", "position", "caption", "title", "section")
