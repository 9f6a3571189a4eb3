"""Tables in text: cells, Markdown, kinds; and native extraction from HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import lexicon


def classify(caption: Column, content: Column, kinds: dict[str, list[str]] | None = None) -> Column:
    """Kind with the most matching patterns over caption and the first 2000 characters, ties to the first named; other if none."""
    seen = F.lower(F.concat_ws(" ", caption, F.substring(content, 1, 2000)))
    scores = {k: reduce(Column.__add__, (seen.rlike(p).cast("int") for p in v)) for k, v in (kinds or lexicon.TABLE_KINDS).items()}
    top = F.greatest(*scores.values())
    out = F.when(top == 0, F.lit("other"))
    for name, score in scores.items():
        out = out.when(score == top, F.lit(name))
    return out


def markdown(rows: Column) -> Column:
    """Rows of cells as a Markdown table: white space collapsed, bars escaped, short rows padded."""
    width = F.array_max(F.transform(rows, F.size))
    clean = lambda c: F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), r"\|", r"\\|")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, clean), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, 2, F.size(rows)), line)), "\n"))


def readable(cells: Column) -> Column:
    """A row as text: blanks and repeats of the cell before dropped, a currency sign joined to the number after it, two spaces between."""
    kept = F.filter(cells, lambda c, i: (F.length(F.trim(F.coalesce(c, F.lit("")))) > 0) & ((i == 0) | ~F.coalesce(cells[F.greatest(i - 1, F.lit(0))] == c, F.lit(False))))
    number = lambda c: F.regexp_replace(c, r"[,().-]", "").rlike(r"^\d+$")
    state = "struct<done:array<string>,sign:string>"

    def step(s: Column, c: Column) -> Column:
        sign = c.rlike(r"^[$€£¥]$")
        text = F.when(number(c), F.concat(s["sign"], c)).when(s["sign"] != "", F.concat(s["sign"], F.lit("  "), c)).otherwise(c)
        return F.struct(F.when(sign, s["done"]).otherwise(F.concat(s["done"], F.array(text))).alias("done"), F.when(sign, c).otherwise(F.lit("")).alias("sign")).cast(state)

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("sign")).cast(state)
    return F.array_join(F.aggregate(F.transform(kept, lambda c: F.trim(c)), zero, step, lambda s: F.when(s["sign"] != "", F.concat(s["done"], F.array(s["sign"]))).otherwise(s["done"])), "  ")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]*)"'), F.lit(1))


def html_text(html: Column) -> Column:
    """All visible text of a page by patterns alone: no nesting, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</(script|style|head)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, letter in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.regexp_replace(out, entity, letter)
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


#: Kind of table -> words of its caption, in the order in which they are tried.
CORPUS_LABELS = {
    "financial_statement": ["balance sheet", "statements of operations", "income statement", "cash flow", "stockholders equity"],
    "compensation": ["compensation", "stock awards", "option", "equity", "salary", "bonus", "executive"],
    "segment_data": ["segment", "geographic", "product line"],
    "schedule": ["schedule", "reconciliation", "rollforward"],
    "governance": ["vote", "proposal", "director", "nominee"],
    "metrics": ["metrics", "kpi", "summary", "highlights"],
}


def corpus_label(caption: Column, html: Column) -> Column:
    """The first kind with a word in the caption; comparison if the table names a year, else other."""
    low, out = F.lower(caption), F
    for kind, words in CORPUS_LABELS.items():
        out = out.when(reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in words)), F.lit(kind))
    return out.when(html.rlike(r"20\d{2}"), F.lit("comparison")).otherwise(F.lit("other"))


def corpus_tables(found: Column, html_chars: Column) -> Column:
    """Tables (an array of cell rows) fit for a corpus: 2 to 100 rows, two columns at least, and no more than 50000 characters of markup."""
    return F.size(found).between(2, 100) & (F.array_max(F.transform(found, F.size)) >= 2) & (html_chars <= 50_000)


def with_markdown(text: Column, found: Column) -> Column:
    """A page's text (see ``html_tables.parse``) where each marked table is its Markdown."""
    marked = F.filter(found, lambda t: F.size(t["rows"]) >= 2)
    plain = F.split(text, r"(?s)\[TABLE: [^\n]*\]\n.*?\[/TABLE\]")
    return F.array_join(F.transform(plain, lambda part, i: F.concat(part, F.coalesce(markdown(F.try_element_at(marked, i + 1)["rows"]), F.lit("")))), "")
