"""Texts for people and for models: citations, prompts, question files, summaries, tables; and answers read back."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import display_width

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def joined(frame: DataFrame, keys: list[str], order: str, line: Column, name: str, by: str = "\n") -> DataFrame:
    """One text per key: its lines in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x"))))
    return frame.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["x"]), by).alias(name))


def citation(kind: Column, day: Column, section: Column, nth: Column | None = None) -> Column:
    text = F.concat(kind, F.lit(" ("), day, F.lit(") - "), section)
    return text if nth is None else F.concat(F.lit("["), nth.cast("string"), F.lit("] "), text)


def fiscal_year_end(text: Column) -> Column:
    """``3/31`` or ``--03-31`` as ``March 31``; anything else as it is."""
    month = F.regexp_extract(text, r"^(?:--)?(\d{1,2})[/-](\d{1,2})$", 1).try_cast("int")
    day = F.regexp_extract(text, r"^(?:--)?(\d{1,2})[/-](\d{1,2})$", 2).try_cast("int")
    return F.when(month.between(1, 12), F.concat_ws(" ", F.try_element_at(F.array(*map(F.lit, MONTHS)), month), day.cast("string"))).otherwise(text)


def fiscal_facts(html: Column) -> Column:
    """Struct (year, period, year_end) of a filing's hidden facts; nulls where there are none."""
    fact = lambda name: F.nullif(F.trim(F.regexp_extract(html, rf'(?is)name="dei:{name}"[^>]*>\s*([^<]*)<', 1)), F.lit(""))
    return F.struct(fact("DocumentFiscalYearFocus").alias("year"), fact("DocumentFiscalPeriodFocus").alias("period"), fact("CurrentFiscalYearEndDate").alias("year_end"))


def board_members(html: Column) -> Column:
    """Sorted distinct names of members on the axis of individuals, with a space at each change of case."""
    found = F.regexp_extract_all(html, F.lit(r'(?s)<xbrldi:explicitMember[^>]*dimension="[^"]*IndividualAxis"[^>]*>\s*(?:\w+:)?(\w+?)(?:Member)?\s*</'), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, "([a-z])([A-Z])", "$1 $2"))))


def prompt(hits: DataFrame, key: str, rank: str, label: Column, text: Column, most: int = 15, chars: int = 4000) -> DataFrame:
    """One prompt context per key: the first ``most`` hits, each cut to ``chars``, under its label."""
    cut = F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)
    return joined(hits.where(F.col(rank) <= most), [key], rank, F.concat(F.lit("["), label, F.lit("]\n"), cut), "context", "\n---\n")


def excerpt(files: DataFrame, key: str, text_col: str, sought: Column, before: int = 5, lines: int = 20, chars: int = 5000) -> DataFrame:
    """(key, excerpt): ``lines`` lines from five before the first that holds the first 50 characters sought."""
    parts = F.split(text_col, "\n")
    at = F.array_position(F.transform(parts, lambda x: F.contains(x, F.substring(sought, 1, 50))), True)
    return files.where(at > 0).select(key, F.substring(F.array_join(F.slice(parts, F.greatest(at - before, F.lit(1)).cast("int"), lines), "\n"), 1, chars).alias("excerpt"))


def question_file(questions: DataFrame, path: str = "path") -> DataFrame:
    """(path, text): questions (path, section, id, depth, status, question, answer) as Markdown that ``sources.files.questions`` reads."""
    block = F.concat(F.lit("## "), F.col("id"), F.lit("\n**Depth:** "), F.col("depth"), F.lit("\n**Status:** "), F.col("status"), F.lit("\n**Question:** "), F.col("question"), F.coalesce(F.concat(F.lit("\n**Answer:** "), F.col("answer")), F.lit("")), F.lit("\n---\n"))
    body = joined(questions, [path, "section"], "id", block, "body", "\n")
    return body.select(path, F.concat(F.lit("---\nsection: "), F.col("section"), F.lit("\n---\n"), F.col("body")).alias("text"))


def stats_table(stats: DataFrame, name: str, columns: list[str], width: int = 30) -> DataFrame:
    """One row (table): sorted names with their numbers in columns, and a total."""
    cells = F.concat(F.rpad(F.coalesce(F.col(name), F.lit("TOTAL")), width, " "), *(F.lpad(F.col(c).cast("string"), 10, " ") for c in columns))
    rolled = stats.rollup(name).agg(*(F.sum(c).alias(c) for c in columns))
    last = F.struct(F.isnull(name).alias("last"), F.col(name).alias("name"), cells.alias("x"))
    return rolled.agg(F.array_join(F.transform(F.array_sort(F.collect_list(last)), lambda r: r["x"]), "\n").alias("table"))


def summary(sections: DataFrame, key: str, head: Column) -> DataFrame:
    """(key, text): sections (key, section, title, weight, summary, truncated) under their weight, high first."""
    order = F.when(F.col("weight") == "high", 0).when(F.col("weight") == "medium", 1).otherwise(2)
    line = F.concat(F.lit("### "), F.col("section"), F.lit(": "), F.col("title"), F.when(F.col("truncated"), F.lit(" (truncated)")).otherwise(F.lit("")), F.lit("\n\n"), F.col("summary"))
    by_weight = joined(sections, [key, "weight"], "section", line, "body", "\n\n").withColumn("order", order)
    titled = F.concat(F.lit("## "), F.initcap("weight"), F.lit(" weight\n\n"), F.col("body"))
    return joined(by_weight, [key], "order", titled, "text", "\n\n").select(key, F.concat(head, F.lit("\n\n"), F.col("text")).alias("text"))


def align(rows: DataFrame, key: str, order: str, cells: str) -> DataFrame:
    """(key, text): tables of cells with all columns as wide as their widest cell shows, three at least."""
    each = rows.select(key, order, F.posexplode(cells).alias("column", "cell"))
    width = F.greatest(F.lit(3), F.max(display_width(F.col("cell"))).over(Window.partitionBy(key, "column")))
    padded = each.withColumn("cell", F.concat(F.col("cell"), F.repeat(F.lit(" "), width - display_width(F.col("cell")))))
    line = joined(padded, [key, order], "column", F.col("cell"), "line", " | ")
    return joined(line, [key], order, F.concat(F.lit("| "), F.col("line"), F.lit(" |")), "text")


def _shown(cell: str) -> int:
    """Length of a cell without the marks of bold and italic, as ``display_width`` has it."""
    for mark in (r"\*\*(.+?)\*\*", r"__(.+?)__", r"\*(.+?)\*", r"_(.+?)_"):
        cell = re.sub(mark, r"\1", cell)
    return len(cell)


def _aligned(lines: list[str]) -> Iterator[str]:
    """A table's lines with all columns as wide as their widest cell shows; rows of dashes are made anew, with their colons."""
    rows = [[c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|")] for line in lines]
    many = max(map(len, rows))
    rows = [row + [""] * (many - len(row)) for row in rows]
    widths = [max(map(_shown, column)) for column in zip(*rows, strict=True)]
    for row in rows:
        if any(row) and all(set(c) <= set("-:") for c in row):
            ends = [(c[:1] == ":", c[-1:] == ":") for c in row]
            row = [":" * left + "-" * (w - left - right) + ":" * right for w, (left, right) in zip(widths, ends, strict=True)]
        yield "| " + " | ".join(c + " " * (w - _shown(c)) for c, w in zip(row, widths, strict=True)) + " |"


def realign(text: Column) -> Column:
    """Markdown whose tables (runs of lines that start and end with a bar) are aligned as they show; all other lines stay."""

    def table(line: str) -> bool:
        bare = line.strip()
        return len(bare) > 1 and bare[0] == bare[-1] == "|"

    def one(markdown: str | None) -> str | None:
        if markdown is None:
            return None
        runs = groupby(markdown.split("\n"), key=table)
        return "\n".join(line for is_table, lines in runs for line in (_aligned(list(lines)) if is_table else lines))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(text)


def wrap(text: Column, width: int = 100) -> Column:
    """Markdown with long lines wrapped; headers, tables, rules and code stay, list items hang."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            out, code = [], False
            for line in t.split("\n"):
                code ^= line.lstrip().startswith("```")
                bare = line.lstrip()
                if code or len(line) <= width or bare.startswith(("#", "|", "```", "---")):
                    out.append(line)
                    continue
                hang = " " * (len(line) - len(bare) + (2 if bare[:2] in ("- ", "* ") else 0))
                out += textwrap.wrap(line, width, subsequent_indent=hang, break_long_words=False, break_on_hyphens=False) or [line]
            return "\n".join(out)

        for batch in batches:
            yield batch.map(one)

    return run(text)


def answer_parts(answer: Column) -> Column:
    """Struct (confidence, missing) of a model's answer: its heading's word, else medium; what it says is missing unless none."""
    said = F.lower(F.regexp_extract(answer, r"(?i)confidence[^\n]*?\b(high|medium|low)\b", 1))
    missing = F.trim(F.regexp_extract(answer, r"(?is)missing information:?\**\s*(.*?)(?:\n#|\n\*\*|$)", 1))
    return F.struct(F.when(said == "", F.lit("medium")).otherwise(said).alias("confidence"), F.when((missing == "") | F.lower(missing).rlike(r"^none\b"), F.lit(None).cast("string")).otherwise(F.substring(missing, 1, 500)).alias("missing"))


def sub_queries(reply: Column) -> Column:
    """Array of strings of a model's JSON reply, with or without a code fence; empty if it is none."""
    bare = F.trim(F.regexp_replace(reply, r"(?s)^\s*```(?:json)?|```\s*$", ""))
    return F.coalesce(F.from_json(bare, "array<string>"), F.array().cast("array<string>"))


#: What a section's summary should be, by its weight.
PROMPTS = {
    "high": "Summarise this section in depth: every figure, change and reason that a reader would act on.",
    "medium": "Summarise this section: its main figures and changes.",
    "low": "Say in a few sentences what this section adds.",
}


def section_prompt(weight: Column, guidance: Column) -> Column:
    """The prompt of a section's weight (medium for unknown ones), with guidance where there is some."""
    base = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in PROMPTS.items() for x in pair)), weight), F.lit(PROMPTS["medium"]))
    return F.concat_ws("\n\nFor this section: ", base, F.nullif(guidance, F.lit("")))


def user_message(company: Column, context: Column, question: Column) -> Column:
    """A question with the excerpts that it is to be answered from."""
    return F.concat(F.lit("Excerpts from filings of "), company, F.lit(":\n\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer from the excerpts alone and name the filing and section of each fact."))


def marked_note(text: Column, mark: str, chars: int = 500) -> Column:
    """From a mark to the next blank line, or ``chars`` characters where none follows; empty without the mark."""
    at = F.locate(mark, text)
    rest = F.substr(text, at)
    stop = F.locate("\n\n", rest)
    return F.when(at > 0, F.trim(F.when(stop > 0, F.substr(rest, F.lit(1), stop - 1)).otherwise(F.substring(rest, 1, chars)))).otherwise(F.lit(""))


def results_json(results: DataFrame, key: str, rank: str, header: dict[str, Column]) -> DataFrame:
    """(key, json): the results of each question in order, under a header with their number; tables only where a result has one. Results are as few as a question returns."""
    with_table = lambda c: F.when(F.col("has_table"), F.col(c)).alias(c)
    row = F.struct("filing_type", "filing_date", "section", "score", "text", "has_table", with_table("table_html"), with_table("table_caption"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), row.alias("r")))), lambda x: x["r"])
    grouped = results.groupBy(key).agg(ordered.alias("results"), *(F.first(c).alias(n) for n, c in header.items()))
    return grouped.select(key, F.to_json(F.struct(*header, F.size("results").alias("result_count"), "results"), {"ignoreNullFields": "false"}).alias("json"))


def read_summary(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, head, section, title, weight, truncated, summary) of rendered summaries: one row per section, in the text's order by ``at``."""
    lines = texts.select(id_col, F.posexplode(F.split(F.regexp_replace(text_col, "^\\uFEFF", ""), "\n")).alias("at", "line"))
    up_to = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    part = lambda pattern, g: F.nullif(F.regexp_extract("line", pattern, g), F.lit(""))
    header = r"^### ([^:\n]+): (.*?)( \(truncated\))?$"
    seen = lines.withColumns({
        "head": F.first(part(r"^# (.+)$", 1), ignorenulls=True).over(up_to),
        "weight": F.lower(F.last(part(r"^## (\w+) weight$", 1), ignorenulls=True).over(up_to)),
        "starts": F.col("line").rlike(header),
        "nth": F.sum(F.col("line").rlike(header).cast("int")).over(up_to),
        "other": F.col("line").rlike(r"^#{1,2} "),
    })
    body = F.array_sort(F.collect_list(F.when(~F.col("starts") & ~F.col("other"), F.struct("at", "line"))))
    first = lambda c: F.max(F.when(F.col("starts"), c))
    cut = seen.where("nth > 0").groupBy(id_col, "nth").agg(
        F.max("head").alias("head"),
        first(F.regexp_extract("line", header, 1)).alias("section"),
        first(F.regexp_extract("line", header, 2)).alias("title"),
        first(F.col("weight")).alias("weight"),
        first(F.regexp_extract("line", header, 3) != "").alias("truncated"),
        F.btrim(F.array_join(F.transform(body, lambda x: x["line"]), "\n"), F.lit("\n ")).alias("summary"),
    )
    return cut.withColumnRenamed("nth", "at")
