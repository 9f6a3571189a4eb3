"""Filters given as a dictionary: equality or membership, joined by AND."""

from __future__ import annotations

from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(frame: DataFrame, given: dict | None, allowed: set[str] | None = None) -> DataFrame:
    """Rows that meet all conditions. A list means any of its values, an empty list no condition; names not allowed are an error."""
    allowed = set(frame.columns) if allowed is None else allowed
    conditions: list[Column] = []
    for name, value in (given or {}).items():
        if name not in allowed:
            raise ValueError(f"can't filter by {name}")
        if isinstance(value, (list, tuple, set)):
            if value:
                conditions.append(F.col(name).isin(*value))
        else:
            conditions.append(F.col(name) == value)
    return frame.where(reduce(Column.__and__, conditions)) if conditions else frame


def given_only(**conditions) -> dict:
    """Conditions with a value; empty text and zero mean none."""
    return {k: v for k, v in conditions.items() if v}


#: Where a document comes from -> its types in the index.
SOURCES = {
    "sec": ["10-K", "10-Q", "8-K", "DEF 14A"],
    "transcripts": ["transcript"],
    "analyst": ["analyst_report"],
    "presentations": ["presentation"],
    "conferences": ["conference"],
    "misc": ["misc"],
}


def doc_types(sources: list[str]) -> list[str]:
    """Types of the documents that come from some sources, as a condition for ``where``; unknown sources have none, and no type means no condition."""
    return [kind for source in sources for kind in SOURCES.get(source, [])]


def fiscal(period: str | None) -> dict:
    """Conditions for FY25, FY2025, FY25Q3 or Q3FY25; none for anything else. A quarter behind the year counts before one in front."""
    m = regex.fullmatch(r"(?i)\s*(?:Q([1-4]))?FY(\d{4}|\d{2})(?:Q([1-4]))?\s*", period or "")
    return given_only(fiscal_year=int(m[2]) + (2000 if len(m[2]) == 2 else 0), fiscal_quarter=int(m[3] or m[1] or 0)) if m else {}


def content_kind(tables: bool | None = None, table_type: str | None = None) -> dict:
    """Conditions for chunks with a table, without, or (None) either; a type of table means with."""
    if table_type:
        return {"content_type": "table", "table_type": table_type}
    return {} if tables is None else {"content_type": "table" if tables else "text"}


def by_id(chunks: DataFrame, chunk_id: str, id_col: str = "chunk_id") -> DataFrame:
    """The chunk with an id, scored 1; no row if there is none."""
    return chunks.where(F.col(id_col) == chunk_id).limit(1).withColumn("score", F.lit(1.0))


def by_ids(chunks: DataFrame, wanted: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """The chunks of many ids."""
    return chunks.join(wanted.select(id_col).distinct(), id_col, "left_semi").withColumn("score", F.lit(1.0))


def between(results: DataFrame, start: str | None, end: str | None, k: int = 5, date_col: str = "filing_date", rank_col: str = "rank") -> DataFrame:
    """The first ``k`` of ranked results whose day is within two others, both included.

    A result without a day goes; one that starts with no year stays; one with a year alone is compared by year.
    """
    day, year = F.col(date_col), F.substring(F.col(date_col), 1, 4)
    out = results
    for limit, outside in ((start, lambda a, b: a < b), (end, lambda a, b: a > b)):
        if limit:
            late = outside(year, F.lit(limit[:4])) | (F.length(day) >= 10) & outside(day, F.lit(limit))
            out = out.where((F.length(day) > 0) & ~(year.rlike(r"^\d{4}$") & late))
    return out.orderBy(rank_col).limit(k)


def runnable(questions: DataFrame, retry_errors: bool = False, retry_needs_deeper: bool = False, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Questions still to be run: not those answered, failed ones or those that need more depth only if asked for; of them ``sample`` at random, if given."""
    skipped = ["answered", *([] if retry_errors else ["error"]), *([] if retry_needs_deeper else ["needs_deeper"])]
    out = questions.where(~F.col("status").isin(skipped))
    return out.orderBy(F.rand(seed)).limit(sample) if sample else out


def latest_matching(filings: DataFrame, kind: str, day: str | None = None) -> DataFrame:
    """The newest filing of a type, or that of one day."""
    return where(filings, given_only(filing_type=kind, filing_date=day)).orderBy(F.desc("filing_date"), "accession").limit(1)


def newest_first(jobs: DataFrame) -> DataFrame:
    """Jobs by when they were made, the last first."""
    return jobs.orderBy(F.desc("created_at"), "batch_id")
