"""Text expressions: tokens, sizes, canonical forms, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([\p{L}\p{N}]+)"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    """Words parted by white space; none in an empty or null text."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, F.lit(0)).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def approx_tokens(text: Column) -> Column:
    """Words times 1.3, cut to a whole number."""
    return F.floor(n_words(text) * F.lit(1.3)).cast("int")


def char_tokens(text: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(text) / 4).cast("int")


def question_key(text: Column) -> Column:
    """Hash of the lower-cased letters, digits and single spaces of a question."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", "")
    return F.md5(F.trim(F.regexp_replace(kept, r"\s+", " ")))


def custom_id(text: Column) -> Column:
    """A request id's part: ``&`` as -and-, slashes and spaces as hyphens, marks dropped, hyphens collapsed and trimmed."""
    out = F.regexp_replace(F.regexp_replace(text, "&", "-and-"), r"/", "-")
    out = F.regexp_replace(F.regexp_replace(out, r"[,():'\"]", ""), r"\s", "-")
    return F.btrim(F.regexp_replace(out, "-+", "-"), F.lit("-"))


def restore_id(part: Column) -> Column:
    """The reverse of ``custom_id`` as far as it goes."""
    return F.regexp_replace(F.regexp_replace(part, "-and-", " & "), "-", " ")


def canonical_section(text: Column) -> Column:
    """Key under which spellings of a section's id meet."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "&", " and "), "-", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def display_width(text: Column) -> Column:
    """Length without the marks of bold and italic."""
    out = text
    for mark in (r"\*\*(.+?)\*\*", r"__(.+?)__", r"\*(.+?)\*", r"_(.+?)_"):
        out = F.regexp_replace(out, mark, "$1")
    return F.length(out)


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def safe_name(text: Column) -> Column:
    """File name: other than word characters as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_]", "_"), "_+", "_"), F.lit("_"))


def parse_date(text: Column) -> Column:
    """Dates in any of three formats; null if none fits."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd")))


def parse_decimal(text: Column, kind: str = "decimal(20,4)") -> Column:
    return F.nullif(F.regexp_replace(text, r"[,\s]", ""), F.lit("")).try_cast(kind)


def recency(age_years: Column, horizon: float, floor: float) -> Column:
    """Weight that falls with age to a floor at the horizon."""
    return F.greatest(F.lit(floor), 1 - age_years / horizon * (1 - floor))
