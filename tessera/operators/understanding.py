"""Understanding of questions: kind, expansion, periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import lexicon
from tessera.functions.bind import let

_TERM = r"([\p{L}\p{N}_&/-]+)"


def kind_scores(query: Column, kinds: dict | None = None) -> dict[str, Column]:
    """Kind -> number of its patterns that match."""
    out = {}
    for name, (patterns, as_written) in (kinds or lexicon.QUERY_KINDS).items():
        seen = query if as_written else F.lower(query)
        out[name] = reduce(Column.__add__, (seen.rlike(p).cast("int") for p in patterns))
    return out


def classify(query: Column, kinds: dict | None = None) -> Column:
    """Struct (kind, vector_weight, text_weight, confidence) of a query; ties go to the first kind named."""
    scores = kind_scores(query, kinds)
    ordered = F.sort_array(F.array(*scores.values()), asc=False)
    top, second = ordered[0], ordered[1]
    kind = F
    for name, score in scores.items():
        kind = kind.when(score == top, F.lit(name))
    kind = F.when(top == 0, F.lit("default")).otherwise(kind.otherwise(F.lit("default")))
    weights = F.create_map(*(F.lit(x) for pair in lexicon.QUERY_WEIGHTS.items() for x in pair))
    weight = F.element_at(weights, kind)
    confidence = F.when(top == 0, 0.5).when(second > 0, F.least(F.lit(0.9), 0.5 + 0.2 * (top - second))).otherwise(F.least(F.lit(0.9), 0.5 + 0.15 * top))
    return F.struct(kind.alias("kind"), weight.alias("vector_weight"), (1 - weight).alias("text_weight"), confidence.alias("confidence"))


def expand(query: Column, acronyms: dict[str, str] | None = None, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Phrases to search for besides a query: of its acronyms, acronyms of its phrases, synonyms of its words and phrases; none that it holds."""
    acronyms = lexicon.ACRONYMS if acronyms is None else acronyms
    synonyms = lexicon.SYNONYMS if synonyms is None else synonyms
    words = F.regexp_extract_all(query, F.lit(_TERM), F.lit(1))
    names = F.create_map(*(F.lit(x) for k, v in acronyms.items() for x in (k.upper(), v)))
    heads = {k: v for k, v in synonyms.items() if " " not in k}
    single = F.create_map(*(x for k, v in heads.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    none = F.array().cast("array<string>")

    def found(low: Column) -> Column:
        of_acronyms = F.transform(words, lambda w: F.try_element_at(names, F.upper(w)))
        of_phrases = F.array(*(F.when(low.contains(v.lower()), F.lit(k)) for k, v in acronyms.items()))
        of_words = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(single, F.lower(w)), none)))
        of_heads = F.flatten(F.array(none, *(F.when(low.contains(k), F.array(*map(F.lit, v))).otherwise(none) for k, v in synonyms.items() if " " in k)))
        return F.filter(F.array_distinct(F.concat(of_acronyms, of_phrases, of_words, of_heads)), lambda x: x.isNotNull() & ~F.contains(low, F.lower(x)))

    return let(F.lower(query), found)


def vector_weight(query: Column) -> Column:
    """Struct (vector_weight, text_weight) of a query's kind."""
    kind = classify(query)
    return F.struct(kind["vector_weight"].alias("vector_weight"), kind["text_weight"].alias("text_weight"))


def text_query(query: Column, expansions: Column) -> Column:
    """The query and its expansions joined by OR, phrases in quotes."""
    quoted = F.transform(expansions, lambda x: F.when(F.contains(x, F.lit(" ")), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x))
    return F.array_join(F.concat(F.array(query), quoted), " OR ")


def fiscal_period(text: Column) -> Column:
    """Struct (year, quarter) of FY25, FY2025, FY25Q3 or Q3FY25; nulls if it is none."""
    up = F.upper(F.trim(text))
    whole = r"^(?:Q([1-4]))?FY(\d{4}|\d{2})(?:Q([1-4]))?$"
    part = lambda g: F.nullif(F.regexp_extract(up, whole, g), F.lit(""))
    year = part(2).try_cast("int")
    return F.struct(F.when(year < 100, year + 2000).otherwise(year).alias("year"), F.coalesce(part(3), part(1)).try_cast("int").alias("quarter"))


def temporal_refs(query: Column) -> Column:
    """Array of (year, quarter, kind): fiscal years, then other years, then quarters with a year of their own; a quarter without one is that of the reference before it."""
    up = F.upper(query)
    none = F.lit(None).cast("int")
    state = "array<struct<year:int,quarter:int,kind:string>>"
    entry = lambda y, q, kind: F.struct(y.alias("year"), q.alias("quarter"), F.lit(kind).alias("kind"))
    full = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y).cast("int")
    fiscal = F.array_distinct(F.transform(F.regexp_extract_all(up, F.lit(r"\bFY[\s']?(\d{4}|\d{2})\b"), F.lit(1)), full))
    years = F.array_distinct(F.transform(F.regexp_extract_all(up, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))
    quarters = F.regexp_extract_all(up, F.lit(r"\b(Q[1-4](?: (?:19|20)\d{2})?)\b"), F.lit(1))
    known = F.concat(F.transform(fiscal, lambda y: entry(y, none, "fiscal")), F.transform(F.array_except(years, fiscal), lambda y: entry(y, none, "calendar"))).cast(state)

    def step(refs: Column, found: Column) -> Column:
        quarter, last = F.substring(found, 2, 1).cast("int"), F.try_element_at(refs, F.size(refs))
        attached = F.concat(F.slice(refs, 1, F.greatest(F.size(refs) - 1, F.lit(0))), F.array(F.struct(last["year"].alias("year"), quarter.alias("quarter"), last["kind"].alias("kind"))))
        own = F.concat(refs, F.array(entry(F.substring(found, 4, 4).cast("int"), quarter, "quarter")))
        return F.when(F.length(found) > 2, own).when(F.size(refs) > 0, attached).otherwise(refs).cast(state)

    return F.aggregate(quarters, known, step)


def is_comparative(query: Column) -> Column:
    return F.lower(query).rlike(r"\bcompar(e|ed|ing|ison)\b|\b(vs|versus)\b|\bchanged? (from|since)\b|\byear over year\b")


def comparison_years(refs: Column, comparative: Column) -> Column:
    """Years to compare: those referred to, or for a comparison with one year that and the year before."""
    years = F.array_sort(F.array_distinct(F.transform(refs, lambda r: r["year"])))
    return F.when(comparative & (F.size(years) == 1), F.array(years[0] - 1, years[0])).otherwise(years)


def quarter_range(year: Column, quarter: Column) -> Column:
    """Struct (start, end) of a calendar quarter, or of the year where the quarter is null."""
    start = F.make_date(year, F.when(quarter.isNull(), 1).otherwise(quarter * 3 - 2), F.lit(1))
    return F.struct(start.alias("start"), F.last_day(F.add_months(start, F.when(quarter.isNull(), 11).otherwise(2))).alias("end"))
