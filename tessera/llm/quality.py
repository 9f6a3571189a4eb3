"""Quality rules as a short-circuit cascade; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = r"[\x20\x09-\x0D]+"
_ENDS = " \t\n\x0b\x0c\r"
#: Words of a window that must not recur.
WINDOW = 8
#: Rows on which costs and rejections are estimated. They set the order of the rules, never a verdict.
SAMPLE_ROWS = 2000
#: Times that each rule is tried on a row of the sample, and the least nanoseconds that a rule counts for.
REPEATS, LEAST_COST = 5, 1024
_CLOCK = ""


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, words, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, row) of each row; ``row`` has all its columns.

    Words are runs of anything but ASCII white space; null texts have none.
    ``n_repeat_words`` counts the words that stand in a WINDOW of words which
    occurs twice or more in the text, the first included: windows are hashed,
    and only texts with equal hashes have theirs sorted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(_ENDS))
    a = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"), trimmed.alias("trimmed"))
    a = a.select("row", "doc_id", "text", F.when(F.length("trimmed") == 0, F.array().cast("array<string>")).otherwise(F.split("trimmed", _BLANKS)).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    a = a.select("row", "doc_id", "text", "words", lines.alias("lines"), F.when(F.size("words") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("windows"))
    recurs = F.size(F.array_distinct("windows")) < F.size("windows")
    a = a.select("*", F.when(recurs, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ordered"))
    like = lambda e, other: F.coalesce(F.try_element_at("ordered", other)["h"] == e["h"], F.lit(False))
    again = F.filter("ordered", lambda e, j: F.when(j > 0, like(e, j)).otherwise(F.lit(False)) | like(e, j + 2))
    a = a.select("*", F.sort_array(F.transform(again, lambda e: e["i"])).alias("again"))
    covered = F.transform("again", lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.try_element_at("again", j + 2) - i, F.lit(WINDOW))))
    counted = a.select(
        "row",
        "doc_id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda s, n: s + n), F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    # A generator of one row keeps filters on these columns above it: pushed below, they
    # would put the whole chain of projections into each of its own lambdas.
    return counted.select(F.inline_outer(F.array(F.struct(*counted.columns))))


def base_failed() -> Column:
    """Too few words, or too many of them in recurring windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Name -> true where the rule rejects; over the columns of ``base_features``."""
    n = F.col("n_words")
    count = lambda pattern: F.regexp_count("text", F.lit(pattern))
    return {
        "word_length": (F.col("word_chars") > 20 * n) | (F.col("word_chars") < 2 * n),
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "dup_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "no_letters": 10 * F.size(F.filter("words", lambda w: ~w.rlike(r"\p{L}"))) > 3 * n,
        "capitals": 2 * count(r"\p{Lu}") > F.col("word_chars"),
        "exclaims": 10 * count(r"!") > 3 * n,
        "cut_lines": (F.col("n_lines") > 1) & (10 * count(r"(?m)(\.\.\.|…)[\x20\x09\x0D]*$") > 3 * F.col("n_lines")),
        "bullets": (F.col("n_lines") > 3) & (10 * count(r"(?m)^[\x20\x09]*[-*•][\x20\x09]") > 9 * F.col("n_lines")),
    }


def rule_costs(docs: DataFrame, named: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(rule, nanoseconds, rejected, rows): what each rule costs a row and how many it rejects, over the base-passing rows of a sample.

    The sample has about ``sample_rows`` rows from all over the table. One job
    times every rule on every row, REPEATS times, between two readings of the
    clock, so that whatever slows a task slows all rules alike; a rule's cost is the median, less what the clock itself takes.
    """
    total = max(docs.count(), 1)
    sample = base_features(docs.sample(min(1.0, sample_rows / total), seed=42), id_col, text_col).where(~base_failed())
    again = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("_round"))
    now = F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    probes = named | {_CLOCK: F.lit(None).cast("boolean")}
    timed = again.select("_round", *(F.struct(now.alias("began"), rejects.alias("hit"), now.alias("ended")).alias(f"r{k}") for k, rejects in enumerate(probes.values())))
    each = timed.select("_round", F.inline(F.array(*(F.struct(F.lit(name).alias("rule"), (F.col(f"r{k}.ended") - F.col(f"r{k}.began")).alias("took"), F.coalesce(f"r{k}.hit", F.lit(False)).alias("hit")) for k, name in enumerate(probes)))))
    first = F.col("_round") == 1
    return each.groupBy("rule").agg(F.median("took").alias("nanoseconds"), F.count_if(first & F.col("hit")).alias("rejected"), F.count_if(first).alias("rows"))


def order_rules(docs: DataFrame, named: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per cost, most first, as ``rule_costs`` estimates them; equal ones as given.

    Costs count in powers of four, so that noise between rules of about one cost
    doesn't decide. A row is kept if and only if no rule rejects it, so the order
    changes the cost alone.
    """
    found = {r["rule"]: r for r in rule_costs(docs, named, id_col, text_col, sample_rows).collect()}
    idle = found[_CLOCK]["nanoseconds"] if found else 0
    score = {}
    for name in named:
        if name in found:
            r = found[name]
            score[name] = (r["rejected"] + 1) / (r["rows"] + 2) / 4 ** round(math.log(max(r["nanoseconds"] - idle, LEAST_COST), 4))
    return sorted(named, key=lambda name: -score.get(name, 0.0))


def cascade(order: list[str], named: dict[str, Column]) -> Column:
    """Name of the first rule, in this order, that rejects; null if none does. Later rules aren't evaluated then."""
    out = F
    for name in order:
        out = out.when(named[name], F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``base_features`` with ``base_failed``, ``kept`` and ``rejected_by`` (the rule met first; null if kept or base-failed)."""
    named = rules()
    order = order_rules(docs, named, id_col, text_col, sample_rows)
    judged = base_features(docs, id_col, text_col).withColumn("base_failed", base_failed())
    judged = judged.withColumn("rejected_by", F.when(~F.col("base_failed"), cascade(order, named)))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: its id, counts and verdict.

    Repeated rows each have one; null and empty texts have no words and fail.
    Other columns are ignored. An empty table gives an empty result.
    """
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]
    return verdicts(docs, id_col, text_col, sample_rows).select(*columns)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns of any name, that ``judge`` keeps: null, empty and blank texts go, repeated rows stay as often as they come, null ids are no matter. An empty table gives an empty result."""
    return verdicts(docs, id_col, text_col).where("kept").select("row.*")
