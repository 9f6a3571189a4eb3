"""Planning of summaries: weights, limits, request ids; and putting batches together again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import lexicon
from tessera.functions import text as text_functions
from tessera.operators.chunking import split_by_chars

#: Most output tokens of a request, and characters of its part by weight.
MOST_TOKENS, HIGH_CHARS, OTHER_CHARS = 32_000, 80_000, 50_000


def weights(spark, given: dict | None = None) -> DataFrame:
    """(section_key, weight, base_tokens, guidance): a small table, whose size is that of the dictionary."""
    rows = [(k, *v) for k, v in (lexicon.SECTION_WEIGHTS if given is None else given).items()]
    return spark.createDataFrame(rows, "section_key string, weight string, base_tokens int, guidance string")


def with_weights(sections: DataFrame, section_col: str, table: DataFrame) -> DataFrame:
    """Sections with their weight; those not in the table have the default."""
    key = text_functions.canonical_section(F.col(section_col))
    met = sections.join(table, key == table.section_key, "left").drop("section_key")
    return met.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in zip(("weight", "base_tokens", "guidance"), lexicon.DEFAULT_WEIGHT, strict=True)})


def token_limit(base: Column, chars: Column, multiplier: float = 1.0) -> Column:
    """The larger of the base and six tenths of the text's tokens, times the multiplier, and at most MOST_TOKENS."""
    limit = F.greatest(base, F.floor(F.floor(chars / 4) * 0.6).cast("int"))
    return F.least(F.floor(limit * multiplier).cast("int") if multiplier > 1 else limit, F.lit(MOST_TOKENS))


def plan(sections: DataFrame, section_col: str, content_col: str, prefix: Column, table: DataFrame, high_chars: int = HIGH_CHARS, other_chars: int = OTHER_CHARS, multiplier: float = 1.0) -> DataFrame:
    """Requests for all sections: adds part, parts, custom_id, max_tokens; ``content_col`` becomes the part's text."""
    weighted = with_weights(sections, section_col, table)
    text = F.col(content_col)
    parts = F.when(F.col("weight") == "high", split_by_chars(text, high_chars)).otherwise(split_by_chars(text, other_chars))
    cut = weighted.withColumn("_parts", parts).withColumn("parts", F.size("_parts"))
    each = cut.select("*", F.posexplode("_parts").alias("part", "_text")).drop("_parts", content_col).withColumnRenamed("_text", content_col)
    name = F.concat_ws("_", prefix, text_functions.custom_id(F.col(section_col)))
    return each.withColumn("custom_id", F.when(F.col("parts") > 1, F.concat(name, F.lit("_part"), F.col("part") + 1)).otherwise(name)).withColumn("max_tokens", token_limit(F.col("base_tokens"), F.length(content_col), multiplier))


def regroup(results: DataFrame, id_col: str = "custom_id", text_col: str = "summary") -> DataFrame:
    """Results of parts as one per section: texts in order, tokens added up, truncated if any part was."""
    base = F.regexp_replace(id_col, r"_part\d+$", "")
    part = F.coalesce(F.nullif(F.regexp_extract(id_col, r"_part(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))
    texts = F.array_sort(F.collect_list(F.struct(part.alias("part"), F.col(text_col).alias("text"))))
    return results.groupBy(base.alias("section")).agg(F.array_join(F.transform(texts, lambda t: t["text"]), "\n\n").alias("summary"), F.sum("tokens").alias("tokens"), F.bool_or("truncated").alias("truncated"), F.count(F.lit(1)).alias("parts"))


def merge_sections(old: DataFrame, new: DataFrame, key_col: str) -> DataFrame:
    """Old sections with the new ones put in their place or added, by canonical key."""
    key = text_functions.canonical_section(F.col(key_col))
    a, b = old.withColumn("_key", key), new.withColumn("_key", key)
    return a.join(b.select("_key"), "_key", "left_anti").unionByName(b).drop("_key")


def missing(expected: DataFrame, generated: DataFrame, key_col: str) -> DataFrame:
    key = text_functions.canonical_section(F.col(key_col)).alias("_key")
    return expected.withColumn("_key", key).join(generated.select(key), "_key", "left_anti").drop("_key")


#: Kind of document -> the sections that are asked of it; others are asked for one summary.
DOCUMENT_SECTIONS = {"transcript": ["Prepared Remarks", "Q&A"], "conference": ["Prepared Remarks", "Q&A"]}
#: Characters of a part of such a document.
DOCUMENT_CHARS = 250_000


def plan_documents(documents: DataFrame, kind_col: str, content_col: str, prefix: Column, table: DataFrame, only: list[str] | None = None, chars: int = DOCUMENT_CHARS) -> DataFrame:
    """Requests for whole documents: one for each section of the document's kind (adds ``section``), with parts like ``plan``; ``only`` keeps sections by canonical key."""
    known = F.create_map(*(x for kind, names in DOCUMENT_SECTIONS.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))))
    each = documents.withColumn("section", F.explode(F.coalesce(F.try_element_at(known, F.col(kind_col)), F.array(F.lit("Summary")))))
    if only:
        each = each.where(text_functions.canonical_section(F.col("section")).isin(*(" ".join(o.lower().replace("&", " and ").replace("-", " ").split()) for o in only)))
    return plan(each, "section", content_col, prefix, table, chars, chars)


def resubmit(sections: DataFrame, results: DataFrame, section_col: str, content_col: str, prefix: Column, table: DataFrame, multiplier: float = 1.5, **limits) -> DataFrame:
    """Requests, with higher limits, for the sections that have a truncated result (custom_id, truncated), and for no others; ids are made as before."""
    base = F.regexp_replace("custom_id", r"_part\d+$", "").alias("_base")
    cut = results.where("truncated").select(base).distinct()
    name = F.concat_ws("_", prefix, text_functions.custom_id(F.col(section_col)))
    again = sections.withColumn("_base", name).join(cut, "_base", "left_semi").drop("_base")
    return plan(again, section_col, content_col, prefix, table, multiplier=multiplier, **limits)


def until_whole(
    sections: DataFrame, section_col: str, content_col: str, prefix: Column, table: DataFrame, summarise: Callable[[DataFrame], DataFrame], at: str, multiplier: float = 1.5, most_rounds: int = 10, **limits
) -> DataFrame:
    """(custom_id, round, max_tokens, and what ``summarise`` adds): the last result of each request.

    ``summarise`` (requests) -> results with ``truncated`` may be a batch of a model. Sections with a truncated result are planned again, with
    limits that rise from round to round, until none is left, or only such as have the highest limit already. Each round is written under
    ``at``, so that a later one starts from tables; only the number of rounds and a flag come to the driver.
    """
    spark, rounds = sections.sparkSession, []
    now = plan(sections, section_col, content_col, prefix, table, **limits)
    for k in range(most_rounds):
        summarise(now).withColumn("round", F.lit(k)).write.mode("overwrite").parquet(f"{at}/round={k}/results")
        done = spark.read.parquet(f"{at}/round={k}/results")
        rounds.append(done)
        open_ = done.where(F.col("truncated") & (F.col("max_tokens") < MOST_TOKENS))
        if not open_.limit(1).count():
            break
        now = resubmit(sections, open_, section_col, content_col, prefix, table, multiplier ** (k + 1), **limits)
    last = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        last = last.unionByName(earlier.join(last.select("custom_id"), "custom_id", "left_anti"))
    return last
