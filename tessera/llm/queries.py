"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, html, jaccard, lines, mining, oracles, packing, quality, repair, simhash, suffixes, tokens, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, whatever it holds: doc_id, n_words, n_tokens, n_unknown; zeros for null and empty texts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of maximal conversations: conv_id, part, piece, n_turns, text; rows alike count once; nulls as ``chat.format_chats`` says."""
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its counts, base_failed and kept; null and empty texts fail. Repeated rows each have a row."""
    return quality.judge(_table(spark, sf_dir, "documents")).drop("rejected_by")  # depends on the order of the rules


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and item that it leaks: doc_id, item_id, share, answer_share; null and empty texts leak nothing."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; a null or empty text is one piece of the end's id."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: (host, path, verdict)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: page_id, url, text, n_chars; an empty text where the page is null, empty or has no article."""
    pages = _table(spark, sf_dir, "pages")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the host's trust and distrust; null urls have an empty host and are allowed."""
    judged = urls.judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    return judged.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id; null, empty and blank texts have fingerprint zero and are linked like any other."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; null texts are empty."""
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"), with_kept=False).drop("removed")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256; null and empty texts have one empty line, whose empty key never goes."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = lines.with_dropped(docs, lines.line_bitmaps(docs, min_docs=10, min_chars=1))
    return marked.select(
        "doc_id",
        F.size(lines.split_lines(F.col("text"))).cast("long").alias("n_lines"),
        lines.n_dropped(F.col("dropped")).alias("n_dropped"),
        F.sha2(lines.kept_text(F.col("text"), F.col("dropped")), 256).alias("kept_sha256"),
    )


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per anchor, positive and hard negative: anchor_id, positive_id, rank, negative_id and both scores; odd rows as ``mining.mine`` says."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mining.mine(rows, F.col("vec_id") % 100 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation, damaged as ``repair.damage`` says: conv_id, its faults, cost, audit and repaired_sha256; zeros and empty texts where no row is left."""
    rows = _table(spark, sf_dir, "conversations")
    found = repair.repair(repair.damage(rows)).withColumnRenamed("conv_id", "_id")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id; null, empty and blank texts have no shingles and keep their own id."""
    return jaccard.link_documents(_table(spark, sf_dir, "documents"), width=3, percent=90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_html_extraction": op2_html_extraction,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_quality_rules": op4_quality_rules,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_url_filters": op7_url_filters,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negative_mining": op11_hard_negative_mining,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op4_quality_rules": oracles.QUALITY,
    "op6_chat_formatting": oracles.CHAT,
    "op7_url_filters": oracles.urls(URL_RULES),
    "op10_line_dedup": oracles.LINES,
    "op11_hard_negative_mining": oracles.MINING,
    "op12_conversation_repair": oracles.REPAIR,
    "op13_ngram_jaccard_join": oracles.JACCARD,
}
