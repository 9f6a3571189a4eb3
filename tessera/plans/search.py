"""Search: understand, expand, retrieve, fuse, rerank, fill the context; one lazy plan for one question or for many."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import lexicon
from tessera.functions import text as text_functions
from tessera.operators import filters, retrieval, understanding
from tessera.plans.text_index import TextIndex

#: Candidates of a side before reranking.
CANDIDATES = 30
#: Sub-queries, hops, searches and file reads by depth of a question.
DEPTHS = {"fast": (0, 1, 2, 0), "medium": (3, 2, 6, 2), "deep": (5, 3, 12, 4)}


@dataclass(frozen=True)
class Search:
    """What to search for and how: mode text, vector or hybrid; fusion rrf or weighted; filters before or after retrieval."""

    query: str
    mode: str = "hybrid"
    k: int = 10
    fusion: str = "rrf"
    vector_weight: float = lexicon.QUERY_WEIGHTS["default"]
    rerank: bool = False
    postfilter: bool = False


def search(chunks: DataFrame, ask: Search, vector: list[float] | None = None, given: dict | None = None, id_col: str = "chunk_id", text_col: str = "text", vector_col: str = "vector", scorer=None, index: TextIndex | None = None) -> DataFrame:
    """(id, score, rank[, rerank_score]) of the best chunks.

    Texts are sought in the ``index`` of the chunks; without one, all of them are read twice. ``given`` filters before retrieval, so that ``k`` rows come if there are as
    many; with ``postfilter`` after it, where fewer may be left.
    """
    wanted = CANDIDATES if ask.rerank or ask.mode == "hybrid" else ask.k
    chosen = chunks if ask.postfilter else filters.where(chunks, given)
    limited = chosen if given and not ask.postfilter else None
    text = None
    if ask.mode != "vector":
        text = index.bm25(ask.query, wanted, limited) if index else retrieval.bm25(chunks, ask.query, wanted, limited, id_col, text_col)
    near = retrieval.vector_topk(chosen, vector, wanted, "cosine", id_col, vector_col) if ask.mode != "text" else None
    if ask.mode == "hybrid":
        found = retrieval.fuse_rrf(near, text, id_col, wanted) if ask.fusion == "rrf" else retrieval.fuse_weighted(near, text, id_col, ask.vector_weight, wanted)
    else:
        found = near if text is None else text
    if given and ask.postfilter:
        found = found.join(filters.where(chunks, given).select(id_col), id_col, "left_semi")
    ranked = retrieval.ranked(found, id_col, "rank")
    if ask.rerank:
        with_text = ranked.withColumnRenamed("rank", "original_rank").join(chunks.select(id_col, text_col), id_col)
        return retrieval.rerank(with_text, ask.query, ask.k, id_col, text_col, scorer).drop(text_col)
    return ranked.where(F.col("rank") <= ask.k)


def understood(questions: DataFrame, expand: bool = True, weight: float | None = None) -> DataFrame:
    """Questions (query_id, query, ...) with their kind, confidence, weight of vectors, number of expansions and text query.

    ``weight`` stands for that of the kind.
    """
    query = F.col("query")
    kind = understanding.classify(query)
    more = understanding.expand(query) if expand else F.array().cast("array<string>")
    told = questions.withColumns({"_kind": kind, "_more": more})
    of_kind = F.col("_kind.vector_weight") if weight is None else F.lit(weight)
    return told.withColumns({"kind": F.col("_kind.kind"), "confidence": F.col("_kind.confidence"), "vector_weight": of_kind, "expansion_count": F.size("_more"), "text_query": understanding.text_query(query, F.col("_more"))}).drop("_kind", "_more")


def _scaled(found: DataFrame, id_col: str, name: str) -> DataFrame:
    """Scores of each question brought to 0..1."""
    own = Window.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    return found.select("query_id", id_col, F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)).alias(name))


def search_many(
    index: TextIndex,
    vectors: DataFrame,
    questions: DataFrame,
    k: int = 10,
    given: dict | None = None,
    expand: bool = True,
    weight: float | None = None,
    rerank: bool = True,
    candidates: int = CANDIDATES,
    context_tokens: int | None = None,
    scorer=None,
    vector_col: str = "vector",
) -> DataFrame:
    """(query_id, id, rank, score, kind, vector_weight[, original_rank, rerank_score][, running_chars]) for many questions in one plan.

    ``questions`` are (query_id, query, vector), ids whole numbers; one with a null vector goes by text alone, one of no words by
    vector alone, all others by both: texts by the question and its expansions (phrases, OR) over the index, vectors by
    the question as it is, scores of either side brought to 0..1 and added by the weights of the question's kind. ``given`` filters
    chunks before retrieval. With ``rerank`` the ``candidates`` best are ordered anew by ``scorer``
    (text column, query column; by default the share of the question's terms in the text); ``context_tokens`` ends each question's list where
    texts no longer fit, at four characters a token. ``vectors`` are (id, vector).
    """
    id_col, text_col = index.id_col, index.state["text_col"]
    wanted = candidates if rerank else k
    chosen = filters.where(index.chunks(), given).select(id_col) if given else None
    asked = understood(questions, expand, weight)
    text = index.search_many(asked.select("query_id", F.col("text_query").alias("query")), wanted, chosen)
    pool = vectors if chosen is None else vectors.join(chosen, id_col, "left_semi")
    near = retrieval.vector_topk_many(pool, asked.select("query_id", F.col(vector_col).alias("query")).where("query is not null"), wanted, id_col, vector_col)
    both = _scaled(near, id_col, "v").join(_scaled(text, id_col, "t"), ["query_id", id_col], "full_outer")
    kinds = asked.select("query_id", "kind", F.when(F.col(vector_col).isNull(), 0.0).otherwise(F.col("vector_weight")).alias("vector_weight"), text_functions.tokens(F.col("query")).alias("_terms"), F.col("query").alias("_query"))
    w = F.when(F.size("_terms") == 0, 1.0).otherwise(F.col("vector_weight"))
    fused = both.join(kinds, "query_id").withColumn("score", F.round(w * F.coalesce("v", F.lit(0.0)) + (1 - w) * F.coalesce("t", F.lit(0.0)), 6)).drop("v", "t")
    place = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    found = fused.withColumn("rank", place(F.desc("score"), id_col)).where(F.col("rank") <= wanted)
    if rerank or context_tokens is not None:
        found = found.join(index.chunks().select(id_col, F.col(text_col).alias("_text")), id_col)
    if rerank:
        terms = F.array_distinct("_terms")
        share = lambda text, _: F.coalesce(F.try_divide(F.size(F.array_intersect(text_functions.tokens(text), terms)), F.size(terms)), F.lit(0.0))
        found = found.withColumnRenamed("rank", "original_rank").withColumn("rerank_score", F.round((scorer or share)(F.col("_text"), F.col("_query")), 6))
        found = found.withColumn("rank", place(F.desc("rerank_score"), "original_rank")).where(F.col("rank") <= k)
    if context_tokens is not None:
        running = F.sum(F.length("_text")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
        found = found.withColumn("running_chars", running).where(F.col("running_chars") <= 4 * context_tokens)
    return found.drop("_terms", "_query", "_text")
