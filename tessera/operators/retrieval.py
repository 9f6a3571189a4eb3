"""Ranked retrieval: keyword, vector and hybrid top-k; rerank; context packing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as text_functions
from tessera.functions import vectors

K1, B = 1.2, 0.75


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, as the tokenizer of texts gives them."""
    import regex

    return list(dict.fromkeys(regex.findall(r"[\p{L}\p{N}]+", query.lower())))


def _equal(term: str):
    return lambda t: t == term


def term_counts(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl, tf0, tf1, ...): a row per text, without exploding tokens."""
    words = docs.select(id_col, text_functions.tokens(F.col(text_col)).alias("_t"))
    hits = words.select(id_col, F.size("_t").alias("dl"), F.filter("_t", lambda t: t.isin(terms)).alias("_h"))
    return hits.select(id_col, "dl", *(F.size(F.filter("_h", _equal(term))).alias(f"tf{i}") for i, term in enumerate(terms)))


def bm25(docs: DataFrame, query: str, k: int = 10, chosen: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of the ``k`` best texts by BM25, ties by id.

    Corpus statistics are over all of ``docs``; ``chosen`` (ids) limits what is ranked.
    One pass sums statistics into a row, which goes to the scoring pass; no
    token is shuffled.
    """
    terms = query_terms(query)
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    counts = term_counts(docs, terms, id_col, text_col)
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    ranked = counts if chosen is None else counts.join(chosen.select(id_col), id_col, "left_semi")
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    parts = []
    for i in range(len(terms)):
        df, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        parts.append(F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + norm))
    scored = ranked.crossJoin(F.broadcast(stats)).select(id_col, F.round(reduce(Column.__add__, parts), 6).alias("score"))
    # Above the limit, so that the condition isn't pushed down to where it would tokenise again for each term.
    return scored.orderBy(F.desc("score"), id_col).limit(k).where("score > 0")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(token, id, tf): the inverted index, to be written by token for many queries."""
    return docs.select(id_col, F.explode(text_functions.tokens(F.col(text_col))).alias("token")).groupBy("token", id_col).agg(F.count(F.lit(1)).alias("tf"))


def vector_topk(frame: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score) of the ``k`` nearest vectors of unit length: the dot product, or 1 minus the squared distance (``l2``)."""
    vector = vectors.literal(query)
    score = vectors.dot(F.col(vector_col), vector) if metric == "cosine" else 1 - vectors.squared_distance(F.col(vector_col), vector)
    return frame.select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def vector_topk_by(frame: DataFrame, probe: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vector_topk`` for the vector in the first row of ``probe`` (query); nothing if it has none. No job runs while the plan is made."""
    met = frame.crossJoin(F.broadcast(probe.select(F.col("query").alias("_query")).limit(1)))
    score = vectors.dot(F.col(vector_col), F.col("_query")) if metric == "cosine" else 1 - vectors.squared_distance(F.col(vector_col), F.col("_query"))
    return met.select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


#: Vectors of a block on either side of a search for many.
BLOCK, QUERY_BLOCK = 4096, 1024


def _blocks(frame: DataFrame, id_col: str, vector_col: str, size: int, ids: str, data: str) -> DataFrame:
    """(ids, data): up to ``size`` vectors a row, as the bytes of a matrix; null vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                matrix = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary())], [ids, data])

    return frame.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, f"{ids} array<bigint>, {data} binary")


def vector_topk_many(frame: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) for a stated set of queries (query_id, query): each against all vectors, by whole-number ids.

    Blocks of queries meet blocks of vectors, a product of two matrices each, of
    which only the ``k`` best of each query go on to be ranked. Neither side is collected.
    """
    met = _blocks(frame, id_col, vector_col, BLOCK, "ids", "data").crossJoin(_blocks(queries, "query_id", "query", QUERY_BLOCK, "query_ids", "query_data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, query_ids, query_data in zip(*batch.columns, strict=True):
                ids, query_ids = np.array(ids.as_py()), np.array(query_ids.as_py())
                matrix, asked = (np.frombuffer(x.as_py()).reshape(len(n), -1) for x, n in ((data, ids), (query_data, query_ids)))
                scores = np.round(asked @ matrix.T, 6) + 0.0
                near = [np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row)) for row in scores]
                chosen = [n[np.lexsort((ids[n], -row[n]))[:k]] for n, row in zip(near, scores, strict=True)]
                of = np.repeat(np.arange(len(query_ids)), [len(c) for c in chosen])
                at = np.concatenate(chosen)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[of]), pa.array(ids[at]), pa.array(scores[of, at])], ["query_id", id_col, "score"])

    scored = met.mapInArrow(run, f"query_id bigint, {id_col} bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def ranked(frame: DataFrame, id_col: str, name: str) -> DataFrame:
    """A short result with 1-based ranks."""
    return frame.withColumn(name, F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def fuse_rrf(a: DataFrame, b: DataFrame, id_col: str, k: int = 10, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two top-k results (id, score)."""
    ra, rb = ranked(a, id_col, "ra").select(id_col, "ra"), ranked(b, id_col, "rb").select(id_col, "rb")
    score = F.coalesce(1 / (c + F.col("ra")), F.lit(0.0)) + F.coalesce(1 / (c + F.col("rb")), F.lit(0.0))
    return ra.join(rb, id_col, "full_outer").select(id_col, F.round(score, 8).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def fuse_weighted(vector: DataFrame, text: DataFrame, id_col: str, weight: float = 0.7, k: int = 10) -> DataFrame:
    """Weighted sum of scores scaled to 0..1 within each side; a missing side counts 0."""

    def scaled(frame: DataFrame, name: str) -> DataFrame:
        every = Window.partitionBy()
        low, high = F.min("score").over(every), F.max("score").over(every)
        return frame.select(id_col, F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)).alias(name))

    score = weight * F.coalesce("v", F.lit(0.0)) + (1 - weight) * F.coalesce("t", F.lit(0.0))
    return scaled(vector, "v").join(scaled(text, "t"), id_col, "full_outer").select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def rerank(candidates: DataFrame, query: str, k: int, id_col: str = "doc_id", text_col: str = "text", scorer=None) -> DataFrame:
    """Candidates (id, text, original_rank) by a second score, ties by original rank.

    ``scorer`` (text column, query) -> column may be a model in a Pandas UDF; by
    default the share of the query's terms in the text.
    """
    terms = query_terms(query)
    coverage = lambda text, _: F.size(F.array_intersect(text_functions.tokens(text), F.array(*map(F.lit, terms)))) / F.lit(len(terms))
    scored = candidates.withColumn("rerank_score", F.round((scorer or coverage)(F.col(text_col), query), 6))
    return scored.orderBy(F.desc("rerank_score"), "original_rank").limit(k)


def pack_context(results: DataFrame, max_tokens: int, rank_col: str = "rank", text_col: str = "text") -> DataFrame:
    """The longest prefix of the ranking whose texts fit in four characters a token."""
    running = F.sum(F.length(text_col)).over(Window.orderBy(rank_col).rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("running_chars", running).where(F.col("running_chars") <= max_tokens * 4)


def neighbours(hits: DataFrame, chunks: DataFrame, section_col: str, position_col: str, before: int = 1, after: int = 1) -> DataFrame:
    """Hits (section, position, hit_rank) with the chunks around them in their section.

    An equality join on section and position: each hit names the places that it wants.
    """
    wanted = hits.select(F.col(section_col), F.col(position_col).alias("hit_position"), "hit_rank", F.explode(F.sequence(F.col(position_col) - before, F.col(position_col) + after)).alias(position_col))
    return wanted.join(chunks, [section_col, position_col])


def parent_or_window(windows: DataFrame, parents: DataFrame, key: str, most_tokens: int = 8000) -> DataFrame:
    """Windows (key, context) with their whole section (key, content, approx_tokens) in place of the context where it is known and has ``most_tokens`` at most; ``mode`` says which: section or window."""
    whole = F.coalesce(F.col("approx_tokens") <= most_tokens, F.lit(False))
    met = windows.join(parents.select(key, "content", "approx_tokens"), key, "left")
    return met.withColumns({"mode": F.when(whole, "section").otherwise("window"), "context": F.when(whole, F.col("content")).otherwise(F.col("context"))}).drop("content", "approx_tokens")


def first_seen(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def fan_out(index, queries: DataFrame, most: int, k: int = 5, id_col: str = "doc_id") -> DataFrame:
    """The first ``most`` of some sub-queries (query_id, query), ``k`` results each, where a result counts for the first query that finds it.

    ``index`` answers many queries at once, as ``plans.text_index.TextIndex`` does.
    """
    asked = queries.orderBy("query_id").limit(most)
    return first_seen(index.bm25_many(asked, k), [id_col], "query_id", "rank")
