"""Search over documents, vectors and conversations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import text as text_functions
from tessera.operators import filters, retrieval
from tessera.plans import text_index
from tessera.sources import folders

QUERY = "the thing that was there, on and of"
_TERMS = "SELECT unnest(['the','thing','that','was','there','on','and','of']) AS term"
_TOKENS = "SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents"
_BM25 = f"""
tok AS ({_TOKENS}), dl AS (SELECT doc_id, lang, coalesce(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')), 0) AS dl FROM documents),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, token, count(*) AS tf FROM tok WHERE token IN (SELECT term FROM ({_TERMS})) GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM tf JOIN df USING (token) JOIN dl USING (doc_id), stats GROUP BY 1)"""


#: Where the index of a table stands, by session and state of the table.
_INDEXES: dict[tuple[str, str], str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that all executors share; a temporary one only where none is set and Spark runs locally."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table_index(spark: SparkSession, sf_dir: str) -> text_index.TextIndex:
    """The index of the documents: written once a session, in the shared folder, and then read by all keyword queries; again if the table's files have changed or the index is gone."""
    key = (spark.sparkContext.applicationId, folders.fingerprint(spark, f"{sf_dir}/documents.parquet"))
    if key in _INDEXES and folders.names(spark, _INDEXES[key]):
        return text_index.open_index(spark, _INDEXES[key])
    _INDEXES[key] = new_folder(spark, "text-index")
    return text_index.create(table(spark, sf_dir, "documents").select("doc_id", "text"), _INDEXES[key])


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id = 7").select(F.col("embedding").alias("query"))


@query(f"WITH {_BM25} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_index(spark, sf_dir).bm25(QUERY)


@query(f"WITH {_BM25} SELECT doc_id, score FROM bm JOIN documents USING (doc_id) WHERE lang = 'fr' ORDER BY score DESC, doc_id LIMIT 10")
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return table_index(spark, sf_dir).bm25(QUERY, chosen=filters.where(docs, {"lang": "fr"}))


@query(f"WITH {_BM25}, top AS (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 30) SELECT doc_id, score FROM top JOIN documents USING (doc_id) WHERE lang IN ('en', 'es')")
def bm25_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return filters.where(table_index(spark, sf_dir).bm25(QUERY, k=30).join(docs.select("doc_id", "lang"), "doc_id"), {"lang": ["en", "es"]}).select("doc_id", "score")


@query(f"WITH tok AS ({_TOKENS}) SELECT token, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM tok GROUP BY 1")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieval.postings(table(spark, sf_dir, "documents"))
    return index.groupBy("token").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("documents"))


@query("SELECT lang, count(*) AS documents, sum(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')))::BIGINT AS tokens, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size(text_functions.tokens(F.col("text")))).alias("tokens"), F.sum(F.length("text")).alias("chars"))


_SCORES = "SELECT vec_id, label, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7) AS q FROM embeddings"


@query(f"SELECT vec_id, round(list_inner_product(e, q), 6) AS score FROM ({_SCORES}) ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_topk_by(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir))


@query(f"SELECT vec_id, round(list_inner_product(e, q), 6) AS score FROM ({_SCORES}) WHERE label IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_topk_by(filters.where(table(spark, sf_dir, "embeddings"), {"label": [1, 2, 3]}), _probe(spark, sf_dir))


@query(f"SELECT vec_id, score FROM (SELECT vec_id, label, round(list_inner_product(e, q), 6) AS score FROM ({_SCORES}) ORDER BY score DESC, vec_id LIMIT 30) WHERE label IN (1, 2, 3)")
def vector_topk_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    top = retrieval.vector_topk_by(vectors, _probe(spark, sf_dir), k=30)
    return filters.where(top.join(vectors.select("vec_id", "label"), "vec_id"), {"label": [1, 2, 3]}).select("vec_id", "score")


@query(f"SELECT vec_id, round(1 - list_sum(list_transform(list_zip(e, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS score FROM ({_SCORES}) ORDER BY score DESC, vec_id LIMIT 10")
def l2_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_topk_by(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), metric="l2")


@query(
    """SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
    FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= 5"""
)
def vector_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.vector_topk_many(vectors, asked)


@query(f"SELECT vec_id, round(list_inner_product(e, q), 6) AS score FROM ({_SCORES}) WHERE vec_id <> 7 ORDER BY score DESC, vec_id LIMIT 10")
def similar_exclude_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.vector_topk_by(vectors.where("vec_id <> 7"), _probe(spark, sf_dir))


_SIDES = f"""{_BM25}, t AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 30),
v AS (SELECT vec_id AS doc_id, round(list_inner_product(e, q), 6) AS score FROM ({_SCORES}) ORDER BY score DESC, vec_id LIMIT 30)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vector = retrieval.vector_topk_by(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), k=30).withColumnRenamed("vec_id", "doc_id")
    return vector, table_index(spark, sf_dir).bm25(QUERY, k=30)


@query(
    f"""WITH {_SIDES}, rv AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM v), rt AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM t)
    SELECT doc_id, round(coalesce(1.0 / (60 + rv.r), 0) + coalesce(1.0 / (60 + rt.r), 0), 8) AS score FROM rv FULL JOIN rt USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10"""
)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector, text = _sides(spark, sf_dir)
    return retrieval.fuse_rrf(vector, text, "doc_id")


@query(
    f"""WITH {_SIDES}, sv AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS s FROM v), st AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS s FROM t)
    SELECT doc_id, round(0.7 * coalesce(sv.s, 0) + (1 - 0.7) * coalesce(st.s, 0), 6) AS score FROM sv FULL JOIN st USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10"""
)
def hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector, text = _sides(spark, sf_dir)
    return retrieval.fuse_weighted(vector, text, "doc_id")


_RANKED = f"{_BM25}, r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS original_rank FROM bm ORDER BY score DESC, doc_id LIMIT 30)"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return retrieval.ranked(table_index(spark, sf_dir).bm25(QUERY, k=30), "doc_id", "original_rank").join(docs.select("doc_id", "text"), "doc_id")


@query(
    f"""WITH {_RANKED}, s AS (SELECT doc_id, original_rank, round(len(list_intersect(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ['there','thing','that','was','the','on','and','of'])) / 8.0, 6) AS rerank_score FROM r JOIN documents USING (doc_id))
    SELECT doc_id, original_rank, rerank_score::DOUBLE AS rerank_score FROM s ORDER BY rerank_score DESC, original_rank LIMIT 10"""
)
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rerank(_ranked(spark, sf_dir), QUERY, 10).select("doc_id", "original_rank", "rerank_score")


@query(
    f"""WITH {_RANKED}, p AS (SELECT doc_id, original_rank, sum(length(text)) OVER (ORDER BY original_rank)::BIGINT AS running_chars FROM r JOIN documents USING (doc_id))
    SELECT * FROM p WHERE running_chars <= 40000"""
)
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.pack_context(_ranked(spark, sf_dir), 10_000, "original_rank").select("doc_id", "original_rank", "running_chars")


_HITS = "SELECT conv_id, turn, row_number() OVER (ORDER BY length(text) DESC, conv_id, turn) AS hit_rank FROM conversations ORDER BY hit_rank LIMIT 50"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty longest turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("score"))
    top = turns.orderBy(F.desc("score"), "conv_id", "turn").limit(50)
    from pyspark.sql import Window

    return top.withColumn("hit_rank", F.row_number().over(Window.orderBy(F.desc("score"), "conv_id", "turn"))).drop("score")


@query(
    f"""WITH hits AS ({_HITS}) SELECT h.hit_rank, h.conv_id, h.turn AS hit_position, string_agg(c.text, chr(10) || chr(10) ORDER BY c.turn) AS context
    FROM hits h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1 GROUP BY 1, 2, 3"""
)
def neighbor_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = retrieval.neighbours(_hits(spark, sf_dir), table(spark, sf_dir, "conversations"), "conv_id", "turn")
    texts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return around.groupBy("hit_rank", "conv_id", "hit_position").agg(F.array_join(F.transform(texts, lambda t: t["text"]), "\n\n").alias("context"))


@query(
    f"""WITH hits AS ({_HITS}), n AS (SELECT h.hit_rank, c.conv_id, c.turn FROM hits h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1)
    SELECT conv_id, turn, min(hit_rank) AS hit_rank FROM n GROUP BY 1, 2"""
)
def window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    around = retrieval.neighbours(_hits(spark, sf_dir), table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")
    return retrieval.first_seen(around, ["conv_id", "turn"], "hit_rank", "turn").select("conv_id", "turn", F.col("hit_rank").cast("long").alias("hit_rank"))


_PARENTS = """parents AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY 1),
sized AS (SELECT conv_id, content, floor(len(regexp_split_to_array(trim(content), '\\s+')) * 1.3)::INT AS approx_tokens FROM parents)"""


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations, of those hit alone."""
    texts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    hit = table(spark, sf_dir, "conversations").join(_hits(spark, sf_dir).select("conv_id").distinct(), "conv_id", "left_semi")
    parents = hit.groupBy("conv_id").agg(F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("content"))
    return parents.withColumn("approx_tokens", text_functions.approx_tokens(F.col("content")))


@query(
    f"""WITH hits AS ({_HITS}), {_PARENTS}, w AS (SELECT h.hit_rank, string_agg(c.text, chr(10) || chr(10) ORDER BY c.turn) AS context FROM hits h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1 GROUP BY 1)
    SELECT h.hit_rank, h.conv_id, CASE WHEN approx_tokens <= 600 THEN 'section' ELSE 'window' END AS mode, CASE WHEN approx_tokens <= 600 THEN content ELSE context END AS context
    FROM hits h JOIN sized USING (conv_id) JOIN w USING (hit_rank)"""
)
def parent_or_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.parent_or_window(neighbor_window(spark, sf_dir), _parents(spark, sf_dir), "conv_id", 600)
    return found.select("hit_rank", "conv_id", "mode", "context")


@query(f"WITH hits AS ({_HITS}) SELECT conv_id, min(hit_rank)::BIGINT AS hit_rank FROM hits GROUP BY 1")
def parent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.first_seen(_hits(spark, sf_dir), ["conv_id"], "hit_rank").select("conv_id", F.col("hit_rank").cast("long").alias("hit_rank"))


_MANY = """
asked AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS token FROM benchmark),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents), dl AS (SELECT doc_id, coalesce(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')), 0) AS dl FROM documents),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), tf AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN tf USING (token) JOIN df USING (token) JOIN dl USING (doc_id), stats GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@query(f"WITH {_MANY} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5")
def bm25_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items as questions at once: the five best documents of each."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return table_index(spark, sf_dir).bm25_many(asked)


@query(f"WITH {_MANY} SELECT doc_id, min(query_id) AS query_id, arg_min(rank, query_id) AS rank FROM r WHERE rank <= 5 AND query_id < 12 GROUP BY 1")
def fan_out_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dozen sub-queries of one question, the five best of each, where a document counts for the first that finds it."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.fan_out(table_index(spark, sf_dir), asked, most=12).select("doc_id", "query_id", "rank")


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND source = 'src3'")
def filter_dict_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = filters.given_only(lang=["de", "fr"], source="src3", n_chars=0)
    return filters.where(table(spark, sf_dir, "documents"), given).select("doc_id", "lang", "source")
