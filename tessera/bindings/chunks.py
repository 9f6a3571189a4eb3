"""Chunking and linking over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import text as text_functions
from tessera.operators import chunking

_SENTENCES = "string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; dealt out only where the files have fewer parts than there are cores, as a small table of one row group has."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


@query(f"SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, list_filter({_SENTENCES}, lambda x: length(x) > 0) AS s FROM documents)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", "sentence", F.col("pos").cast("long").alias("pos"))


#: Paragraphs of over 100 words in sentences that are packed; then all are packed, where a packed one is a chunk of its own.
_UNITS = f"""p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0) AS ps FROM documents),
e AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS text FROM p), w AS (SELECT *, len(regexp_split_to_array(text, '\\s+')) AS n FROM e),
long AS (SELECT doc_id, i, list_filter({_SENTENCES}, lambda x: length(x) > 0) AS ss FROM w WHERE n > 100),
sent AS (SELECT *, len(regexp_split_to_array(trim(t), '\\s+')) AS n FROM (SELECT doc_id, i, generate_subscripts(ss, 1) AS j, unnest(ss) AS t FROM long)),
packed AS (SELECT doc_id, i, j, n AS size, 0 AS part FROM sent WHERE j = 1
  UNION ALL SELECT s.doc_id, s.i, s.j, CASE WHEN k.size + s.n > 100 THEN s.n ELSE k.size + s.n END, CASE WHEN k.size + s.n > 100 THEN k.part + 1 ELSE k.part END FROM packed k JOIN sent s ON s.doc_id = k.doc_id AND s.i = k.i AND s.j = k.j + 1),
units AS (SELECT doc_id, i, part, string_agg(t, ' ' ORDER BY j) AS t, sum(n) AS n, true AS alone FROM packed JOIN sent USING (doc_id, i, j) GROUP BY 1, 2, 3 UNION ALL SELECT doc_id, i, 0, text, n, false FROM w WHERE n <= 100),
u AS (SELECT doc_id, t, n, alone, row_number() OVER (PARTITION BY doc_id ORDER BY i, part) AS k FROM units)"""


@query(
    f"""WITH RECURSIVE {_UNITS}, g AS (SELECT doc_id, k, n AS size, alone, 0 AS chunk FROM u WHERE k = 1
    UNION ALL SELECT u.doc_id, u.k, CASE WHEN u.alone OR g.alone OR g.size + u.n > 100 THEN u.n ELSE g.size + u.n END, u.alone, CASE WHEN u.alone OR g.alone OR g.size + u.n > 100 THEN g.chunk + 1 ELSE g.chunk END FROM g JOIN u ON u.doc_id = g.doc_id AND u.k = g.k + 1)
    SELECT doc_id, chunk::BIGINT AS chunk_index, string_agg(t, chr(10) || chr(10) ORDER BY k) AS chunk FROM g JOIN u USING (doc_id, k) GROUP BY 1, 2"""
)
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = chunking.pack(chunking.paragraphs(F.col("text")), 100)
    return _parts(spark, sf_dir).select("doc_id", F.posexplode(packed).alias("chunk_index", "chunk")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(
    f"""WITH RECURSIVE {_UNITS}, d AS (SELECT doc_id, list(n::BIGINT ORDER BY k) AS ns, list(alone ORDER BY k) AS al, list(t ORDER BY k) AS ts, count(*) AS m FROM u GROUP BY 1),
    g AS (SELECT doc_id, 1::BIGINT AS k, 1::BIGINT AS st, 0 AS chunk FROM d UNION ALL SELECT doc_id, k + 1,
      CASE WHEN al[k + 1] OR al[k] THEN k + 1 WHEN list_sum(ns[st:k]) + ns[k + 1] > 100 THEN k + 1 - list_max(list_filter(range(0, k - st + 2), lambda j: coalesce(list_sum(ns[k - j + 1:k]), 0) <= 25)) ELSE st END,
      chunk + CASE WHEN al[k + 1] OR al[k] OR list_sum(ns[st:k]) + ns[k + 1] > 100 THEN 1 ELSE 0 END FROM g JOIN d USING (doc_id) WHERE k < m)
    SELECT doc_id, chunk::BIGINT AS chunk_index, array_to_string(any_value(ts)[min(st):max(k)], chr(10) || chr(10)) AS chunk FROM g JOIN d USING (doc_id) GROUP BY 1, 2"""
)
def pack_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk starts with as many of the last paragraphs as have 25 words together."""
    packed = chunking.pack(chunking.paragraphs(F.col("text")), 100, overlap=25)
    return _parts(spark, sf_dir).select("doc_id", F.posexplode(packed).alias("chunk_index", "chunk")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(
    """SELECT conv_id, turn, conv_id || '_' || turn AS chunk_id, row_number() OVER w - 1 AS position_in_section, count(*) OVER (PARTITION BY conv_id) AS total_chunks_in_section,
    row_number() OVER w = 1 AS is_section_start, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS is_section_end,
    lag(conv_id || '_' || turn) OVER w AS prev_chunk_id, lead(conv_id || '_' || turn) OVER w AS next_chunk_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("_", "conv_id", "turn").alias("chunk_id"))
    return chunking.link(turns, ["conv_id"], "turn", "chunk_id")


@query(
    """SELECT lang, count(*) AS chunks, max(length(text))::BIGINT AS longest, round(avg(length(text)), 4) AS mean_chars, sum(floor(length(text) / 4))::BIGINT AS char_tokens,
    sum(floor(CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text), '\\s+')) END * 1.3))::BIGINT AS word_tokens, count(*) FILTER (length(text) > 4000) AS too_long FROM documents GROUP BY 1"""
)
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.max(F.length(text)).cast("long").alias("longest"),
        F.round(F.avg(F.length(text)), 4).alias("mean_chars"),
        F.sum(text_functions.char_tokens(text)).alias("char_tokens"),
        F.sum(text_functions.approx_tokens(text)).alias("word_tokens"),
        F.count_if(F.length(text) > 4000).alias("too_long"),
    )


@query(
    """WITH s AS (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN 'a' ELSE 'q' END AS side FROM conversations),
    b AS (SELECT *, CASE WHEN side = lag(side) OVER w THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS block FROM b)
    SELECT conv_id, block, side, string_agg(text, chr(10) ORDER BY turn) AS text FROM g GROUP BY 1, 2, 3"""
)
def speaker_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns of one side."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("side", F.when(F.col("role") == "assistant", "a").otherwise("q"))
    new = F.when(F.col("side") == F.lag("side").over(by), 0).otherwise(1)
    blocks = turns.withColumn("new", new).withColumn("block", F.sum("new").over(by))
    texts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return blocks.groupBy("conv_id", "block", "side").agg(F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("text"))


@query(
    """WITH c AS (SELECT c_nationkey, c_custkey // 1000 AS block, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 1000 ORDER BY c_custkey) - 1 AS i FROM customer)
    SELECT c_nationkey, block, i // 25 AS part, (i // 25) > 0 AS is_continuation,
    '[TABLE: n' || c_nationkey || ']' || chr(10) || 'key name' || chr(10) || string_agg(c_custkey || ' x', chr(10) ORDER BY c_custkey) || chr(10) || '[/TABLE]' AS text FROM c GROUP BY 1, 2, 3, 4"""
)
def table_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 1000 customer numbers of a nation as one marked table, split at 55 words: 5 fixed ones and 25 rows of two."""
    rows = F.array_sort(F.collect_list(F.struct("c_custkey", F.concat(F.col("c_custkey"), F.lit(" x")).alias("row"))))
    body = F.array_join(F.transform(rows, lambda r: r["row"]), "\n")
    tables = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.expr("c_custkey div 1000").alias("block")).agg(body.alias("body"))
    text = F.concat(F.lit("[TABLE: n"), F.col("c_nationkey"), F.lit("]\nkey name\n"), F.col("body"), F.lit("\n" + chunking.TABLE_END))
    parts = tables.select("c_nationkey", "block", text.alias("text")).select("c_nationkey", "block", F.posexplode(chunking.split_table(F.col("text"), 55)).alias("part", "p"))
    return parts.select("c_nationkey", "block", F.col("part").cast("long").alias("part"), "p.is_continuation", "p.text")
