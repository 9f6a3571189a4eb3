"""Line de-duplication by ranges of line hashes and per-document keep bitmaps; DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

_BLANK = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    """Lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, partitions: int | None = None) -> DataFrame:
    """Bitmaps of the lines that go: (doc_id, text_hash, dropped).

    A line's key (see ``line_key``) of at least ``min_chars`` code points that
    occurs in ``min_docs`` rows or more goes everywhere, or everywhere but at
    its first place in order of id, text hash and position if ``keep_first``.

    ``dropped`` is compressed: an ordered array of (word, bits), bit i of word w
    for line 64 w + i; words without a dropped line are left out, and so are
    documents without one. Rows alike in id and text share a bitmap, but count
    as documents each; a line that a row repeats counts once for it. Null texts
    have one empty line; null ids are a value as any other. Columns of any name besides are ignored; an empty table has no bitmaps.

    Hashes (96 bits) are dealt out by ranges of (hash, document), so one line
    that stands in a third of all documents spreads over as many tasks as its share; counts are
    summed in each range before they meet.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), split_lines(F.col(text_col)).alias("lines"))
    each = rows.select("doc_id", "text_hash", F.posexplode("lines").alias("pos", "line")).select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    each = each.where(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "doc_id", "text_hash", "pos")
    each = scratch.keep(each, "lines")

    by = ["h1", "h2", "doc_id", "text_hash"]
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = each.repartitionByRange(parts, *by).sortWithinPartitions(*by, "pos")
    at = Window.partitionBy(*by).orderBy("pos")
    # Rows alike in id and text meet at the same places; the number at the first place is theirs.
    copies = F.count(F.lit(1)).over(Window.partitionBy(*by, "pos"))
    firsts = dealt.withColumn("copies", copies).withColumn("nth", F.row_number().over(at)).where("nth = 1")
    common = firsts.groupBy("h1", "h2").agg(F.sum("copies").alias("docs"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("first"))
    # Written, so that both sides of the join are plain shuffles, of which Spark parts a partition that one line fills.
    common = scratch.keep(common.where(F.col("docs") >= min_docs).select("h1", "h2", "first"), "common")

    gone = each.join(common, ["h1", "h2"])
    if keep_first:
        gone = gone.where(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("first")))
    words = gone.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def _dense(sparse: Column) -> Column:
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(sparse[i - 1]["word"] + 1)
    return F.flatten(F.transform(sparse, lambda e, i: F.concat(F.array_repeat(F.lit(0).cast("long"), e["word"] - before(i)), F.array(e["bits"]))))


def _marked(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, dropped): all columns of ``docs`` as one, so that no name can clash."""
    own = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"))
    packed = bitmaps.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), F.col("dropped").alias("sparse"))
    met = own.join(packed, own.doc_id.eqNullSafe(packed["of"]) & (own.text_hash == packed.of_hash), "left")
    return met.select("row", _dense(F.col("sparse")).alias("dropped"))


def with_dropped(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``dropped`` (replaced if there) as a dense array of 64-bit words; null: nothing goes."""
    return _marked(docs, bitmaps, id_col, text_col).select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "dropped"), "dropped")


def kept_text(text: Column, dropped: Column) -> Column:
    """The lines that stay, joined by a line feed."""
    stays = F.filter(split_lines(text), lambda line, i: F.getbit(F.coalesce(F.try_element_at(dropped, (F.floor(i / 64) + 1).cast("int")), F.lit(0).cast("long")), i % 64) == 0)
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(stays, "\n"))


def n_dropped(dropped: Column) -> Column:
    return F.coalesce(F.aggregate(dropped, F.lit(0).cast("long"), lambda a, w: a + F.bit_count(w)), F.lit(0).cast("long"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with the lines that stay as the text; other columns, whatever their names, as they are.

    Null texts come out empty. Repeated rows each stay a row. An empty table gives an empty result.
    """
    marked = _marked(docs, line_bitmaps(docs, id_col, text_col, min_docs, min_chars, keep_first), id_col, text_col)
    kept = kept_text(F.col("row").getField(text_col), F.col("dropped"))
    return marked.select(*((kept if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))
