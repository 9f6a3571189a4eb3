"""Chat formatting: collapse of cumulative snapshots, then rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

#: Turns of a block, within which prefix hashes run; blocks are summed before.
BLOCK = 256
#: Turn numbers of a part, and turns that one rendered row holds at most.
SEGMENT = 64
_SUMS = ["s0", "s1", "s2", "s3"]
_DIGEST = ["n", *_SUMS]


def _halves(*seed_and_columns: Column) -> list[Column]:
    h = F.xxhash64(*seed_and_columns)
    return [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, n, s0..s3): number and hash sums of a conversation's rows up to each of its turns.

    A sum of 128 bits of position-dependent hashes doesn't depend on the order
    of adding, so a conversation of any length is summed in blocks of BLOCK turns.
    """
    mark = [F.col("turn"), F.isnull("role"), F.col("role"), F.isnull("text"), F.col("text")]
    parts = [*_halves(*mark), *_halves(F.lit(7), *mark[::-1])]
    each = turns.select("conv_id", "turn", F.floor(F.col("turn") / BLOCK).alias("block"), F.lit(1).cast("long").alias("n"), *(p.alias(s) for p, s in zip(parts, _SUMS, strict=True)))
    each = each.distinct().groupBy("conv_id", "block", "turn").agg(*(F.sum(c).alias(c) for c in _DIGEST))
    run = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    inner = each.select("conv_id", "block", "turn", *(F.sum(c).over(run).alias(c) for c in _DIGEST))
    blocks = each.groupBy("conv_id", "block").agg(*(F.sum(c).alias(c) for c in _DIGEST))
    done = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(F.col("conv_id").alias("_of"), F.col("block").alias("_block"), *(F.sum(c).over(done).alias(f"_{c}") for c in _DIGEST)).where("_n is not null")
    met = inner.join(before, inner.conv_id.eqNullSafe(before["_of"]) & inner.block.eqNullSafe(before["_block"]), "left")
    return met.select("conv_id", "turn", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in _DIGEST))


def maximal(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id): conversations that are no prefix of a longer one; of equal ones the smallest id."""
    heads = scratch.keep(prefixes(turns), "prefixes")
    size = heads.groupBy("conv_id").agg(F.max("n").alias("size"))
    sized = heads.join(size.withColumnRenamed("conv_id", "_of"), F.col("conv_id").eqNullSafe(F.col("_of")))
    proper = sized.where("n < size").select(*_DIGEST).distinct()
    whole = sized.where("n = size").select("conv_id", *_DIGEST)
    first = F.min(F.struct(F.isnull("conv_id").alias("none"), F.col("conv_id")))
    return whole.join(proper, _DIGEST, "left_anti").groupBy(*_DIGEST).agg(first.alias("first")).select("first.conv_id")


def _shielded(text: Column) -> Column:
    """The text with a backslash more in each ``<|`` (or ``<\\|``, ...), so that it has no markup of its own."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _line(turn: Column) -> Column:
    role = F.replace(F.replace(F.coalesce(turn["role"], F.lit("unknown")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit("<|im_start|>"), _shielded(role), F.lit("\n"), _shielded(F.coalesce(turn["text"], F.lit(""))), F.lit("<|im_end|>\n"))


def _rows(turns: DataFrame) -> DataFrame:
    """(conv_id, part, piece, t) in groups of SEGMENT turns at most -> rendered rows."""
    out = turns.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    return out.select("conv_id", "part", "piece", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", _line), "").alias("text"))


def _crowded(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, part, t) of parts with more than SEGMENT different turns -> the same with ``piece``: every SEGMENT turns, in order, one more.

    Turns are dealt out by ranges of their order and numbered there, so that neither a
    conversation nor a part of one must fit in a task.
    """
    order = ["conv_id", "part", "t"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.distinct().repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = scratch.keep(dealt.select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")), "dealt")
    spans = dealt.groupBy("conv_id", "part", "task").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id", "part").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    spans = scratch.keep(spans.select(F.col("conv_id").alias("_of"), F.col("part").alias("_part"), F.col("task").alias("_task"), "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("done")), "spans")
    met = dealt.join(spans, dealt.conv_id.eqNullSafe(F.col("_of")) & dealt.part.eqNullSafe(F.col("_part")) & (dealt.task == F.col("_task")))
    return met.select(*order, F.floor((F.col("done") + F.col("at") - F.col("low")) / SEGMENT).alias("piece"))


def format_chats(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, piece, n_turns, text): maximal conversations as chat markup.

    Systems log a conversation again after each turn; a log whose turns all
    stand, alike, at the start of a longer one goes, and so do all but the
    smallest id of equal ones. Rows alike in all four columns count once, and only
    their hashes are shuffled to find what is maximal; texts move once, but for crowded parts. Turns are ordered by
    (turn, role, text), nulls first; a null role is ``unknown``, a null text is
    empty, rows without a conversation id are one conversation.

    A part has the turns of SEGMENT numbers (part 0: turns 0 to SEGMENT - 1; null: turns without a number), and
    of each part every SEGMENT turns, in order, are a piece; where numbers do not recur, a part is
    one piece. So no conversation, and no part of one, must fit in one row. A conversation's
    texts, joined in order of part (nulls first) and piece, are its whole rendering. Markup within texts and roles is
    shielded by a backslash, so that no text can pose as a turn, and ``read_chats`` gives the turns back.
    An empty table gives an empty result; other columns are ignored.
    """
    turns = convs.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    scratch = Scratch(convs.sparkSession, "chat")
    part = F.floor(F.col("turn") / SEGMENT)
    many = turns.select("conv_id", part.alias("part"), "turn", F.xxhash64(F.isnull("role"), "role", F.isnull("text"), "text").alias("h")).distinct()
    many = scratch.keep(many.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SEGMENT).select(F.col("conv_id").alias("_of"), F.col("part").alias("_part")), "crowded")
    kept = maximal(turns, scratch).withColumnRenamed("conv_id", "_of")
    stay = turns.join(kept, turns.conv_id.eqNullSafe(kept["_of"]), "left_semi")
    stay = stay.select("conv_id", part.alias("part"), F.lit(0).cast("long").alias("piece"), F.struct("turn", "role", "text").alias("t"))
    if not many.limit(1).count():
        return _rows(stay)
    in_many = stay.conv_id.eqNullSafe(many["_of"]) & stay.part.eqNullSafe(many["_part"])
    crowded = _crowded(stay.join(many, in_many, "left_semi").select("conv_id", "part", "t"), scratch)
    return _rows(stay.join(many, in_many, "left_anti")).unionByName(_rows(crowded))


def read_chats(rendered: DataFrame) -> DataFrame:
    """Rows of ``format_chats`` -> (conv_id, part, piece, position, role, text): the turns again; a null role is ``unknown``, a null text empty. A null text of ``rendered`` has no turns; repeated rows each give theirs; other columns are dropped; an empty table gives an empty result."""
    turns = F.filter(F.split("text", r"<\|im_start\|>"), lambda t: t != "")
    each = rendered.select("conv_id", "part", "piece", F.posexplode(turns).alias("position", "turn"))
    head, body = F.substring_index("turn", "\n", 1), F.regexp_extract("turn", r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)
    # Backslashes in a role are doubled, so an odd one before an n is a line feed.
    role = F.array_join(F.transform(F.split(_bare(head), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")
    return each.select("conv_id", "part", "piece", "position", role.alias("role"), _bare(body).alias("text"))
