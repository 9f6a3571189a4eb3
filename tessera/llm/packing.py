"""Best-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.scratch import Scratch
from tessera.llm.tokens import byte_letters

#: Words whose ids a task remembers.
REMEMBERED = 400_000
#: Pieces of one length that one ranking task takes, about.
RANKED = 200_000


class _Ids(dict):
    """Word, with the prefix put before it -> its ids as bytes; None where a word's ids depend on its neighbours."""

    def __init__(self, encode, prefix: str):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes | None:
        if len(self) >= REMEMBERED:
            self.clear()
        alone = word and not word[0].isspace() and not word[-1].isspace()
        self[word] = found = array("I", self.encode(self.prefix + word)).tobytes() if alone else None
        return found


class _Encoder:
    """Byte-level BPE with a cache by word.

    Such tokenizers start a new token at a space before a word, so the ids of a
    text are those of its words, if single spaces alone part them from each
    other; any other text is encoded whole. Where ids rise in the order of the merges, they
    are ranks, and the faster library that merges by rank gives a word's ids;
    words with a special token's first letters go to the tokenizer.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = [t["content"] for t in model.get("added_tokens", [])]
        vocabulary, merges = model["model"]["vocab"], model["model"]["merges"]
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        word = self._whole
        if merged == sorted(merged):
            letters = byte_letters()
            ranks = {bytes(letters[c] for c in piece): n for piece, n in vocabulary.items() if piece not in special}
            by_rank = tiktoken.Encoding("by_rank", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            marks = tuple({s[:2] for s in special})
            word = lambda text: self._whole(text) if any(m in text for m in marks) else by_rank(text)
        self.first, self.rest = _Ids(word, ""), _Ids(word, " ")

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        words = text.split(" ")
        try:
            return self.first[words[0]] + b"".join(map(self.rest.__getitem__, words[1:]))
        except TypeError:
            return array("I", self._whole(text)).tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's token ids and ``end_id``.

    Documents of up to ``capacity`` ids are one piece; longer ones are cut into
    pieces of ``capacity``, of which the first may be shorter. Null and empty
    texts are one piece of ``end_id`` alone. ``tokenizer_path`` is a tokenizer
    file that the executors have too.
    """
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _Encoder(tokenizer_path)
        for batch in batches:
            of, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                found = (encode(text.as_py() or "") if text.is_valid else b"") + end
                n = len(found) // 4
                head = n % capacity or capacity
                for k, at in enumerate([0, *range(head, n, capacity)]):
                    part = found[4 * at : 4 * (at + (head if k == 0 else capacity))]
                    of.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Piece lengths with their numbers -> (lengths in a bin, number of such bins).

    A bin is filled greedily, each time with the longest piece that fits. Then,
    while it has a gap, its smallest piece goes back if two unpacked pieces fit
    the widened gap more tightly. As many equal bins are made as the numbers
    allow, so the work depends on the number of lengths, not of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    have = sum(1 << n for n in left)
    bins: list[tuple[tuple[int, ...], int]] = []
    while have:
        used: dict[int, int] = {}
        gap, open_ = capacity, have

        def take(n: int) -> None:
            nonlocal open_
            used[n] = used.get(n, 0) + 1
            if used[n] == left[n]:
                open_ &= ~(1 << n)

        def give(n: int) -> None:
            nonlocal open_
            used[n] -= 1
            if not used[n]:
                del used[n]
            open_ |= 1 << n

        while fits := open_ & ((1 << (gap + 1)) - 1):
            n = fits.bit_length() - 1
            take(n)
            gap -= n
        while gap and len(used):
            small = min(used)
            give(small)
            room, best = gap + small, (small, 0, 0)
            firsts = open_ & ((1 << room) - 1)
            while firsts and best[0] < room:
                a = firsts.bit_length() - 1
                firsts &= ~(1 << a)
                if 2 * a < best[0]:
                    break
                seconds = open_ & ((1 << (min(room - a, a) + 1)) - 1)
                if seconds and left[a] - used.get(a, 0) < 2:
                    seconds &= ~(1 << a)
                if seconds and a + (b := seconds.bit_length() - 1) > best[0]:
                    best = (a + b, a, b)
            if not best[1]:
                take(small)
                break
            take(best[1])
            take(best[2])
            gap = room - best[0]
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                have &= ~(1 << n)
        bins.append((tuple(sorted((n for n, k in used.items() for _ in range(k)), reverse=True)), times))
    return bins


def pack(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """The table of pieces with ``sequence_id`` and ``offset``: sequences hold at most ``capacity`` ids without gaps.

    Only the number of pieces of each length (``capacity`` numbers at most)
    comes to the driver, where best-two-fit plans kinds of sequences. Pieces
    are numbered as they are written, ranked within their length, in buckets by that number, so that
    rows alike are dealt out, too, and ranks pick their places
    in the plan. Pieces must be of length 1 to ``capacity``. An empty table gives an empty result.
    """
    spark = cut.sparkSession
    cut = Scratch(spark, "packing").keep(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("a piece doesn't fit")
    starts: dict[int, list[tuple[int, int, int]]] = {n: [] for n in counts}
    ranked = dict.fromkeys(counts, 0)
    base = 0
    for lengths, times in best_two_fit(counts, capacity):
        at = 0
        for n in lengths:
            starts[n].append((ranked[n], base, at))
            ranked[n] += times
            at += n
        base += times
    flat = [(n, *x) for n, found in sorted(starts.items()) for x in found]
    step = 1 << 44
    plan = spark.sparkContext.broadcast((np.array([n * step + r for n, r, _, _ in flat], np.int64), np.array([r for _, r, _, _ in flat], np.int64), np.array([b for _, _, b, _ in flat], np.int64), np.array([o for _, _, _, o in flat], np.int64)))

    buckets = 1 + max(counts.values(), default=0) // RANKED
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_row")) - 1
    ranks = dealt.withColumn("_nth", nth).join(sizes, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_nth")).drop("_row", "_bucket", "_nth", "_before")

    schema = T.StructType([f for f in ranks.schema.fields if f.name != "_rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, seq, offset = plan.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            slot = np.searchsorted(keys, length * step + rank, "right") - 1
            kept = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "_rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq[slot] + rank - first[slot]), pa.array(offset[slot])], schema.names)

    return ranks.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs: one row per piece with its place. Rows of ``docs`` alike are documents each; other columns are ignored."""
    return pack(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts) of packed pieces with ``ids``: the training rows, each no longer than the capacity. Null ids of documents stay null; columns of any name besides are dropped; no pieces make no rows."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))
