"""Removal of repeated byte strings by suffix order.

A string that stands twice has the same anchor at both places (see
``anchors``), so only texts that share an anchor are brought together: the
strings around each anchor, of which equal ones are sent once by a task, meet
in groups by anchor. Whole groups fill blocks of bounded size, and each block's suffixes are
put in order by two-stage sorting: those smaller than their successors are
sorted directly, the rest are induced by scanning the buckets. Then the lengths of the prefixes that
neighbours have in common are computed, and those of the full length are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.anchors import GRAM, Anchors
from tessera.llm.scratch import Scratch

#: An anchor found more often is not sorted as one group; its strings are parted by more of their content.
HOT = 1 << 12
#: A hot anchor's strings are parted by where the anchor stands in them, in ranges of these widths one after the other.
WIDTHS = (64, 16, 4, 1)
#: Bytes of segments that are sorted together, about.
BLOCK = 1 << 20
#: Segments that a task remembers having sent.
SENT = 500_000


def sorted_starts(text: bytes, wanted: np.ndarray, depth: int) -> list[int]:
    """The wanted places of ``text`` (flags; ascending) in order of what follows, told apart by ``depth`` bytes at least.

    Places smaller than their successor are sorted directly. The others, larger
    than their successors, are induced: in a scan of the buckets of first bytes
    in order, each place hands the one before it to the front part of its bucket.
    """
    n = len(text)
    data = np.frombuffer(text, np.uint8)
    larger = np.ones(n, bool)
    differs = np.flatnonzero(data[1:] != data[:-1])
    if len(differs):
        rises = data[differs] < data[differs + 1]
        at = np.searchsorted(differs, np.arange(n - 1))
        inside = at < len(differs)
        larger[: n - 1][inside] = ~rises[at[inside]]
    # A larger place needs its successor, up to the next smaller one.
    need = wanted.copy()
    smaller_next = np.searchsorted(np.flatnonzero(~larger), np.arange(n))
    smaller = np.flatnonzero(~larger)
    ends = np.flatnonzero(need & larger & np.append(~need[1:], True))
    for i in ends.tolist():
        k = smaller_next[i]
        need[i : (int(smaller[k]) + 1 if k < len(smaller) else n)] = True
    chosen = np.flatnonzero(need & ~larger)
    chosen = chosen[np.argsort(data[chosen], kind="stable")]
    direct: list[int] = []
    for part in np.split(chosen, np.flatnonzero(np.diff(data[chosen])) + 1):  # keys of one first byte at a time
        direct += sorted(part.tolist(), key=lambda i: text[i : i + depth])
    induce = (need & larger).tobytes()
    front: list[list[int]] = [[] for _ in range(256)]
    if induce[-1]:
        front[text[-1]].append(n - 1)
    order: list[int] = []
    done = 0
    for c in range(256):
        bucket = front[c]
        for p in bucket:
            if p and induce[p - 1]:
                front[text[p - 1]].append(p - 1)
        order += bucket
        end = done
        while end < len(direct) and text[direct[end]] == c:
            p = direct[end]
            if p and induce[p - 1]:
                front[text[p - 1]].append(p - 1)
            end += 1
        order += direct[done:end]
        done = end
    keep = wanted.tobytes()
    return [p for p in order if keep[p]]


def common_prefixes(text: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """For each place but the first in ``order``, the length of what it has in common with the place before it, ``most`` at most; all of them stand that far from the end."""
    padded = np.frombuffer(text + bytes(8), np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(max(len(order) - 1, 0), np.int64)
    left, right, alive = order[:-1], order[1:], np.arange(len(out))
    for at in range(0, most, 8):
        a, b = (np.ascontiguousarray(words[p + at]).view(np.uint64).ravel() for p in (left[alive], right[alive]))
        differ = a ^ b
        low = differ & (~differ + np.uint64(1))  # the lowest bit that differs, in the first byte that does
        out[alive] += np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3)
        alive = alive[differ == 0]
        if not len(alive):
            break
    return np.minimum(out, most)


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each of several different segments, flags of the starts whose ``length`` bytes stand in another segment, too: those with so long a prefix in common with a neighbour in order."""
    text = b"".join(segments)
    starts = np.cumsum([0, *map(len, segments)])
    wanted = np.zeros(len(text), bool)
    for a, b in zip(starts, starts[1:], strict=False):
        wanted[a : b - length + 1] = True
    order = np.array(sorted_starts(text, wanted, length), np.int64)
    whole = common_prefixes(text, order, length) >= length
    found = np.zeros(len(text), bool)
    found[order[1:][whole]] = found[order[:-1][whole]] = True
    return [found[a : b - length + 1] for a, b in zip(starts, starts[1:], strict=False)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _numbered(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(uid, doc_id, data): ids serve as row numbers if they are whole numbers without a repeat or null; else rows are numbered in a written table."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("data"))
    if isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType)):
        if not base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count():
            return base.select(F.col("doc_id").cast("long").alias("uid"), "doc_id", "data")
    return scratch.keep(base.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "data"), "numbered")


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in batches:
            uids = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(uids), 256):
                hs, of, packs = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for uid, data in zip(uids[at : at + 256], batch.column(1)[at : at + 256], strict=True):
                    h, first, last, place = anchors.marks(data.as_py())
                    hs.append(h)
                    of.append(np.full(len(h), uid))
                    packs.append((first << 16) + ((last - first) << 8) + place)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, of, packs)], ["h", "uid", "pack"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(x.as_py()) for x in batch.column(1)], pa.binary())], ["uid", "z"])


_SEGMENT = "h long, seg long, uid long, lo long, hi long, place long, data binary, hot boolean"


def _segments(length: int):
    """Rows (uid, z, hits) -> one row per hit with its segment's hash, first and last start, its anchor's place, and its bytes where this task didn't send them yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, sent = zstandard.ZstdDecompressor(), set()
        schema = pa.schema([("h", pa.int64()), ("seg", pa.int64()), ("uid", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("place", pa.int64()), ("data", pa.binary()), ("hot", pa.bool_())])
        for batch in batches:
            for uid, z, hits in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("uid", "z", "hits")), strict=True):
                text, uid, rows = unpack.decompress(z.as_py()), uid.as_py(), []
                for hit in hits.as_py():
                    lo, more, place = hit["pack"] >> 16, hit["pack"] >> 8 & 255, hit["pack"] & 255
                    data = text[lo : lo + more + length]
                    seg = xxhash.xxh3_64_intdigest(data) - (1 << 63)
                    key = (hit["h"], seg)
                    if new := key not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(key)
                    rows.append((hit["h"], seg, uid, lo, lo + more, lo + place, data if new else None, hit["hot"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _sort_blocks(length: int):
    """Rows in order of h -> (uid, lo, hi) of starts that are repeated."""

    def block(rows: dict[tuple[int, int], list]) -> pa.RecordBatch:
        by_h: dict[int, list] = {}
        for (h, _), found in rows.items():
            by_h.setdefault(h, []).append(found)
        mixed = [found for group in by_h.values() if len(group) > 1 for found in group]
        flags = repeated_starts([found[0] for found in mixed], length) if mixed else []
        out: list[tuple[int, int, int]] = []
        for found, flag in zip(mixed, flags, strict=True):
            spans = [(0, len(found[0]) - length)] if len(found[1]) > 1 else _runs(flag)
            out += ((uid, lo + a, lo + b) for uid, lo in found[1] for a, b in spans)
        for group in by_h.values():
            if len(group) == 1 and len(group[0][1]) > 1:
                out += ((uid, lo, lo + len(group[0][0]) - length) for uid, lo in group[0][1])
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["uid", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[int, int], list] = {}
        size, last = 0, None
        for batch in batches:
            hs, segs, uids, los = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("h", "seg", "uid", "lo"))
            for h, seg, uid, lo, data in zip(hs, segs, uids, los, batch.column(batch.schema.get_field_index("data")), strict=True):
                if h != last and size >= BLOCK:
                    yield block(rows)
                    rows, size = {}, 0
                last = h
                found = rows.setdefault((h, seg), [None, []])
                found[1].append((uid, lo))
                if found[0] is None and data.is_valid:
                    found[0] = data.as_py()
                    size += len(found[0])
                size += 16
        if rows:
            yield block(rows)

    return run


_PART = "key long, seg long, uid long, lo long, hi long, place long, data binary"


def _parted(length: int, width: int):
    """Rows (uid, lo, hi, place, data) -> one row per range of ``width`` places of the anchor in a string.

    ``data`` has the strings that start from ``lo`` to ``hi``, whose anchor stands at
    ``place``. All strings of one range have some bytes around the anchor in common;
    ``key`` is the hash of these, so strings that are alike meet under one key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("key", "seg", "uid", "lo", "hi", "place")] + [("data", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                out = []
                for uid, lo, hi, place, data in zip(*(batch.slice(at, 1024).column(batch.schema.get_field_index(c)).to_pylist() for c in ("uid", "lo", "hi", "place", "data")), strict=True):
                    for cell in range((place - hi) // width, (place - lo) // width + 1):
                        latest, earliest = place - cell * width, place - min(cell * width + width - 1, length - GRAM)
                        a, b = max(lo, earliest), min(hi, latest)
                        part = data[a - lo : b - lo + length]
                        key = xxhash.xxh3_64_intdigest(data[latest - lo : earliest - lo + length], cell) - (1 << 63)
                        out.append((key, xxhash.xxh3_64_intdigest(part) - (1 << 63), uid, a, b, place, part))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _hot(segments: DataFrame, length: int, scratch: Scratch) -> DataFrame | None:
    """(uid, lo, hi) for anchors that are found very often; None if there are none.

    A segment that its task had sent before is repeated, whole; so is the first one of a
    task if others have it, too. Each segment that stands in one place alone is compared with
    the other different ones: their strings are parted, by the place of the anchor in them, into
    ranges, and the bytes that all strings of a range share are the key under
    which they meet. Groups of up to HOT are sorted; larger ones are parted again into narrower ranges, which share
    more bytes, until a range is one string, whose key alone tells which are alike. So
    a segment makes a few rows a level, and only where its group stays large.
    """
    single = F.col("n") == 1
    known = segments.groupBy("h", "seg").agg(F.count(F.lit(1)).alias("n"), F.max("data").alias("data"), *(F.max(c).alias(c) for c in ("uid", "lo", "hi", "place")))
    # Where a segment stands in several places, its bytes alone count: any one of these places gives their lengths.
    known = scratch.keep(known.select("h", "seg", "n", F.when(single, F.col("uid")).alias("uid"), *(F.when(single, F.col(c)).otherwise(v).alias(c) for c, v in (("lo", F.lit(0)), ("hi", F.length("data") - length), ("place", F.col("place") - F.col("lo")))), "data"), "hot-known")
    if not known.limit(1).count():
        return None
    spans = ["uid", "lo", "hi"]
    others = known.where("n > 1").select("h", "seg")
    found = segments.where("data is null").select(*spans).unionByName(segments.where("data is not null").join(others, ["h", "seg"], "left_semi").select(*spans))
    rest = known
    for k, width in enumerate(WIDTHS):
        parts = scratch.keep(rest.select("uid", "lo", "hi", "place", "data").mapInArrow(_parted(length, width), _PART), f"hot-parts-{k}")
        sizes = scratch.keep(parts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"hot-sizes-{k}")
        if width == 1:
            return found.unionByName(parts.where("uid is not null").join(sizes.select("key"), "key", "left_semi").select(*spans))
        few = parts.join(sizes.where(F.col("n") <= HOT).select("key"), "key", "left_semi").select(F.col("key").alias("h"), "seg", "uid", "lo", "data")
        sorted_ = few.repartition("h").sortWithinPartitions("h").mapInArrow(_sort_blocks(length), "uid long, lo long, hi long")
        found = found.unionByName(sorted_.where("uid is not null"))
        rest = scratch.keep(parts.join(sizes.where(F.col("n") > HOT).select("key"), "key", "left_semi"), f"hot-rest-{k}")
        if not rest.limit(1).count():
            return found


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for uid, z, spans in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("uid", "z", "spans")), strict=True):
                text = unpack.decompress(z.as_py())
                merged: list[list[int]] = []
                for s in sorted((s["lo"], s["hi"] + length) for s in spans.as_py()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                cuts = [0, *(x for span in merged for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                out.append((uid.as_py(), merged, kept))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in r[1]] for r in out], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array([r[2] for r in out], pa.binary())], ["uid", "removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, with_kept: bool = True) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed, kept).

    Texts are UTF-8 bytes; each byte covered by a string of ``length`` bytes
    that also starts anywhere else goes. ``removed`` has the spans (start,
    stop), null where the whole text stands elsewhere, too; ``kept`` the bytes that stay, null where
    nothing goes. Null texts count as empty. Rows alike are documents each, so
    both go; ids may be null, repeated or of any type. Other columns are ignored.
    An empty table gives an empty result.
    """
    if not 0 < length - 32 < 256:
        raise ValueError("length must be from 33 to 287")
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = _numbered(docs, id_col, text_col, scratch)
    known = scratch.keep(rows.select("uid", "doc_id", F.sha2("data", 256).alias("sha"), F.octet_length("data").cast("long").alias("n_bytes")), "known")
    copies = known.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("uid").alias("first"))
    shared = copies.where("copies > 1")
    more = known.join(shared, "sha").where("uid <> first").select("uid")

    marks = rows.where(F.octet_length("data") >= length).select("uid", "data").mapInArrow(_anchor_rows(length), "h long, uid long, pack long")
    often = marks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", (F.col("n") > HOT).alias("hot"))
    # Written, so that both sides of the join are plain shuffles, of which Spark parts a partition that one anchor fills.
    often = scratch.keep(often, "often")
    hits = marks.join(often, "h").join(more, "uid", "left_anti").groupBy("uid").agg(F.collect_list(F.struct("h", "pack", "hot")).alias("hits"))
    packed = rows.where(F.octet_length("data") >= length).select("uid", "data").mapInArrow(_packed, "uid long, z binary")
    segments = packed.join(hits, "uid").select("uid", "z", "hits").mapInArrow(_segments(length), _SEGMENT)
    segments = scratch.keep(segments, "segments")
    cold = segments.where("not hot").drop("hot").repartition("h").sortWithinPartitions("h").mapInArrow(_sort_blocks(length), "uid long, lo long, hi long")
    hot = _hot(segments.where("hot").drop("hot"), length, scratch)
    spans = (cold if hot is None else cold.unionByName(hot)).groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    cut = packed.join(spans, "uid").select("uid", "z", "spans").mapInArrow(_cut(length), "uid long, removed array<struct<start:long,stop:long>>, kept binary")
    cut = cut.select("uid", "removed", F.sha2("kept", 256).alias("kept_sha256"), F.length("kept").cast("long").alias("n_kept"), *(["kept"] if with_kept else []))

    twice = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    each = known.join(shared.select("sha", "copies"), "sha", "left").join(cut, "uid", "left")
    return each.select(
        "doc_id",
        "n_bytes",
        F.when(twice, F.col("n_bytes")).otherwise(F.col("n_bytes") - F.coalesce("n_kept", "n_bytes")).alias("n_removed"),
        F.when(twice, F.lit(1)).otherwise(F.coalesce(F.size("removed"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(twice, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(~F.coalesce(twice, F.lit(False)), F.col("removed")).alias("removed"),
        *([F.when(twice, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept")] if with_kept else []),
    )
