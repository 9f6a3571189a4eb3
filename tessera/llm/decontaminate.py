"""Benchmark decontamination: latent candidates, then longest common subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import latent
from tessera.llm.scratch import Scratch

#: Documents whose passages one task of the latent basis' fit sums, at least, about. The basis is fitted on all, all count for frequencies and all are searched.
FIT_DOCUMENTS = 3000
#: Benchmark items that go to the tasks at once.
ITEMS = 5000
#: Items of fewer words are found word for word alone; of longer ones, that many words lead to where they stand word for word.
SHORTEST = 5
#: Words whose vectors are summed at once.
_SPAN = 1 << 13
#: Windows whose words are counted at once.
_WINDOWS = 1 << 10


@dataclass(frozen=True)
class Limits:
    """What makes a leak."""

    #: Cosine from which a window is a candidate.
    near: float = 0.5
    #: Share of an item's words, in order, that a leak has; or a paraphrase, which has ``answer`` of the item's answer as well.
    leak: float = 0.8
    paraphrase: float = 0.5
    answer: float = 0.8


def common_length(masks: dict[bytes, int], words: list[bytes]) -> int:
    """Length of the longest common subsequence, for an item given as places of its words (bit i: place i)."""
    return _common(_places(masks, words))


def _places(masks: dict[bytes, int], words: list[bytes]) -> list[int]:
    """Places of those words that the item has; the others change no common subsequence."""
    return list(filter(None, map(masks.get, words)))


def _common(places: list[int]) -> int:
    row = 0
    for here in places:
        x = row | here
        row = x & ((x - ((row << 1) | 1)) ^ x)
    return row.bit_count()


def _masks(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, word in enumerate(words):
        out[word] = out.get(word, 0) | 1 << i
    return out


@dataclass
class _Scale:
    window: int
    vectors: np.ndarray
    items: list[tuple[object, int, dict[bytes, int], dict[bytes, int], int]]
    #: By item: its number of words, how far from a window's middle it is sought, and a bit for each feature of its words.
    sizes: np.ndarray
    reaches: np.ndarray
    bits: np.ndarray
    #: Items' features, as item x FEATURES + feature in order, and how often the item has them.
    kinds: np.ndarray
    counts: np.ndarray

    def may_have(self, found: np.ndarray, middles: np.ndarray, cols: np.ndarray, share: float) -> np.ndarray:
        """Whether that share of its item may stand, in order, around each middle: features that both have, as often as both have them, are no fewer than words in order."""
        out, need, wide = np.empty(len(cols), bool), share * self.sizes[cols], int(self.reaches.max())
        apart = np.abs(np.arange(-wide, wide) + 0.5).astype(np.float32)
        for at in range(0, len(cols), _WINDOWS):
            part = slice(at, at + _WINDOWS)
            items, least, first = cols[part], need[part], middles[part] - wide
            low, high = int(first.min()), int(first.max()) + 2 * wide
            near = np.pad(found[max(low, 0) : high].astype(np.uint16), (max(-low, 0), max(high - len(found), 0)), constant_values=latent.FEATURES)
            features = np.lib.stride_tricks.sliding_window_view(near, 2 * wide)[first - low]
            there = (self.bits.take((features >> 3) + (items * self.bits.shape[1]).astype(np.int32)[:, None]) >> (features & 7).astype(np.uint8) & 1).view(bool)
            there &= apart < self.reaches[items].astype(np.float32)[:, None]
            there[np.count_nonzero(there, axis=1) < least] = False
            both = np.flatnonzero(there)
            kinds, often = np.unique(both // (2 * wide) * latent.FEATURES + features.ravel()[both], return_counts=True)
            rows, kinds = np.divmod(kinds, latent.FEATURES)
            most = self.counts[np.searchsorted(self.kinds, items[rows] * latent.FEATURES + kinds)]
            out[part] = np.bincount(rows, np.minimum(often, most), len(items)) >= least
        return out


#: An item's answer: what follows "answer:" or, without that, its last question mark.
_ANSWERS = re.compile(r"(?is)^.*\banswer\s*:(.+)$"), re.compile(r"(?s)^.*\?(.+)$")


def answer_words(text: str) -> list[bytes]:
    """Words of an item's answer; of its last third if it has none of its own."""
    for pattern in _ANSWERS:
        if (found := pattern.match(text)) and (words := latent.words_of(found[1])):
            return words
    words = latent.words_of(text)
    return words[-(-len(words) * 2 // 3) :]


def _scales(items: list[tuple[object, str]], vectors: np.ndarray) -> list[_Scale]:
    """Items by the power of two next to their number of words, which is the window they are sought in."""
    by: dict[int, list] = {}
    features = latent.Features()
    for item_id, text in items:
        words = latent.words_of(text)
        if len(words) >= SHORTEST:
            tail = answer_words(text)
            found = features(latent.letters(text))[0]
            sum_ = vectors[found].sum(axis=0)
            by.setdefault(2 ** round(np.log2(len(words))), []).append((sum_ / max(np.linalg.norm(sum_), 1e-9), found, (item_id, len(words), _masks(words), _masks(tail), len(tail))))
    return [_scale(window, *zip(*found, strict=True)) for window, found in sorted(by.items())]


def _scale(window: int, sums: tuple[np.ndarray, ...], features: tuple[np.ndarray, ...], items: tuple) -> _Scale:
    sizes = np.array([len(found) for found in features])
    kinds, counts = np.unique(np.concatenate([k * latent.FEATURES + found for k, found in enumerate(features)]), return_counts=True)
    rows, there = np.divmod(kinds, latent.FEATURES)
    bits = np.zeros((len(items), latent.FEATURES // 8 + 1), np.uint8)
    np.bitwise_or.at(bits, (rows, there >> 3), (1 << (there & 7)).astype(np.uint8))
    return _Scale(window, np.array(sums, np.float32).T.copy(), list(items), sizes, -(-sizes * 3 // 4) + max(window // 2, 1), bits, kinds, counts)


class _Verbatim:
    """Places where items stand word for word, found by the features of their first words."""

    def __init__(self, items: list[tuple[object, str]]):
        self.odd = np.random.default_rng(5).integers(0, 1 << 62, SHORTEST, np.int64) * 2 + 1
        self.by: dict[int, tuple[np.ndarray, dict[int, list[tuple[object, list[bytes]]]]]] = {}
        features = latent.Features()
        for item_id, text in items:
            words = latent.words_of(text)
            if words:
                n = min(len(words), SHORTEST)
                key = int(self._keys(features(b" ".join(words[:n]))[0], n)[0])
                self.by.setdefault(n, (np.zeros(1 << 16, bool), {}))[1].setdefault(key, []).append((item_id, words))
                self.by[n][0][key & 0xFFFF] = True

    def _keys(self, found: np.ndarray, n: int) -> np.ndarray:
        keys = sum(found[k : len(found) - n + 1 + k] * self.odd[k] for k in range(n))
        return keys ^ (keys >> 29)

    def __call__(self, found: np.ndarray) -> Iterator[tuple[int, object, list[bytes]]]:
        """Features of texts -> (place, item, its words), where its first words may stand."""
        for n, (there, known) in self.by.items():
            if len(found) >= n:
                keys = self._keys(found, n)
                for at in np.flatnonzero(there[keys & 0xFFFF]).tolist():
                    for item_id, words in known.get(int(keys[at]), ()):
                        yield at, item_id, words


class _Words:
    """The words of a text, made when they are first asked for."""

    def __init__(self, data: bytes):
        self.data, self.made = data, None

    def __call__(self) -> list[bytes]:
        if self.made is None:
            self.made = self.data.split()
        return self.made


class _Search:
    """Leaks in texts. Texts stand one after the other, and windows run over them all; what is near an item is checked in each text it touches."""

    def __init__(self, vectors: np.ndarray, limits: Limits, scales: list[_Scale], verbatim: _Verbatim):
        self.limits, self.vectors, self.scales, self.verbatim, self.features = limits, vectors, scales, verbatim, latent.Features()
        self.widest = max((s.window for s in scales), default=0)
        self.grain = max(min((s.window for s in scales), default=2) // 2, 1)

    def __call__(self, texts: Iterable[str | None]) -> list[list[dict]]:
        return [found for group in latent.groups(map(latent.letters, texts)) for found in self._group(group)]

    def _group(self, texts: list[bytes]) -> list[list[dict]]:
        best: list[dict[object, tuple[float, float]]] = [{} for _ in texts]
        found, counts = self.features(*texts)
        ends = np.cumsum(counts)
        words = [_Words(t) for t in texts]
        for place, item_id, item in self.verbatim(found):
            k = int(np.searchsorted(ends, place, "right"))
            start = place - (int(ends[k - 1]) if k else 0)
            if item_id not in best[k] and words[k]()[start : start + len(item)] == item:
                best[k][item_id] = (1.0, 1.0)
        for at in range(0, len(found), _SPAN):
            part = found[at : at + _SPAN + self.widest]
            grain = self.grain
            many = -(-len(part) // grain)
            part = np.append(part, np.full(many * grain - len(part), latent.FEATURES))
            total = np.zeros((many + self.widest // grain + 1, self.vectors.shape[1]), np.float32)
            np.cumsum(latent.sums(self.vectors, part.reshape(many, grain)), axis=0, out=total[1 : many + 1])
            total[many + 1 :] = total[many]
            for scale in self.scales:
                self._windows(words, found, ends, at, min(_SPAN, len(found) - at), total, scale, best)
        return [[{"item_id": k, "share": s, "answer_share": a} for k, (s, a) in b.items()] for b in best]

    def _windows(self, words: list[_Words], found: np.ndarray, ends: np.ndarray, at: int, n: int, total: np.ndarray, scale: _Scale, best: list[dict]) -> None:
        window, step = scale.window, max(scale.window // 2, 1)
        many = -(-n // step)
        wide, apart = window // self.grain, step // self.grain
        sums = total[: many * apart + wide - apart + 1]
        sums = sums[wide::apart] - sums[:-wide:apart]
        limit = self.limits.near * np.sqrt(np.einsum("ij,ij->i", sums, sums))
        rows, cols = np.divmod(np.flatnonzero(sums @ scale.vectors >= np.maximum(limit, 1e-6)[:, None]), len(scale.items))
        low = at + rows * step
        kept = scale.may_have(found, low + window // 2, cols, self.limits.paraphrase)
        low, cols = low[kept], cols[kept]
        first = np.searchsorted(ends, low, "right")
        last = np.searchsorted(ends, low + window - 1, "right")
        for start, col, a, b in zip(low.tolist(), cols.tolist(), first.tolist(), last.tolist(), strict=True):
            item_id, size, masks, tail, tail_size = scale.items[col]
            reach = int(scale.reaches[col])
            for k in range(a, min(b + 1, len(words))):
                middle = start + window // 2 - (int(ends[k - 1]) if k else 0)
                there = words[k]()[max(middle - reach, 0) : max(middle + reach, 0)]
                places = _places(masks, there)
                if len(places) < self.limits.paraphrase * size:
                    continue
                share = _common(places) / size
                if share >= self.limits.paraphrase:
                    answer = common_length(tail, there) / tail_size
                    if (share >= self.limits.leak or answer >= self.limits.answer) and share > best[k].get(item_id, (0.0, 0.0))[0]:
                        best[k][item_id] = (share, answer)


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", leaks_col: str = "leaks", rank: int = 64, limits: Limits = Limits()) -> DataFrame:
    """``docs`` with the benchmark items found in each whole text: an array of (item_id, share, answer_share), empty if clean.

    Passages of documents and items are TF-IDF vectors over hashed words in a
    latent space, which is fitted on all of them (documents of the same words count once there); windows of about an item's length, half overlapping, that are
    near an item are compared word by word. A document leaks an item if enough of
    the item's words stand there in order, or fewer of them with enough of
    its answer (see ``Limits``, ``answer_words``). Besides, an item of any length that stands there word for word
    is found by its first words, whatever the cosine; those of fewer than SHORTEST words only so.
    Of items with one text the smallest id is named. Null and empty texts are clean; null items and those without
    words never match; an empty benchmark leaves all clean. Rows are judged on their own; other columns stay,
    but ``leaks_col`` is replaced. The benchmark goes to the
    tasks in blocks of about ITEMS different texts, one pass over the documents each.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = _different(benchmark, item_col, item_text_col)
    item_type = items.schema["item_id"].dataType
    words = scratch.keep(latent.features_of(docs, text_col), "words")
    frequencies, rows = latent.document_frequencies(words)
    idf = latent.inverse(frequencies, rows)
    basis = latent.fit(words.distinct().unionByName(latent.features_of(items, "text")), idf, scratch, rank, tasks=rows // FIT_DOCUMENTS)
    vectors = spark.sparkContext.broadcast(latent.weighted(basis, idf))

    blocks = -(-items.count() // ITEMS)
    kind = T.ArrayType(T.StructType([T.StructField("item_id", item_type), T.StructField("share", T.DoubleType()), T.StructField("answer_share", T.DoubleType())]))
    schema = T.StructType([*docs.drop(leaks_col).schema.fields, T.StructField(leaks_col, kind)])
    out = docs.drop(leaks_col).withColumn(leaks_col, F.array().cast(kind))
    place = docs.drop(leaks_col).columns.index(text_col)
    for block in range(blocks):
        chosen = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()]
        sought = spark.sparkContext.broadcast((_scales(chosen, vectors.value), _Verbatim(chosen)))
        out = out.mapInArrow(_judge(vectors, sought, place, limits), schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs``, with their columns, that leak no item."""
    found = "leaks"
    while found in docs.columns:
        found += "_"
    return with_leaks(docs, benchmark, text_col, item_col, item_text_col, found, limits=limits).where(F.size(found) == 0).drop(found)


def _judge(vectors, sought, place: int, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(vectors.value, limits, *sought.value)
        for batch in batches:
            before = batch.column(batch.num_columns - 1)
            found = [[*old.as_py(), *new] for old, new in zip(before, search(text.as_py() for text in batch.column(place)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, before.type)], schema=batch.schema)

    return run


def _different(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """(item_id, text): each different text once, with its smallest id."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where(F.length("text") > 0)
    least = F.min(F.struct(F.isnull("item_id").alias("none"), F.col("item_id"))).alias("least")
    return items.groupBy("text").agg(least).select("least.item_id", "text")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """(doc_id, item_id, share, answer_share) of each item that a document leaks; items with one text are found together."""
    found = with_leaks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, "text", item_col, item_text_col, limits=limits)
    found = found.select("doc_id", F.inline("leaks"))
    every = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where(F.length("text") > 0).distinct()
    named = _different(benchmark, item_col, item_text_col).withColumnRenamed("item_id", "named").join(every, "text").select("named", F.col("item_id").alias("also"))
    return found.join(named, found.item_id.eqNullSafe(named.named)).select("doc_id", F.col("also").alias("item_id"), "share", "answer_share").distinct()
