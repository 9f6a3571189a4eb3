"""Hard negatives: Fagin's threshold algorithm over per-dimension sorted lists of blocks of vectors, for blocks of anchors."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

#: Vectors and anchors of a block, about; every block of anchors meets every block of vectors in a task of its own.
VECTORS, ANCHORS = 8192, 1024
#: The first step reads one part in so many of each list; each further step doubles what has been read.
FIRST_PART = 64


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers; shorter vectors end in zeros."""
    lists = vectors.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def _exact(vectors: np.ndarray, anchors: np.ndarray) -> type:
    """The fastest type in which all inner products are exact."""
    most = [max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (vectors, anchors)]
    bound = most[0] * most[1] * max(vectors.shape[1], 1)
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


class Lists:
    """Vectors in order of id with one list per dimension, sorted by that component."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)

    def search(self, anchor: np.ndarray, windows: list[tuple], k: int, allowed: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each (least, most) score the first ``k`` places, and their scores, by score and place.

        Lists of positive components of the anchor are read from their large end,
        of negative ones from their small end, all to the same depth; rows met for
        the first time are scored whole. No unread row scores more than the sum of
        the last components read, so reading stops once that is strictly less than the
        kth score, or the least score where fewer are found, of every window.
        """
        n = len(self.vectors)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        found = [(np.empty(0, np.int64), np.empty(0, self.vectors.dtype)) for _ in windows]
        seen, depth = np.zeros(n, bool), 0
        while depth < n:
            before, depth = depth, min(n, max(2 * depth, n // FIRST_PART, 4))
            met = np.zeros(n, bool)
            if len(up) or len(down):
                met[self.order[n - depth : n - before, up]] = True
                met[self.order[before:depth, down]] = True
            else:
                met[:], depth = True, n
            met &= ~seen
            seen |= met
            if allowed is not None:
                met &= allowed
            places = np.flatnonzero(met)
            scores = self.vectors[places] @ anchor
            last = (self.vectors[self.order[n - depth, up], up] * anchor[up]).sum() + (self.vectors[self.order[depth - 1, down], down] * anchor[down]).sum()
            done = True
            for w, (least, most) in enumerate(windows):
                fits = (scores >= least) & (scores <= most)
                at, of = np.concatenate((found[w][0], places[fits])), np.concatenate((found[w][1], scores[fits]))
                if len(at) > k:
                    first = np.lexsort((at, -of))[:k]
                    at, of = at[first], of[first]
                found[w] = at, of
                done &= bool(last < (of.min() if len(at) == k else least))
            if done:
                break
        return found


def _positives(k: int):
    def run(vectors: pa.Table, anchors: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = [], [], []
        for anchor, a, ids, lists, _ in _both(vectors, anchors, by_label=True):
            own = np.fromiter((i != anchor["id"] for i in ids), bool, len(ids))
            (places, scores), = lists.search(a, [(-np.inf, np.inf)], k, own)
            out[0].extend([anchor["anchor"]] * len(places))
            out[1].extend(ids[p] for p in places.tolist())
            out[2].extend(int(s) for s in scores.tolist())
        return pa.table([pa.array(x, pa.int64()) for x in out], ["anchor", "positive_id", "positive_score"])

    return run


def _negatives(k: int, percent: int):
    def run(vectors: pa.Table, anchors: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = [], [], [], []
        for anchor, a, ids, lists, labels in _both(vectors, anchors, by_label=False):
            tops = anchor["scores"]
            found = lists.search(a, [(-(-top * percent // 100), top) for top in tops], k, labels != anchor["label"])
            for top, (places, scores) in zip(tops, found, strict=True):
                out[0].extend([anchor["anchor"]] * len(places))
                out[1].extend([top] * len(places))
                out[2].extend(ids[p] for p in places.tolist())
                out[3].extend(int(s) for s in scores.tolist())
        return pa.table([pa.array(x, pa.int64()) for x in out], ["anchor", "positive_score", "negative_id", "negative_score"])

    return run


def _both(vectors: pa.Table, anchors: pa.Table, by_label: bool) -> Iterator[tuple]:
    """Each anchor with its vector and the ids, lists and labels of the block's vectors, or of those of its label."""
    if not len(vectors) or not len(anchors):
        return
    width = max(t.column("vector").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max() for t in (vectors, anchors))
    vectors = vectors.sort_by([("id", "ascending")])  # nulls last
    ids, labels = np.array(vectors.column("id").to_pylist(), object), vectors.column("label").to_numpy()
    matrix, wanted = (_matrix(t.column("vector"), width) for t in (vectors, anchors))
    kind = _exact(matrix, wanted)
    matrix, wanted = matrix.astype(kind), wanted.astype(kind)
    made: dict = {}
    for anchor, a in zip(anchors.drop_columns(["vector"]).to_pylist(), wanted, strict=True):
        key = anchor["label"] if by_label else None
        if key not in made:
            rows = np.flatnonzero(labels == key) if by_label else np.arange(len(labels))
            made[key] = ids[rows], Lists(matrix[rows]), labels[rows]
        yield anchor, a, *made[key]


def _finite(vector: Column) -> Column:
    """Whether there is a vector without null, infinite or NaN components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def mine(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, n_positives: int = 5, n_negatives: int = 5, percent: int = 80
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows where ``is_anchor`` (on ``rows``' columns) holds.

    A component x counts as floor(scale * x); scores are integer inner products,
    higher ones first, ties by smaller id, null ids last. An anchor's
    positives are the first ``n_positives`` rows of its label with another id; for each
    the first ``n_negatives`` rows of other labels are returned that score at least ``percent`` hundredths of
    the positive's score and no more than it. Rows with a null label, a null
    vector or a null or non-finite component take no part; rows alike in id, label and
    vector are one; shorter vectors count as if they ended in zeros; a score
    that is no long is an error. Other columns are ignored. An empty table, or one without anchors, gives an empty result.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "mining")
    vector = F.col(vector_col)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    fit = rows.where(F.col(label_col).isNotNull() & _finite(vector)).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), whole.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    made = scratch.keep(fit.groupBy("id", "label", "vector").agg(F.max("is_anchor").alias("is_anchor")), "rows")

    # Of vectors alike with one label no anchor needs more than the first few, whatever their number.
    alike = Window.partitionBy("label", "vector").orderBy(F.col("id").asc_nulls_last())
    few = made.select("id", "label", "vector", F.row_number().over(alike).alias("nth")).where(F.col("nth") <= max(n_positives + 1, n_negatives)).drop("nth")
    vectors = scratch.keep(few, "vectors")
    anchors = scratch.keep(made.where("is_anchor").select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "vector"), "anchors")
    across, down = max(ceil(vectors.count() / VECTORS), 1), max(ceil(anchors.count() / ANCHORS), 1)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("id", "label", "vector"), F.lit(n)).cast("int")
    left = vectors.select("*", place(across).alias("block"), each(down).alias("of")).groupBy("block", "of")
    dealt = lambda frame: frame.select("*", place(down).alias("of"), each(across).alias("block")).groupBy("block", "of")

    near = left.cogroup(dealt(anchors)).applyInArrow(_positives(n_positives), "anchor bigint, positive_id bigint, positive_score bigint")
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), F.col("positive_id").asc_nulls_last())
    positives = scratch.keep(near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= n_positives).drop("nth"), "positives")
    windows = positives.where("positive_score >= 0").groupBy("anchor").agg(F.collect_set("positive_score").alias("scores"))
    hard = left.cogroup(dealt(anchors.join(windows, "anchor"))).applyInArrow(_negatives(n_negatives, percent), "anchor bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    first = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last())
    negatives = scratch.keep(hard.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n_negatives), "negatives")
    named = scratch.keep(anchors.select("anchor", F.col("id").alias("anchor_id")), "named")
    scratch.clear("positives", "negatives", "named")
    found = positives.join(negatives, ["anchor", "positive_score"]).join(named, "anchor")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
