"""Latent semantic basis of TF-IDF passages by a distributed randomised SVD."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.anchors import BASE, powers
from tessera.llm.scratch import Scratch

#: Features that words are hashed to; columns of the TF-IDF matrix.
FEATURES = 1 << 14
#: Words of a passage of the matrix.
PASSAGE = 64
#: Features of one part of a sum on its way from the tasks.
_PART = 1 << 11
#: Bytes that are hashed at once; a longer word is hashed on its own.
STRETCH = 1 << 18
#: Bytes of texts that are joined, passages and words that are summed at once.
GROUP = 1 << 16
_BLOCK = 1 << 14
_RUN = 1 << 10
#: Tasks of a sum over passages, at most: each sends FEATURES x width numbers.
_TASKS = 64
_LETTERS = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def letters(text: str | None) -> bytes:
    """A text's bytes with A-Z lower-cased and other ASCII characters but letters and digits as spaces."""
    return (text or "").encode().translate(_LETTERS)


def words_of(text: str | None) -> list[bytes]:
    return letters(text).split()


class Features:
    """Features of words, hashed from the bytes of texts without building the words."""

    def __init__(self):
        self.table = np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
        self.up, self.down = (powers(b, STRETCH + 1) for b in (BASE, pow(BASE, -1, 1 << 64)))

    def __call__(self, *texts: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Texts as ``letters`` gives them -> features of all their words, and each text's number of words."""
        data = b" ".join(texts)
        found, places, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        while at < len(data):
            end = min(at + STRETCH, len(data))
            if end < len(data):
                end = data.rfind(b" ", at, end) + 1
                if not end:
                    end = data.find(b" ", at + STRETCH) % (len(data) + 1)
                    found.append(np.array([xxhash.xxh3_64_intdigest(data[at:end]) >> (64 - FEATURES.bit_length() + 1)], np.int64))
                    places.append(np.array([at], np.int64))
                    at = end
                    continue
            hashed, first = self._stretch(np.frombuffer(data, np.uint8, end - at, at))
            found.append(hashed)
            places.append(first + at)
            at = end
        ends = np.cumsum([len(t) + 1 for t in texts])
        return np.concatenate(found), np.diff(np.searchsorted(np.concatenate(places), ends), prepend=0)

    def _stretch(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], data == 32, [True])).view(np.int8)))
        first, last = edges[::2], edges[1::2]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=total[1:])
        found = (total[last] - total[first]) * self.down[first]
        found ^= found >> np.uint64(29)
        found *= np.uint64(0xBF58476D1CE4E5B9)
        return (found >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64), first


def groups(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Texts, in order, in groups of about GROUP bytes."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text) + 1
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def features_of(docs: DataFrame, text_col: str) -> DataFrame:
    """(words): the features of each text's words, in order, as 16-bit numbers; a row each, null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            out: list[bytes] = []
            for group in groups(letters(text.as_py()) for text in batch.column(0)):
                found, counts = features(*group)
                out += [part.tobytes() for part in np.split(found.astype(np.int16), np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["words"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "words binary")


def document_frequencies(words: DataFrame) -> tuple[np.ndarray, int]:
    """Number of texts with each feature, over all rows of ``features_of``, and number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(FEATURES, np.int64), 0
        there = np.zeros(FEATURES, bool)
        for batch in batches:
            for found in batch.column(0):
                there[:] = False
                there[np.frombuffer(found.as_py(), np.int16)] = True
                total += there
            rows += batch.num_rows
        kinds = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kinds, -1)), pa.array(np.append(total[kinds], rows))], ["feature", "n"])

    summed = words.select("words").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out, rows = np.zeros(FEATURES, np.int64), 0
    for r in summed:
        if r["feature"] < 0:
            rows = r["n"]
        else:
            out[r["feature"]] = r["n"]
    return out, rows


def inverse(frequencies: np.ndarray, rows: int) -> np.ndarray:
    return np.log((1 + rows) / (1 + frequencies)).astype(np.float32)


def _lengths(passages: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Lengths of the TF-IDF vectors of passages."""
    found = np.sort(passages, axis=1).ravel()
    first = np.diff(found, prepend=-1) != 0
    first[::PASSAGE] = True
    at = np.flatnonzero(first)
    weights = np.diff(at, append=len(found)) * idf[found[at]]
    return np.sqrt(np.bincount(at // PASSAGE, weights * weights, len(passages)))


def _passages(idf: np.ndarray):
    """Rows of ``features_of`` -> their passages, the last filled up with FEATURES, which weighs nothing, and one over each one's length."""
    idf = np.append(idf, np.float32(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passages, scales = [], []
            for found in batch.column(0):
                words = np.frombuffer(found.as_py(), np.int16)
                filled = np.full((-(-len(words) // PASSAGE), PASSAGE), FEATURES, np.int16)
                filled.ravel()[: len(words)] = words
                passages.append(filled)
            many = np.cumsum([len(p) for p in passages])
            if len(many):
                every = np.concatenate(passages)
                length = np.concatenate([_lengths(every[at : at + _BLOCK], idf) for at in range(0, max(len(every), 1), _BLOCK)])
                scales = np.split((1 / np.maximum(length, 1e-9)).astype(np.float32), many[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in part], pa.binary()) for part in (passages, scales)], ["words", "scales"])

    return run


def weighted(basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A vector for each feature, and a zero one for what fills up."""
    return np.concatenate([basis * idf[:, None], np.zeros((1, basis.shape[1]), np.float32)])


def sums(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of the vectors that each row names; a few thousand at a time, which stay in the processor's cache."""
    many, size = rows.shape
    step = max(_RUN * 4 // size, 1)
    out, taken, ones = np.empty((many, vectors.shape[1]), np.float32), np.empty((step, size, vectors.shape[1]), np.float32), np.ones((1, size), np.float32)
    for at in range(0, many, step):
        n = min(step, many - at)
        np.take(vectors, rows[at : at + n], axis=0, out=taken[:n], mode="clip")
        np.matmul(ones, taken[:n], out=out[at : at + n, None])
    return out


def _add(total: np.ndarray, passages: np.ndarray, scales: np.ndarray, vectors: np.ndarray) -> None:
    """Adds up, by feature, what passages are in the basis."""
    there = sums(vectors, passages) * (scales * scales)[:, None]
    order = np.argsort(passages, axis=None, kind="stable")
    found, rows = passages.ravel()[order], order // PASSAGE
    taken = np.empty((_RUN, there.shape[1]), np.float32)
    for at in range(0, len(found), _RUN):
        part = found[at : at + _RUN]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        np.take(there, rows[at : at + _RUN], axis=0, out=taken[: len(part)], mode="clip")
        total[part[first]] += np.add.reduceat(taken[: len(part)], first, axis=0)


def _there_and_back(passages: DataFrame, basis: np.ndarray, idf: np.ndarray, tasks: int) -> np.ndarray:
    """A^T (A basis) for the matrix A of passages: tasks sum their passages, parts of the sums meet by range of features."""
    width = basis.shape[1]
    shared = passages.sparkSession.sparkContext.broadcast(weighted(basis, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, width), np.float32)
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int16).reshape(-1, PASSAGE)
            scales = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32)
            for at in range(0, len(words), _BLOCK):
                _add(total, words[at : at + _BLOCK], scales[at : at + _BLOCK], shared.value)
        parts = range(0, FEATURES, _PART)
        yield pa.RecordBatch.from_arrays([pa.array([*parts], pa.int64()), pa.array([total[a : a + _PART].tobytes() for a in parts], pa.binary())], ["part", "sum"])

    def add(parts: pa.Table) -> pa.Table:
        total = np.zeros(_PART * width, np.float32)
        for part in parts.column("sum"):
            total += np.frombuffer(part.as_py(), np.float32)
        return pa.table({"part": parts.column("part")[:1], "sum": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((FEATURES, width), np.float32)
    for r in passages.coalesce(tasks).mapInArrow(run, "part long, sum binary").groupBy("part").applyInArrow(add, "part long, sum binary").collect():
        out[r["part"] : r["part"] + _PART] = np.frombuffer(r["sum"], np.float32).reshape(_PART, width)
    return out * idf[:, None]


def fit(words: DataFrame, idf: np.ndarray, scratch: Scratch, rank: int = 64, more: int = 16, tasks: int = 8) -> np.ndarray:
    """Rows of ``features_of``, all of them -> features x ``rank`` basis of their passages' TF-IDF matrix A.

    The first direction, which common words share, is left out; the others are
    divided by their singular values, so that all count alike; those that the
    passages don't have are zero.

    A random sketch of ``rank + more`` columns goes through A^T A twice, and the
    Nystroem approximation Y (Q^T Y)^-1 Y^T of A^T A, for the orthonormal sketch
    Q and Y = A^T A Q, has the eigenvectors. FEATURES x (rank + more) numbers per
    task and on the driver, whatever the number of texts.
    """
    tasks = max(1, min(tasks, _TASKS))
    passages = scratch.keep(words.select("words").mapInArrow(_passages(idf), "words binary, scales binary"), "passages")
    sketch = np.random.default_rng(42).standard_normal((FEATURES, rank + more)).astype(np.float32)
    sketch = np.linalg.qr(_there_and_back(passages, sketch, idf, tasks).astype(np.float64))[0]
    image = _there_and_back(passages, sketch.astype(np.float32), idf, tasks).astype(np.float64)
    scratch.clear()
    values, vectors = _eigen(sketch.T @ image)
    root = image @ (vectors / np.sqrt(values))
    values, vectors = _eigen(root.T @ root)
    out = np.zeros((FEATURES, rank), np.float32)
    found = root @ (vectors / values)[:, 1 : rank + 1]
    out[:, : found.shape[1]] = found
    return out


def _eigen(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues that tell from rounding, largest first, and their vectors."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    kept = np.flatnonzero(values > 1e-6 * values.max(initial=1e-9))[::-1]
    return values[kept], vectors[:, kept]
