import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mining


def brute(rows, is_anchor, percent=80, scale=256):
    made = {(i, l, tuple(math.floor(scale * x) for x in v)) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    last = lambda i: (i is None, i or 0)
    out = []
    for i, l, v in made:
        if i is None or not is_anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), last(j), j, m) for j, m, w in made if j != i))
        for s, _, j, _ in [x for x in scored if x[3] == l][:5]:
            fits = [x for x in scored if x[3] != l and percent * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, k + 1, x[2], -s, -x[0]) for k, x in enumerate(fits)]
    return sorted(out, key=repr)


def table(seed=1, n=400, d=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(d)]
        if i % 3 == 0:
            v = [0.5, 0.25, 0.0, -0.5, 0.125, 0.0]  # a third of all rows
        rows.append((i, v, rng.choice([1, 2, 2, 2, 3])))
    rows += [(500, None, 1), (510, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (520, [float("nan")] * d, 1), (530, [float("inf")] * d, 1), (540, [1.0] * d, None)]
    rows += [(550, [0.0] * d, 2), (560, [], 2), (570, [1.0, 2.0], 2), (580, [1.0] * 9, 3), (None, [0.5] * d, 2), (None, [0.4] * d, 1), rows[10], rows[20], rows[20], (20, [0.3] * d, 3)]
    return rows


@pytest.mark.parametrize("vectors, anchors", [(8192, 1024), (50, 7)])
def test_matches_brute_force(spark, monkeypatch, vectors, anchors):
    monkeypatch.setattr(mining, "VECTORS", vectors)
    monkeypatch.setattr(mining, "ANCHORS", anchors)
    rows = table()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as id", "'y' as vector", "1 as anchor", "2 as rank", "3 as block")
    found = sorted(map(tuple, mining.mine(frame, F.col("vec_id") % 10 == 0).collect()), key=repr)
    assert found == brute(rows, lambda i: i % 10 == 0) and len(found) > 100


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**20 + i), float(-(2**21) + 3 * i), 1.0 / 3], i % 2) for i in range(40)]
    found = sorted(map(tuple, mining.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 10 == 0).collect()), key=repr)
    assert found == brute(rows, lambda i: i % 10 == 0) and max(r[4] for r in found) > 1 << 53


def test_reading_stops_early():
    """Where one direction stands out, few rows are scored."""
    rng = np.random.default_rng(1)
    vectors = rng.integers(-5, 5, (4096, 4)).astype(float)
    vectors[:20, 0] += 1000
    lists = mining.Lists(vectors)
    scored = []
    lists.vectors = type("Spy", (np.ndarray,), {"__matmul__": lambda self, a: scored.append(len(self)) or np.asarray(self) @ a})(vectors.shape, vectors.dtype, vectors.tobytes())
    anchor = np.array([9.0, 1.0, 0.0, -1.0])
    (places, scores), = lists.search(anchor, [(-np.inf, np.inf)], 5)
    every = vectors @ anchor
    assert np.asarray(places).tolist() == np.lexsort((np.arange(4096), -every))[:5].tolist() and sum(scored) < 400


def test_empty_and_without_anchors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert mining.mine(empty, F.col("vec_id") % 100 == 0).collect() == []
    assert mining.mine(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 100 == 0).collect() == []
