import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffixes
from tessera.llm.anchors import Anchors


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abcdé \n", k=n))
    shared = [text(n) for n in (60, 90, 150, 400)]
    rows = [(k, text(rng.randint(0, 200)) + rng.choice(shared) + text(rng.randint(0, 100)) + rng.choice(shared)) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "a" * 500), (53, "ab" * 200), (54, rows[3][1]), (55, rows[3][1]), (56, "short"), (57, "short")]
    return rows


@pytest.mark.parametrize("hot", [0, 2, 1 << 12])
def test_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "BLOCK", 2000)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as uid", "'x' as sha")
    found = suffixes.remove_repeats(docs, length=64).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 64)


def test_repeated_and_null_ids(spark):
    rows = [(1, "x" * 70), (1, "y" * 30 + "z" * 70), (None, "z" * 70), (None, "x" * 70)]
    found = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=64)
    got = sorted((tuple(r)[:5] for r in found.collect()), key=repr)
    assert got == brute(rows, 64)


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_two_stage_order():
    rng = random.Random(3)
    for letters in ("ab", "abcdefgh", "a"):
        text = "".join(rng.choices(letters, k=300)).encode()
        wanted = np.array([rng.random() < 0.7 for _ in text])
        order = suffixes.sorted_starts(text, wanted, len(text))
        assert order == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: text[i:])


def test_anchors_depend_on_content_alone(monkeypatch):
    rng = random.Random(4)
    inner = bytes(rng.choices(range(256), k=200))
    seen = set()
    for n in (0, 17, 333):
        data = bytes(rng.choices(range(256), k=n)) + inner + bytes(rng.choices(range(256), k=50))
        h, first, last = Anchors(200)(data)
        assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()
        seen.add(int(h[np.searchsorted(last, n)]))
    assert len(seen) == 1


def test_common_prefixes_match_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        text = bytes(rng.choices(b"ab" if rng.random() < 0.5 else b"a\xff\x00b", k=400))
        for most in (1, 7, 8, 9, 40):
            order = sorted(range(len(text) - most), key=lambda i: text[i : i + most])
            got = suffixes.common_prefixes(text, np.array(order), most)
            want = [next((k for k in range(most) if text[a + k] != text[b + k]), most) for a, b in zip(order, order[1:], strict=False)]
            assert got.tolist() == want
    assert suffixes.common_prefixes(b"abc", np.array([1]), 2).tolist() == [] and suffixes.common_prefixes(b"", np.array([], np.int64), 2).tolist() == []
