import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Hello world", "", None, "a  b", "a   b\n c", " lead", "tail ", "\n x\n\ny   z", "it's  we'll I'd", "x<|endoftext|>y z<| b", "é" * 50, "no spaces" * 300, "word " * 3000, "Grüße, señor!\tok", "　wide    space"]


def test_ids_are_the_tokenizers():
    plain, encode = Tokenizer.from_file(PATH), packing._Encoder(PATH)
    rng = random.Random(1)
    texts = [t for t in TEXTS if t] + ["".join(rng.choices(["a", "b ", "\n", " ", "é", "'s", "12", ",", "\t", "the "], k=60)) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_round_trip(spark):
    plain = Tokenizer.from_file(PATH)
    rows = [(k, t, 1) for k, t in enumerate(TEXTS * 3)] + [(None, "null id", 2), (None, "null id", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    placed = packing.pack_documents(docs, PATH, with_ids=True).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        for k, at in enumerate([0, *range(head, len(ids), 1024)]):
            want[(i, k, at, tuple(ids[at : at + (head if k == 0 else 1024)]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in placed) == want
    bins = {}
    for r in placed:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) == -(-sum(r["length"] for r in placed) // 1024) or len(bins) <= 1.02 * sum(r["length"] for r in placed) / 1024 + 1


def test_plan_uses_each_piece_once():
    rng = random.Random(2)
    counts = Counter(rng.choices([3, 5, 7, 64, 100, 101, 511, 512, 513, 1000, 1024], k=5000))
    plan = packing.best_two_fit(dict(counts), 1024)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] += times
    assert used == counts


def test_two_fit_replaces_the_smallest():
    assert packing.best_two_fit({60: 1, 30: 1, 20: 2}, 100)[0][0] == (60, 20, 20)


def test_piece_too_long(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 9, 1)], "doc_id long, piece int, length long, ids_crc32 long"), 8)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
