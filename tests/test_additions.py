import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import planning, rendering, similar
from tessera.sources import files


def test_tables_inside_a_text(spark):
    text = "Before | no table\n| a | **bold** |\n|---|:-:|\n| longer cell | x |\n| one |\n\n  |p|\n|\n||\nAfter"
    odd = [(1, text), (2, None), (3, ""), (4, "|--|--|")]
    found = {r["k"]: r["t"] for r in spark.createDataFrame(odd, "k int, t string").select("k", rendering.realign(F.col("t")).alias("t")).collect()}
    assert found[1] == "Before | no table\n| a           | **bold** |\n| ----------- | :--: |\n| longer cell | x    |\n| one         |      |\n\n| p |\n|\n|  |\nAfter"
    assert found[2] is None and found[3] == "" and found[4] == "| -- | -- |"


@pytest.mark.parametrize("part", [1024, 7])
def test_near_pairs_match_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(similar, "PART", part)
    monkeypatch.setattr(similar, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    rows = [*base, *(base + rng.normal(size=base.shape) * 0.25), *(base[:20] + rng.normal(size=(20, 24)) * 0.5), *[base[0]] * 40, np.zeros(24)]
    frame = spark.createDataFrame([*((k, v.tolist()) for k, v in enumerate(rows)), (1000, None), (None, base[1].tolist())], "k long, v array<double>")
    pairs, members = similar.near_pairs(frame, "k", "v", 0.85)
    unit = np.array([v / np.linalg.norm(v) for v in rows[:-1]])
    first = {}
    of = [first.setdefault(v.tobytes(), k) for k, v in enumerate(rows[:-1])]
    want = {(a, b) for a in range(len(unit)) for b in range(a + 1, len(unit)) if of[a] == a and of[b] == b and round(float(unit[a] @ unit[b]), 6) > 0.85}
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.98 * len(want) > 50
    assert {r["id"]: r["of"] for r in members.collect()} == dict(enumerate(of))


def test_tables_of_hyperplanes():
    assert similar.tables_for(0.85, 10, 1e-4) > similar.tables_for(0.95, 10, 1e-4) > similar.tables_for(0.95, 5, 1e-4) and similar.tables_for(1.0, 9, 0.1) == 1


def test_no_vectors(spark):
    pairs, members = similar.near_pairs(spark.createDataFrame([], "k long, v array<float>"), "k", "v")
    assert pairs.collect() == [] and members.collect() == []


def test_manifests_of_both_forms(spark):
    new = {"ticker": "AB", "sections": {"a.md": {"question_count": 3, "answered": 1}}, "question_hashes": {"h1": ["a.md", "Q1.1"]}}
    old = new | {"question_hashes": [["h1", "a.md", "Q1.1"]]}
    rows = [("new", json.dumps(new)), ("old", json.dumps(old)), ("empty", json.dumps(new | {"question_hashes": []})), ("bad", "{"), ("null", None), ("bare", "{}")]
    sections, hashes = files.question_manifests(spark.createDataFrame(rows, "path string, text string"))
    assert sorted(map(tuple, hashes.collect())) == [("new", "h1", "a.md", "Q1.1"), ("old", "h1", "a.md", "Q1.1")]
    assert sorted(map(tuple, sections.collect())) == [(p, "AB", "a.md", 3, 0, 0, 1, 0, 0, 0) for p in ("empty", "new", "old")]


def test_refreshed_manifest_can_be_read(spark):
    asked = spark.createDataFrame([("a.md", "Q1.1", "pending", "What is it?"), ("a.md", "Q1.2", "Answered", "Why?"), ("b.md", "Q2.1", "error", "what is it")], "path string, id string, status string, question string")
    made = files.refreshed_manifest(asked, "AB").select(F.lit("m").alias("path"), "text")
    sections, hashes = files.question_manifests(made)
    assert sorted(tuple(r)[2:] for r in sections.collect()) == [("a.md", 2, 1, 0, 1, 0, 0, 0), ("b.md", 1, 0, 0, 0, 1, 0, 0)]
    assert sorted(tuple(r)[2:] for r in hashes.collect()) == [("a.md", "Q1.1"), ("a.md", "Q1.2")]


def test_rounds_end_and_only_truncated_sections_are_planned_again(spark, tmp_path):
    sections = spark.createDataFrame([("Item 1", "x" * 4000), ("Other", "y" * 400), ("Item 7", "z" * 60_000)], "section string, text string")
    asked = []

    def summarise(requests):
        need = F.when(F.col("section") == "Item 7", 100_000).when(F.col("section") == "Item 1", 5000).otherwise(100)
        asked.append(sorted(r["custom_id"] for r in requests.select("custom_id").collect()))
        return requests.select("custom_id", "max_tokens", (F.col("max_tokens") < need).alias("truncated"))

    last = planning.until_whole(sections, "section", "text", F.lit("p"), planning.weights(spark), summarise, str(tmp_path))
    found = {r["custom_id"]: (r["round"], r["max_tokens"], r["truncated"]) for r in last.collect()}
    assert found["p_Other"] == (0, 800, False) and found["p_Item-1"] == (2, 6750, False)
    assert found["p_Item-7"][1:] == (planning.MOST_TOKENS, True)  # it can't rise any further
    assert asked[0] == ["p_Item-1", "p_Item-7", "p_Other"] and asked[1] == ["p_Item-1", "p_Item-7"] and asked[-1] == ["p_Item-7"] and len(asked) < 10


def test_documents_are_planned_by_their_kind(spark):
    docs = spark.createDataFrame([("a", "transcript", "x" * 10), ("b", "presentation", "y" * 10), ("c", "conference", "z" * 40)], "id string, kind string, text string")
    made = planning.plan_documents(docs, "kind", "text", F.col("id"), planning.weights(spark))
    assert sorted(r["custom_id"] for r in made.collect()) == ["a_Prepared-Remarks", "a_Q-and-A", "b_Summary", "c_Prepared-Remarks", "c_Q-and-A"]
    some = planning.plan_documents(docs, "kind", "text", F.col("id"), planning.weights(spark), only=["q-&-a"])
    assert sorted(r["custom_id"] for r in some.collect()) == ["a_Q-and-A", "c_Q-and-A"]
