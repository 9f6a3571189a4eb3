"""Every operator and stage over nulls, empty and very long texts, repeats, empty tables and columns with any name used inside."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, decontaminate, html, jaccard, lines, mining, near, packing, quality, repair, simhash, suffixes, tokens, urls

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Names that the operators use for columns of their own.
NAMES = (
    "_counts counts row words trimmed windows ordered again base_failed kept rejected_by n_words n_symbols _round rule took hit dropped _of _hash _id _node sparse h1 h2 h pos key line uid sha data z hits "
    "spans seg lo hi place removed fp root node a b component_id first keys s1 s2 size set _bucket _n _before _nth _rank length piece start ids_crc32 sequence_id offset leaks item_id share answer_share "
    "features weights part feature n host path verdict trust distrust near best suffix src dst weight score conv _part turns t ts at task text_hash set_id s3 s4 rows wanted packed m sets n_shingles anchor "
    "id label vector is_anchor nth block of positive_id positive_score rank negative_id fault symbol signature ways gaps audit cost group"
).split()
LONG = " ".join(f"long{k % 5000}" for k in range(60_000))
GOOD = " ".join(f"word{k} of a text that is fine" for k in range(12))
TEXTS = [None, "", " \n\t", "one", "a\nb\nc", GOOD, GOOD, GOOD.upper(), LONG, "x" * 70_000, "\n" * 500, "<|endoftext|> <|im_end|>", "é" * 300, "same line\n" * 30]


def documents(spark, rows):
    extra = [F.lit("clash").alias(n) for n in NAMES]
    base = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return base.select("*", *extra)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*enumerate(TEXTS), (5, GOOD), (5, GOOD), (None, "null id"), (None, None), (None, GOOD)]
    return documents(spark, rows), rows


def _benchmark(spark):
    return spark.createDataFrame([(1, "an item of seven words that nobody has", "clash"), (2, None, "clash"), (2, "", "clash"), (None, "zzz", "clash")], "item_id long, text string, leaks string")


OPERATORS = {
    "count_tokens": lambda d: tokens.count_tokens(d, PATH),
    "leaks": lambda d: decontaminate.leaks(d, _benchmark(d.sparkSession)),
    "with_leaks": lambda d: decontaminate.with_leaks(d, _benchmark(d.sparkSession)),
    "judge": quality.judge,
    "keep_good": quality.keep_good,
    "pack_documents": lambda d: packing.pack_documents(d, PATH),
    "near_duplicates": simhash.near_duplicates,
    "simhash.one_of_each": simhash.one_of_each,
    "near.one_of_each": near.one_of_each,
    "remove_repeats": suffixes.remove_repeats,
    "link_documents": jaccard.link_documents,
    "drop_lines": lines.drop_lines,
    "with_dropped": lambda d: lines.with_dropped(d, lines.line_bitmaps(d, min_docs=2)),
}
#: Operators with one row per row of the table.
ROW_BY_ROW = {"link_documents", "count_tokens", "with_leaks", "judge", "near_duplicates", "remove_repeats", "drop_lines", "with_dropped"}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(docs, name):
    frame, rows = docs
    out = OPERATORS[name](frame)
    found = out.collect()
    if name in ROW_BY_ROW:
        assert len(found) == len(rows)
    if name in ("keep_good", "simhash.one_of_each", "near.one_of_each", "drop_lines"):
        assert out.columns == frame.columns and all(r["uid"] == r["dropped"] == r["root"] == "clash" for r in found)
    if name == "pack_documents":
        assert sum(r["piece"] == 0 for r in found) == len(rows) and all(0 < r["length"] <= 1024 and 0 <= r["offset"] <= 1024 - r["length"] for r in found)
    assert OPERATORS[name](frame.limit(0)).collect() == []


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, tmp_path, name, stage):
    frame, rows = docs
    _benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, frame, str(tmp_path))
    found = out.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == frame.columns and out.schema["n_chars"].dataType == frame.schema["n_chars"].dataType
    kept = {"quality_rules": 5, "line_dedup": len(rows), "decontamination": len(rows)}
    if name == "quality_rules":
        assert {r["text"] for r in found} <= {GOOD, GOOD.upper(), LONG} and sum(r["text"] == GOOD for r in found) == 5
    elif name == "near_dedup":
        assert sum((r["text"] or "").upper() == GOOD.upper() for r in found) == 1 and sum(not (r["text"] or "").strip() for r in found) == 1
    elif name in kept:
        assert len(found) >= kept[name]
    assert stage(spark, frame.limit(0), str(tmp_path)).collect() == []


def test_pages_and_chats(spark):
    extra = [F.lit("clash").alias(n) for n in NAMES]
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (2, "http://a.com/x", ""), (3, "", "<p>" + LONG), (None, "http://a.com/x", "<article>" + "<i>" * 5000 + "x")], "page_id long, url string, html string").select("*", *extra)
    read = html.extract(pages)
    assert len(read.collect()) == 5 and set(read.columns) == {*pages.columns, "text"}
    rules = spark.createDataFrame([("com", "/", "block"), ("com", "/", "allow"), (None, None, None)], "host string, path string, verdict string")
    assert sorted((r["rule"] or "", r["verdict"]) for r in urls.judge(pages, rules).collect()) == [("", "allow"), ("", "allow"), ("", "allow"), ("com/", "block"), ("com/", "block")]
    turns = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (None, None, None, LONG), (2, 1, "user", "")], "conv_id long, turn long, role string, text string").select("*", *extra)
    assert sorted(r["n_turns"] for r in chat.format_chats(turns).collect()) == [1, 1, 1]
    assert chat.format_chats(turns.limit(0)).collect() == [] and html.extract(pages.limit(0)).collect() == [] and urls.judge(pages.limit(0), rules).collect() == []


def test_vectors_and_repaired_chats(spark):
    names = [n for n in NAMES if n not in ("label", "turn", "role", "text")]
    extra = [F.lit("clash").alias(n) for n in names]
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, None, 1), (4, [None, 1.0], 1), (None, [1.0, 0.0], 1), (5, [], 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *extra)
    found = {(r["positive_id"], r["negative_id"]) for r in mining.mine(vectors, F.col("vec_id") == 0).collect()}
    assert found == {(1, 2), (None, 2)} and mining.mine(vectors.limit(0), F.col("vec_id") == 0).collect() == []
    turns = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (None, None, None, LONG), (2, 1, "user", ""), (2, 2, "user", LONG + ".")], "conv_id long, turn long, role string, text string").select("*", *extra)
    assert {(r["conv_id"], r["audit"]) for r in repair.repair(turns).collect()} == {(1, "DD"), (None, "D"), (2, "DKI")}
    assert repair.repair(turns.limit(0)).collect() == []
