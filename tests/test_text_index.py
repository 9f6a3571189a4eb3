import math
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import boolean
from tessera.plans import text_index
from tessera.sources import folders

TEXTS = ["cash flow rose", "cash", "", None, "Flow of cash and cash flow", "other words", "rose cash flow flow cash", "a a a", "net income and net cash"]


def docs_of(spark, texts=TEXTS, first=0):
    return spark.createDataFrame([(first + k, t, f"s{k % 3}") for k, t in enumerate(texts)], "doc_id long, text string, source string")


def words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def brute(rows, atoms):
    """{id: score} for atoms (terms, sign) over rows (id, text)."""
    toks = {i: words(t) for i, t in rows}
    n = len(toks)
    avg = sum(map(len, toks.values())) / n
    df = lambda w: sum(w in t for t in toks.values())
    idf = lambda w: math.log(1 + (n - df(w) + 0.5) / (df(w) + 0.5))
    out = {}
    for i, t in toks.items():
        score, ok = 0.0, True
        met = False
        for terms, sign in atoms:
            tf = sum(t[k : k + len(terms)] == terms for k in range(len(t) - len(terms) + 1))
            ok &= not (sign == "-" and tf) and not (sign == "+" and not tf)
            if tf and sign != "-":
                met = True
                score += sum(map(idf, terms)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        if ok and met:
            out[i] = pytest.approx(score, abs=2e-6)
    return out


ASKED = {
    'cash OR "net income"': [(["cash"], ""), (["net", "income"], "")],
    '"cash flow"': [(["cash", "flow"], "")],
    '"flow cash" rose': [(["flow", "cash"], ""), (["rose"], "")],
    "cash AND rose": [(["cash"], "+"), (["rose"], "+")],
    'cash -"cash flow"': [(["cash"], ""), (["cash", "flow"], "-")],
    "cash NOT rose": [(["cash"], ""), (["rose"], "-")],
    '+flow "of cash and cash"': [(["flow"], "+"), (["of", "cash", "and", "cash"], "")],
    '"a a"': [(["a", "a"], "")],
    "-cash": [(["cash"], "-")],
    '"" OR': [],
}


@pytest.mark.parametrize("query", ASKED)
def test_atoms(spark, query):
    found = spark.createDataFrame([(query,)], "q string").select(boolean.atoms(F.col("q")).alias("a")).first()["a"]
    assert [(list(a["terms"]), a["sign"]) for a in found] == ASKED[query]


def test_atoms_of_odd_queries(spark):
    found = spark.createDataFrame([(None,), ("well-known fact",), ('cash +cash -cash',)], "q string").select(boolean.atoms(F.col("q")).alias("a")).collect()
    assert [[(list(a["terms"]), a["sign"]) for a in r["a"]] for r in found] == [[], [(["well"], ""), (["known"], ""), (["fact"], "")], [(["cash"], "-")]]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    return text_index.create(docs_of(spark), str(tmp_path_factory.mktemp("index") / "i"), source_col="source")


def test_phrases_and_operators_match_brute_force(spark, made):
    asked = spark.createDataFrame([(k, q) for k, q in enumerate(ASKED)], "query_id long, query string")
    found = {}
    for r in made.search_many(asked, 20).collect():
        found.setdefault(r["query_id"], {})[r["doc_id"]] = r["score"]
    assert found == {k: b for k, a in enumerate(ASKED.values()) if (b := brute(list(enumerate(TEXTS)), a))}
    one = made.search('cash OR "net income"', 2).collect()
    assert [r["doc_id"] for r in one] == [8, 1]


def answers(index, spark):
    asked = spark.createDataFrame([(k, q) for k, q in enumerate(ASKED)], "query_id long, query string")
    plain = [(q, [(r["doc_id"], round(r["score"], 5)) for r in index.bm25(q, 20).collect()]) for q in ("cash flow", "a net rose")]
    many = sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in index.bm25_many(asked, 20).collect())
    return plain, many, sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in index.search_many(asked, 20).collect())


def test_changes_equal_an_index_built_anew(spark, tmp_path):
    docs = docs_of(spark)
    index = text_index.create(docs.where("doc_id < 4"), str(tmp_path / "i"), source_col="source")
    assert index.count() == 4
    index = index.append(docs.where("doc_id >= 4 and doc_id < 7")).append(docs.where("doc_id >= 7"))
    anew = text_index.create(docs, str(tmp_path / "anew"), source_col="source")
    assert answers(index, spark) == answers(anew, spark) and index.count() == 9

    index, gone = index.delete_source("s1")
    left = docs.where("source <> 's1'")
    anew = text_index.create(left, str(tmp_path / "anew"), source_col="source")
    assert gone == 3 and index.count() == 6 and answers(index, spark) == answers(anew, spark)
    assert sorted(map(tuple, index.chunks().collect()), key=repr) == sorted(map(tuple, left.collect()), key=repr)
    assert index.delete_source("s1")[1] == 0

    new = spark.createDataFrame([(0, "cash cash income", "s2"), (90, "flow cash", "s2"), (1, "back again cash", "s1")], "doc_id long, text string, source string")
    with pytest.raises(folders.ChangedMeanwhile):
        index.append(new)  # another version has been made since
    index = text_index.open_index(spark, str(tmp_path / "i"))
    before, rows = index, index.count()
    index, gone = index.replace(new.where("doc_id <> 0"))
    both = left.where("source <> 's2'").unionByName(new.where("doc_id <> 0"))
    anew = text_index.create(both, str(tmp_path / "anew"), source_col="source")
    assert gone == 3 and answers(index, spark) == answers(anew, spark)
    assert before.count() == rows and sorted(r[0] for r in before.chunks().select("doc_id").collect()) == [0, 2, 3, 5, 6, 8]  # who reads the old version sees it whole

    merged = index.merge()
    assert len(merged.state["segments"]) == 1 and not merged.state["dead"] and answers(merged, spark) == answers(anew, spark)
    merged.vacuum()
    assert answers(text_index.open_index(spark, str(tmp_path / "i")), spark) == answers(anew, spark)
    assert merged.merge() is merged
    empty = merged.clear()
    assert empty.count() == 0 and empty.bm25("cash").collect() == [] and empty.search("cash").collect() == [] and empty.append(docs).count() == 9


def test_writers_of_one_version(spark, tmp_path):
    docs = docs_of(spark)
    index = text_index.create(docs, str(tmp_path / "i"), source_col="source")
    index.append(docs_of(spark, ["more"], 50))
    with pytest.raises(folders.ChangedMeanwhile):
        index.append(docs_of(spark, ["other"], 60))
    assert text_index.open_index(spark, str(tmp_path / "i")).count() == 10 and text_index.open_index(spark, str(tmp_path / "i"), 1).count() == 9


def test_index_of_a_changed_table_is_not_reused(spark, tmp_path):
    from tessera.bindings import retrieval

    docs_of(spark, ["the cash", "thing"]).write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["doc_id"] for r in retrieval.bm25_topk(spark, str(tmp_path)).collect()] == [1, 0]
    docs_of(spark, ["none", "nobody", "the one"]).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert [r["doc_id"] for r in retrieval.bm25_topk(spark, str(tmp_path)).collect()] == [2]
