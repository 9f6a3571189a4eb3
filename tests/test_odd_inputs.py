import duckdb
import numpy as np

from tessera import catalog
from tessera.operators import similar
from tessera.plans import intake, text_index
from tests import oracle


def against_sql(spark, folder, name, **tables):
    """A query over small tables of its own against its SQL."""
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    found = oracle.rows(catalog.QUERIES[name](spark, str(folder)).toPandas())
    assert found == oracle.rows(con.execute(catalog.ORACLES[name]).fetchdf())
    return found[1]


def test_last_section_ends_with_its_text(spark, tmp_path):
    texts = [*(("ab " * 100)[:n] for n in range(138, 156)), "x" * 140, None, ""]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    assert against_sql(spark, tmp_path, "section_spelled", documents=docs)


def test_all_like_vectors_are_found_with_little_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(similar, "TILE", 64)
    monkeypatch.setattr(similar, "_SLICE", 10)
    rng = np.random.default_rng(5)
    near = rng.normal(size=24) + rng.normal(size=(500, 24)) * 0.1  # one block to hyperplanes, most pairs above the limit
    rows = [*near, *rng.normal(size=(40, 24)), near[0]]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "k long, v array<double>")
    unit = np.array([v / np.linalg.norm(v) for v in rows[:-1]])
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(np.round(unit @ unit.T, 6) > 0.99, 1)), strict=True)}
    pairs = similar.near_pairs(frame, "k", "v", 0.99, miss=0)[0]
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10_000
    assert similar.near_pairs(frame.limit(0), "k", "v", 0.99, miss=0)[0].collect() == []


def test_postings_move_once_a_token_and_like_texts_are_told_once(spark, tmp_path):
    # Before, 400 texts alike and every word of a text moved; the first five by id are all that can come.
    texts = [(i, "net sales of the year, sales up") for i in range(400)] + [(1000 + i, f"net cash {i} of sales") for i in range(9)] + [(5000, "Sales"), (5001, None), (None, "sales")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = text_index.create(docs, str(tmp_path / "index"))
    posted = spark.read.parquet(f"{index.at}/segments/*/postings").where("doc_id = 7").select("token", "tf", "dl", "positions").collect()
    assert sorted(map(tuple, posted)) == [("net", 1, 7, [0]), ("of", 1, 7, [2]), ("sales", 2, 7, [1, 5]), ("the", 1, 7, [3]), ("up", 1, 7, [6]), ("year", 1, 7, [4])]
    asked = spark.createDataFrame([(1, 'sales OR "net cash"'), (2, "net NOT up"), (3, "cash AND sales"), (4, '"net sales" -cash')], "query_id long, query string")
    best = index.search_many(asked, 5)
    met = [r["doc_id"] for r in best.where("query_id = 4").orderBy("rank").collect()]
    assert met == [0, 1, 2, 3, 4]
    assert sorted(r["doc_id"] for r in best.where("query_id = 2").collect()) == [1000, 1001, 1002, 1003, 1004]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "nth" in plan


def test_intake_keeps_no_second_copy(spark, tmp_path):
    files = spark.createDataFrame([("a", "1", bytearray(b"Words on a thing.")), ("b", "2", bytearray(b"\xff")), ("c", "3", bytearray(b" "))], "path string, hash string, content binary")
    index = intake.take_in(intake.create(spark, str(tmp_path / "index")), files, "text")
    assert {p.name for p in (tmp_path / "index" / "intake").glob("*/*")} == {"quarantine"}
    assert [r["path"] for r in index.chunks().collect()] == ["a"]
    assert sorted(r["path"] for r in intake.quarantine(index).collect()) == ["b", "c"]
