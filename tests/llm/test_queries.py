import pytest

from tests import oracle

pytestmark = pytest.mark.skipif(not oracle.DATA.exists(), reason="no tables here")


@pytest.mark.parametrize("name", ["op4_quality_rules", "op6_chat_formatting", "op7_url_filters", "op10_line_dedup", "op11_hard_negative_mining", "op12_conversation_repair", "op13_ngram_jaccard_join"])
def test_query_matches_its_sql(spark, name):
    from tessera.llm import queries

    oracle.check(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_pipeline_equals_its_stages(spark):
    """run() gives what the stages give one by one, and its rows are whole packed documents."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(oracle.DATA)).toPandas(), docs.schema)
        assert docs.columns == columns, name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert before is None or ids <= before
        before = ids
    packed = corpus_pipeline.run(spark, str(oracle.DATA)).collect()
    assert {r["doc_id"] for r in packed} == before
    assert len({r["sequence_id"] for r in packed}) <= 1.05 * sum(r["length"] for r in packed) / 1024 + 1


def test_entry_lists_all():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
