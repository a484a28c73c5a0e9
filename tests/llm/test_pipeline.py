import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    from vectorloom.llm.scratch import cut

    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = cut(stage(spark, docs, SF))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids, name
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        if name == "personal_data":
            assert now == before and docs.where("text rlike '@mail[0-9]'").count() == 0
        ids = before = now
    assert docs.columns == ["doc_id", "n_tokens", "ids"] and docs.where("size(ids) <> n_tokens").count() == 0


def test_near_copies_go(spark):
    from tests.llm.util import components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want, sets = components(texts, 80)
    kept = {r.doc_id for r in pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == {i for i in texts if want[i] == i or not sets[i]}
