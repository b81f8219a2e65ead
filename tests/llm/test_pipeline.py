import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from marginalia.llm import common, pii

    docs = common.documents(spark, SF)
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()} <= ids
        if name == "quality":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) >= 0.95 * len(good)
        if name == "near_copies":
            assert docs.count() == docs.select("doc_id").distinct().count() < before.count()
        if name == "personal_data":
            assert pii.with_base(docs).where("size(email) + size(ip) + size(card) > 0").count() == 0
            assert docs.count() == before.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.where("size(ids) <> n_tokens").count() == 0
    assert last.dtypes == corpus_pipeline.run(spark, SF).dtypes


def test_empty(spark):
    from marginalia.llm import common

    docs = common.documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_rows_without_ids_keep_their_own_shares(spark):
    from marginalia.llm import mixing

    rows = [(None, f"w{i} x y z", "en", s, 8) for s in ("a", "b", "c") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {r.source: r.taken for r in mixing.mix(docs).groupBy("source").agg({"taken": "sum"}).toDF("source", "taken").collect()}
    got = {}
    for r in corpus_pipeline.mixture(spark, docs, SF).collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == want
