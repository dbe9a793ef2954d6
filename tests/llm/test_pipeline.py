"""The pipeline's stages on the awkward documents and on a small table."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import DOCS, awkward_docs
from tests.llm.test_operators import _brute_components, _brute_hits


def test_stages_keep_columns_and_survive_awkward_rows(spark):
    docs = spark.createDataFrame(awkward_docs(), DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").where("exact").count() == docs.count()


def test_decisions_equal_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, sf_dir).collect()}
    assert kept == {d for d, (_, c) in _brute_components(rows, corpus_pipeline.SHINGLE).items() if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in corpus_pipeline.remove_benchmark_text(spark, docs, sf_dir).collect()}
    assert clean == {d for d, x in _brute_hits(rows, items).items() if not x[4]}


def test_run_returns_tokens_of_what_stays(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids", "exact"]
    assert out.where(~F.col("exact")).count() == 0 and out.count() > 100
