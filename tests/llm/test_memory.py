"""What the pipeline's last stage takes at a time."""

import corpus_pipeline
from weir.llm import bpe


def test_the_tokenizer_takes_a_megabyte_at_a_time_and_gives_the_same(spark, monkeypatch):
    asked = []
    plain = bpe.round_trip
    monkeypatch.setattr(bpe, "round_trip", lambda *args, **options: asked.append(options) or plain(*args, **options))
    docs = spark.createDataFrame([(k, f"text {k} of some words, \n and  more" * (k % 7)) for k in range(600)], "doc_id long, text string").coalesce(1)
    got = {tuple(r) for r in corpus_pipeline.tokenize(spark, docs, "").collect()}
    assert asked[0].get("rows", bpe.ROWS) <= 256 and asked[0].get("size", bpe.SLICE_BYTES) <= 1 << 20
    monkeypatch.setattr(corpus_pipeline, "TOKENIZED", {})
    assert got == {tuple(r) for r in corpus_pipeline.tokenize(spark, docs, "").collect()} and len(got) == 600
