"""The stages on a small table: each decision takes effect and clean documents stay."""

import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.count()
        assert 0 < rows <= docs.count() and (name != "secrets" or rows == docs.count()), name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.where("start = 0").count() == docs.count()
