"""The pipeline's stages on the small tables: each keeps what it should."""

import corpus_pipeline
from test_similar import firsts
from kinspark.llm import exact_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
        if name == "exact_dedup":
            assert ids(docs) == {r.doc_id for r in exact_dedup.exact_dedup(before).filter("kept").collect()}
        if name == "simhash_near_dedup":
            assert ids(docs) == firsts([(r.doc_id, r.text) for r in before.collect()])
        if name in ("secret_scan", "packing"):
            assert ids(docs) == ids(before)
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0
