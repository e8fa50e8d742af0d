"""The pipeline's stages against plain versions of themselves."""

import corpus_pipeline
from pyspark.sql import functions as F

from windgrid.llm import toxicity
from windgrid.llm.scratch import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "packing"]
    model = toxicity.train(docs, table(spark, sf, "labels"), ~toxicity.held_out(1, 3))
    want = {r["doc_id"] for r in docs.collect() if model.score(r["text"]) < toxicity.THRESHOLD}
    kept = corpus_pipeline.without_toxic(spark, docs, sf)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want
    good = corpus_pipeline.of_quality(spark, kept, sf)
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} <= want
    unique = corpus_pipeline.without_near_copies(spark, good, sf)
    assert unique.columns == docs.columns
    ids = {r["doc_id"] for r in unique.collect()}
    packed = corpus_pipeline.packed(spark, unique, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
