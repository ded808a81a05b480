from pyspark.sql import functions as F

import corpus_pipeline
from tapewatch.llm import pii


def test_overlapping_spans_are_masked_to_the_end(spark):
    text = "call +1 555 123 4567bob@x.com or a b"
    spans = "array(named_struct('kind', 0, 'start', 5L, 'stop', 20L), named_struct('kind', 1, 'start', 16L, 'stop', 29L), named_struct('kind', 1, 'start', 6L, 'stop', 9L))"
    got = spark.createDataFrame([(text,)], "text string").select(pii.masked(F.col("text"), F.expr(spans)).alias("m")).first().m
    assert got == f"call <{pii.KINDS[0]}><{pii.KINDS[1]}> or a b"


def test_contaminated_rows_without_an_id_go(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, item), (None, "plain words"), (3, item), (3, "other words"), (4, "more words")], "doc_id long, text string")
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(r.text for r in got) == ["more words", "plain words"]
