import corpus_pipeline
from tapewatch.llm.common import written


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    lines = ["der zug fährt am morgen nach haus und niemand sieht ihn dort am see", "the river runs along the old town where people walk in the evening light"]
    rows = [(k, f"{lines[k % 2]} number {k} and " + " ".join(f"word{k}x{j}" for j in range(30)), ("de", "en")[k % 2], "s", 100) for k in range(40)]
    rows += [(100, rows[4][1], "de", "s", 100), (101, "12 34 !!", None, "s", 8), (102, None, None, None, None), (103, rows[7][1] + " write to a@b.co", "en", "t", 5), (104, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "t", 5), (None, "a text without an id of its own in the evening light", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, folder), "t")
        assert now.columns == docs.columns
        seen[name] = {r.doc_id: r for r in now.collect()}
    first, dedup, clean, masked = seen.values()
    assert 101 not in first and 102 not in first and None in first and len(first) == 44
    assert 100 not in dedup and 4 in dedup and None in dedup
    assert 104 in dedup and 104 not in clean
    assert "write to <email>" in masked[103].text and masked[103].n_chars == len(masked[103].text) if 103 in masked else True
    assert masked[0].text == rows[0][1] and masked[0].n_chars == 100
    packed = corpus_pipeline.run(spark, folder)
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0
    assert packed.select("doc_id").distinct().count() == len(masked)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "PII", "packing"]
