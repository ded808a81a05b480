import pytest

from tapewatch.llm import langid


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_few_labelled_rows(spark, n):
    rows = [(i, f"the quick brown fox number {i} runs", "en") for i in range(n)] + [(90, "123 456", "en"), (91, None, "en"), (92, "some words", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "the brown fox"), (2, "77"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert (got[2], got[3], got[4]) == ("und",) * 3
    if n:
        assert got[1] == "en"
