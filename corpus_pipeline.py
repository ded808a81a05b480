"""From raw documents to packed training windows, as stages that can each be rerun.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm import decontaminate, langid, packing, pii, shingles, simhash
from tapewatch.llm.common import bucket_of_id, small, table, written
from tapewatch.llm.queries import tokenizer_file

#: A document is rejected if it has no letter, or if no language has this share of it.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: rejects documents without letters or without a leading language; rows keep their columns."""
    model = langid.fit(docs.where(bucket_of_id("doc_id", 5) != 0))
    found = langid.predict(docs, model, lang_out="__lang", score_out="__share")
    return found.where((F.col("__lang") != "und") & (F.col("__share") >= LEAST_SHARE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1, then five-word shingles at similarity 0.8 or more: of each component the document with the smallest id stays.

    What the SimHash operator puts together is verified on whole shingle sets, as three bits also link texts below 0.8.
    Near copies further than three bits apart meet by minima. Rows that share an id count as one document and stay or
    go together; a row without an id is a document of its own.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    own = written(shingles.sketched(rows), "sketches")
    met = simhash.linked_rows(own.select("__row", F.col("__fp").alias("fp")))
    gone = shingles.copies(rows, own, met=met)
    return rows.join(small(gone), "__row", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark item go, with all rows of their id; a row without an id by itself."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    held = written(decontaminate.held_items(rows, table(spark, sf_dir, "benchmark"), id_col="__row").select("__row").distinct(), "held")
    ids = written(rows.join(small(held), "__row", "left_semi").where("doc_id is not null").select("doc_id").distinct(), "held-ids")
    return rows.join(small(held), "__row", "left_anti").join(small(ids), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: spans of personal data are replaced by their kind; n_chars follows the text where it changes."""
    weights = pii.learn(pii.candidates(docs.select("text")))
    found = pii.accepted(pii.candidates(docs, out="__spans", keep_text=True), weights, "__spans")
    masked = found.withColumn("text", pii.masked(F.col("text"), F.col("__spans")))
    n_chars = F.when(F.size("__spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return masked.withColumn("n_chars", n_chars).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: windows of 2048 ids. Workers have run the other stages before, so they keep fewer pieces and read less at once."""
    return packing.pack_documents(docs, tokenizer_file(), window=2048, end_id=1, entries=250_000, batch=1 << 18)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", packed),
]

#: SQL expresses neither the mixture model nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
