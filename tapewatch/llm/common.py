"""What the corpus operators share: the shared folder, tables cut from their lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a new temporary folder in local mode; on a cluster that is an error, as executors would not share it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tapewatch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/tapewatch/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: later steps survive lost executors and reuse the rows."""
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables below the shared folder that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that operators have left in the shared folder, of this session and of earlier ones.

    Results read these tables, so call it once they are written or collected.
    """
    removed(spark, f"{shared_folder(spark)}/tapewatch")


def write_files(df: DataFrame, path: str, ordered: bool = False) -> None:
    """Writes rows (seg int, k long, data binary) as files of raw bytes, each datum followed by a zero byte.

    Every task writes one file for each of its values of seg, so that whoever numbers them bounds a file's bytes; if
    `ordered`, by k in each file. Spark's text writer does it, so its commit protocol covers the files; it passes the
    bytes of a string on as they are, whether they are UTF-8 or not.
    """
    rows = df.sortWithinPartitions("seg", "k") if ordered else df
    rows.select("seg", F.col("data").cast("string").alias("value")).write.partitionBy("seg").option("lineSep", "\0").text(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of_id(column: str, n: int):
    """crc32 of the id's decimal text, modulo n; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (u, v).

    Returns (node, label), label being the smallest node of the component, for every node that occurs in an
    edge. Each round lets every node, and its parent, adopt the smallest grandparent in its neighbourhood, then
    shortens paths; rounds grow with the logarithm of the diameter. Tables are written to the shared folder after
    each round. A null endpoint takes no part.
    """
    spark = edges.sparkSession
    edges = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    both = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    at = scratch(spark, "parent")
    first = both.groupBy("u").agg(F.min("v").alias("p")).select(F.col("u").alias("node"), F.least("u", "p").alias("p"))
    parent = written(first, "parent", at)
    for _ in range(max_rounds):
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("g"))
        grand = parent.join(up, "p").select("node", "p", "g")
        seen = both.join(grand.select(F.col("node").alias("v"), F.col("g").alias("seen")), "v")
        least = seen.groupBy(F.col("u").alias("node")).agg(F.min("seen").alias("m"))
        step_at, new_at = scratch(spark, "step"), scratch(spark, "parent")
        step = written(grand.join(least, "node").select("node", "p", F.least("g", "m").alias("m")), "step", step_at)
        hooked = step.groupBy(F.col("p").alias("node")).agg(F.min("m").alias("h"))
        new = step.join(hooked, "node", "left").select("node", "p", F.least("m", F.coalesce("h", "m")).alias("q"))
        new = written(new, "parent", new_at)
        removed(spark, at, step_at)  # the new table holds all that later rounds read
        parent, at = new.select("node", F.col("q").alias("p")), new_at
        if new.where("p <> q").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return parent.select("node", F.col("p").alias("label"))


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, a narrow table, marked as one to send to all tasks if it has at most so many rows; else joins deal both sides."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else dealt(df)


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of joins that deal both sides.

    Spark takes an exploded table for as large as what it was exploded from, a list for one value and a written table for
    its compressed bytes, and would send tables to all tasks that the driver cannot hold.
    """
    return df.hint("merge")


def surplus(named: DataFrame) -> DataFrame:
    """(__row) of rows (__row, id, label) that are copies: of each label the document with the smallest id stays.

    Rows that share an id count as one document and stay or go together. A row without an id is a document of its own;
    where a label has no id at all, its first row stays.
    """
    best = named.groupBy("label").agg(F.min("id").alias("least"), F.min("__row").alias("first"))
    marked = named.join(best, "label").withColumn("stays", F.when(F.col("least").isNull(), F.col("__row") == F.col("first")).otherwise(F.coalesce(F.col("id") == F.col("least"), F.lit(False))))
    marked = written(marked.select("__row", "id", "stays"), "marked")
    stay = marked.where("stays and id is not null").select("id").distinct()
    return written(marked.where("not stays").join(stay, "id", "left_anti").select("__row"), "copies")


def widened(df: DataFrame, **columns: str) -> StructType:
    """The schema of df with further columns."""
    return reduce(lambda s, c: s.add(*c), columns.items(), StructType(list(df.schema.fields)))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns of these names; Spark does not tell upper from lower case, so neither does this."""
    gone = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in gone))


@cache
def _fold() -> np.ndarray:
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def letters(text: str) -> np.ndarray:
    """For each character its lower-case letter as a code point, or 0 where it is no letter."""
    return _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
