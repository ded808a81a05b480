"""Raw frames and evidence logs as tables or streams, always with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch import schemas
from tapewatch.functions.series import by_time, scanned


#: Records of one chunk of a topic's partition, and milliseconds of one chunk of all partitions.
OFFSETS, ARRIVED_MS = 1 << 20, 60_000


def kafka_frames(records: DataFrame, streaming: bool = False) -> DataFrame:
    """Frames of Kafka records (value, timestamp, topic, partition, offset), numbered in order of arrival.

    Records of a partition arrive in the order of their offsets, at the newest time stamp so far; those of several
    partitions are put in order by that time, then topic, partition and offset, and numbered from 0 without gaps, chunk by
    chunk. A stream cannot number what is still to come: there the number is unique among partitions of one topic (up to
    65,536 of them) and ascends within each.
    """
    stamp = F.unix_millis("timestamp")
    rows = records.select(
        F.col("value").cast("string").alias("frame"), stamp.alias("received_wall_ms"), (stamp / 1000.0).alias("received_monotonic_s"),
        F.lit(0).cast("long").alias("continuity_generation"), "topic", "partition", F.col("offset").cast("long").alias("offset"),
    )
    if streaming:
        rows = rows.withColumn("arrival_seq", F.shiftleft("offset", 16) + F.col("partition"))
    else:
        keys, chunk = ["topic", "partition"], F.floor(F.col("offset") / OFFSETS)
        rows = scanned(rows, keys, ["offset"], chunk, F.col("received_wall_ms"), "arrived_ms", how="max")
        order = ["arrived_ms", "topic", "partition", "offset"]
        rows = scanned(rows, [], order, by_time("arrived_ms", ARRIVED_MS), F.lit(1), "arrival_seq")
        rows = rows.withColumn("arrival_seq", F.col("arrival_seq") - 1)
    return rows.select("frame", "received_wall_ms", "received_monotonic_s", "continuity_generation", "arrival_seq")


def read_frames(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "json", **options: str) -> DataFrame:
    """Raw frames with their receipt stamps: one JSON object per row; JSON lines or Parquet files, a directory stream, or Kafka."""
    if fmt == "kafka":
        reader = (spark.readStream if streaming else spark.read).format("kafka").options(**options)
        return kafka_frames(reader.load(), streaming)
    reader = (spark.readStream if streaming else spark.read).schema(schemas.FRAME).options(**options)
    return reader.format(fmt).load(path)


def evidence_time(text: Column) -> Column:
    """Epoch milliseconds of an ISO time; naive times are UTC (the session's zone); null where it does not parse."""
    return F.unix_millis(F.try_to_timestamp(text))


def read_evidence(lines: DataFrame, since_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of a JSON-lines log with one text column `line`.

    Blank lines are skipped. Lines that are no JSON object or lack a valid timestamp are counted as invalid; `since`
    applies after that count. rows: timestamp_ms and the body as text, in time order.
    """
    text = lines.where(F.trim("line") != "").select("line", F.try_parse_json("line").isNotNull().alias("json"), evidence_time(F.get_json_object("line", "$.timestamp")).alias("timestamp_ms"))
    good = F.col("json") & F.trim("line").startswith("{") & F.col("timestamp_ms").isNotNull()
    counts = text.agg(F.count("*").alias("lines"), F.count_if(good).alias("valid"), F.count_if(~F.coalesce(good, F.lit(False))).alias("invalid"))
    rows = text.where(good)
    if since_ms is not None:
        rows = rows.where(F.col("timestamp_ms") >= since_ms)
    return rows.select("timestamp_ms", F.col("line").alias("body")).orderBy("timestamp_ms"), counts


def read_evidence_files(spark: SparkSession, path: str, since_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    return read_evidence(spark.read.text(path).withColumnRenamed("value", "line"), since_ms)
