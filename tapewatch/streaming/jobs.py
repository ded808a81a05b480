"""Structured Streaming jobs: bucket stream, deduplication, detection per micro-batch, cooldown with state.

Spark's watermark is one for the whole stream, not one per series: a fast venue can make a slow one's trades late.
The delay is the retention, so this rarely happens; exact lateness per series is the batch operator drop_late.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.stats import severity_rank
from tapewatch.operators.events import SERIES, bucket_columns


def with_event_time(trades: DataFrame, delay: str = "75 minutes") -> DataFrame:
    """Adds event_ts (a real timestamp, as watermarks ask for) and the watermark."""
    return trades.withColumn("event_ts", F.timestamp_millis("timestamp_ms")).withWatermark("event_ts", delay)


def dedup_stream(trades: DataFrame, keys: list[str] | None = None, delay: str = "75 minutes") -> DataFrame:
    """Drops repeated ids within the watermark delay; rows without an id pass. The horizon is the delay, not 120 s."""
    named = F.col("event_id").isNotNull() & (F.col("event_id") != "")
    ready = trades if "event_ts" in trades.columns else with_event_time(trades, delay)
    return ready.where(named).dropDuplicatesWithinWatermark([*(keys or SERIES), "event_id"]).unionByName(ready.where(~named))


def bucket_stream(trades: DataFrame, bucket_seconds: int = 5, delay: str = "75 minutes") -> DataFrame:
    """Final buckets in append mode; grouped by a time window, so that the watermark frees their state."""
    ready = trades if "event_ts" in trades.columns else with_event_time(trades, delay)
    w = F.window("event_ts", f"{bucket_seconds} seconds")
    return ready.groupBy(*SERIES, w.alias("w")).agg(*bucket_columns()).withColumn("start_ms", F.unix_millis("w.start")).drop("w")


def start_bucket_job(trades: DataFrame, path: str, checkpoint: str, bucket_seconds: int = 5, delay: str = "75 minutes", **trigger):
    """Writes finished buckets as Parquet; exactly once, by the sink's log and the checkpoint."""
    out = bucket_stream(trades, bucket_seconds, delay)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def start_detection_job(buckets: DataFrame, history: Callable[[], DataFrame], detect: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, retention_seconds: int = 4500, **trigger):
    """For each micro-batch of buckets, runs the batch rules over the trailing retention and hands alerts of new ticks to the sink.

    history gives the bucket table; detect is the batch detection. Alert ids follow from key and tick, so that a
    repeated batch upserts the same rows.
    """

    def batch(new: DataFrame, number: int) -> None:
        new = new.persist()
        try:
            lo, hi = new.agg(F.min("start_ms"), F.max("start_ms")).first()
            if lo is None:
                return
            trailing = history().where(F.col("start_ms").between(lo - retention_seconds * 1000, hi)).unionByName(new).dropDuplicates([*SERIES, "start_ms"])
            sink(detect(trailing).where(F.col("timestamp_ms") >= lo), number)
        finally:
            new.unpersist()

    return buckets.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def cooldown_stream(alerts: DataFrame, cooldown_seconds: float) -> DataFrame:
    """apply_cooldown over a stream: the time and rank last emitted are kept per key. Alerts need a key, timestamp_ms, sequence, severity.

    Rows of one micro-batch are taken in time order; an alert older than one handled in an earlier batch is judged
    against the state as it is then.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, best = state.get if state.exists else (None, -1)
        out = []
        for r in pd.concat(list(parts)).sort_values(["timestamp_ms", "sequence"]).itertuples(index=False):
            if at is not None and r.rank <= best and (r.timestamp_ms - at) / 1000 < cooldown_seconds:
                continue
            at, best = int(r.timestamp_ms), int(r.rank)
            out.append((key[0], at, int(r.sequence), r.severity))
        if at is not None:
            state.update((at, best))
        yield pd.DataFrame(out, columns=["dedup_key", "timestamp_ms", "sequence", "severity"])

    rows = alerts.select("dedup_key", "timestamp_ms", "sequence", "severity", severity_rank(F.col("severity")).alias("rank"))
    return rows.groupBy("dedup_key").applyInPandasWithState(step, "dedup_key string, timestamp_ms long, sequence long, severity string", "at long, best int", "append", "NoTimeout")
