"""Alert life cycle: cooldown, routing, priorities, sinks, delivery state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewatch.functions.stats import severity_rank
from tapewatch.params import Channel


def apply_cooldown(alerts: DataFrame, cooldown_seconds: float, history: DataFrame | None = None) -> DataFrame:
    """Drops alerts of a key that follow an emitted one within the cooldown and are not more severe.

    alerts: dedup_key, timestamp_ms, sequence, severity, optional bypass, and further columns. Dropped rows do not move
    the clock, bypassing rows are emitted and do. An empty or null key is never held back. history (dedup_key,
    timestamp_ms, severity) seeds the clocks. Each key's decisions follow from earlier decisions, so a key's times and
    ranks (not its other columns) stream through one fold in order, none are gathered; the rows are then joined back.
    """
    base = alerts if "bypass" in alerts.columns else alerts.withColumn("bypass", F.lit(False))
    keyed = F.coalesce(F.col("dedup_key"), F.lit("")) != ""
    small = base.where(keyed).select("dedup_key", "timestamp_ms", "sequence", severity_rank(F.col("severity")).alias("rank"), F.coalesce("bypass", F.lit(False)).alias("bypass"), F.lit(True).alias("real"))
    if history is not None:
        small = small.unionByName(history.where(keyed).select("dedup_key", "timestamp_ms", F.lit(-1).cast("long").alias("sequence"), severity_rank(F.col("severity")).alias("rank"), F.lit(True).alias("bypass"), F.lit(False).alias("real")))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at, best = None, None, -1
        for rows in batches:
            out = []
            for key, ms, sequence, rank, bypass, real in rows.itertuples(index=False):
                if key != now:
                    now, at, best = key, None, -1
                if at is not None and not bypass and rank <= best and (ms - at) / 1000.0 < cooldown_seconds:
                    continue
                at, best = ms, rank
                if real:
                    out.append((key, ms, sequence))
            yield pd.DataFrame(out, columns=["dedup_key", "timestamp_ms", "sequence"])

    ordered = small.repartition("dedup_key").sortWithinPartitions("dedup_key", "timestamp_ms", "sequence", "rank", "bypass", "real")
    emitted = ordered.mapInPandas(fold, "dedup_key string, timestamp_ms long, sequence long").distinct()
    return alerts.join(emitted, ["dedup_key", "timestamp_ms", "sequence"], "left_semi").unionByName(alerts.where(~keyed))


def restore_cooldown(history: DataFrame, now_ms: int) -> DataFrame:
    """Seeds for apply_cooldown: the last emitted row of each key, not later than now."""
    last = history.where(F.coalesce("dedup_key", F.lit("")) != "").groupBy("dedup_key").agg(F.max_by(F.struct("timestamp_ms", "severity"), "timestamp_ms").alias("x"))
    return last.select("dedup_key", F.least("x.timestamp_ms", F.lit(now_ms)).alias("timestamp_ms"), "x.severity")


def release_failed_cooldown(history: DataFrame, jobs: DataFrame) -> DataFrame:
    """Seeds without keys whose newest local delivery failed; a success counts from its own time, if that is later."""
    latest = jobs.groupBy("original_dedup_key").agg(F.max_by("status", "updated_ms").alias("status"), F.max("updated_ms").alias("updated_ms")).withColumnRenamed("original_dedup_key", "dedup_key")
    met = history.join(latest, "dedup_key", "left").where(F.coalesce(F.col("status") != "failure", F.lit(True)))
    return met.select("dedup_key", F.when(F.col("status") == "success", F.greatest("timestamp_ms", "updated_ms")).otherwise(F.col("timestamp_ms")).alias("timestamp_ms"), "severity")


def route(alerts: DataFrame, channels: list[Channel]) -> DataFrame:
    """One outbox row for each alert and enabled channel whose least severity it reaches."""
    ranks = {"info": 0, "warning": 1, "critical": 2}
    on = [c for c in channels if c.enabled]
    if not on:
        return alerts.withColumn("channel", F.lit("")).where(F.lit(False))
    options = F.array(*(F.struct(F.lit(c.name).alias("channel"), F.lit(ranks[c.min_severity]).alias("least")) for c in on))
    open_to = F.filter(options, lambda c: c["least"] <= severity_rank(F.col("severity")))
    return alerts.withColumn("__c", F.explode(open_to)).withColumn("channel", F.col("__c.channel")).drop("__c")


def pending_order(jobs: DataFrame, capacity: int) -> DataFrame:
    """The jobs that fit the queue: critical ones (priority 0) first, then by sequence; numbered from 1."""
    ranked = jobs.withColumn("priority", F.when(F.col("severity") == "critical", 0).otherwise(1)).orderBy("priority", "sequence").limit(capacity)
    return ranked.withColumn("position", F.row_number().over(Window.orderBy("priority", "sequence")))  # at most `capacity` rows


def sample_metrics(metrics: DataFrame, every_seconds: int = 30) -> DataFrame:
    """Snapshots of the first tick and then of each tick at least `every_seconds` after the last one kept.

    One clock runs over all days. For each day, and each tick at which its choice may start, the last tick kept is
    worked out; a fold over these few rows a day tells where each day starts.
    """
    every = every_seconds * 1000
    day = F.floor(F.col("timestamp_ms") / 86_400_000)
    ticks = metrics.select(day.alias("day"), "timestamp_ms").distinct()

    def options(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["timestamp_ms"].to_numpy())
        after = np.searchsorted(t, t + every)
        rows = []
        for k in range(min(len(t), int(np.searchsorted(t, t[0] + every)) + 1)):
            last = k
            while after[last] < len(t):
                last = after[last]
            rows.append((int(pdf["day"].iloc[0]), int(t[k]), int(t[last])))
        return pd.DataFrame(rows, columns=["day", "start", "last"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, at = [], None
        for d, own in pdf.sort_values(["day", "start"]).groupby("day"):
            fit = own if at is None else own[own["start"] >= at + every]
            if len(fit):
                rows.append((int(d), int(fit["start"].iloc[0])))
                at = int(fit["last"].iloc[0])
        return pd.DataFrame(rows, columns=["day", "start"])

    def kept(key: tuple, own: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(begin):
            t = np.sort(own["timestamp_ms"].to_numpy())
            k = int(np.searchsorted(t, begin["start"].iloc[0]))
            while k < len(t):
                out.append(int(t[k]))
                k = int(np.searchsorted(t, t[k] + every))
        return pd.DataFrame({"timestamp_ms": pd.Series(out, dtype="int64")})

    found = ticks.groupBy("day").applyInPandas(options, "day long, start long, last long")
    starts = found.withColumn("all", F.lit("all")).groupBy("all").applyInPandas(fold, "day long, start long")  # a few rows a day
    chosen = ticks.groupBy("day").cogroup(starts.groupBy("day")).applyInPandas(kept, "timestamp_ms long")
    return metrics.join(chosen, "timestamp_ms", "left_semi")


def latest_per_key(old: DataFrame | None, new: DataFrame, keys: list[str], version: str = "sequence") -> DataFrame:
    """Upsert: of all rows with a key the one of the highest version stays."""
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def sink(spark: SparkSession, new: DataFrame, path: str, keys: list[str], version: str, day_of: str = "timestamp_ms") -> None:
    """Upserts a batch into a Parquet table partitioned by day; only the days that the batch touches are rewritten."""
    new = new.withColumn("day", F.to_date(F.timestamp_millis(F.col(day_of))))
    days = [r["day"] for r in new.select("day").distinct().collect()]
    if not days:
        return
    try:
        old = spark.read.parquet(path).where(F.col("day").isin(days))
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = None
    merged = latest_per_key(old, new, keys, version).checkpoint() if old is not None else latest_per_key(None, new, keys, version)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def sink_receipts(receipts: DataFrame, path: str | None = None) -> DataFrame:
    """Receipts cut to their lengths, attempts at least 0; appended to a table if a path is given."""
    cut = receipts.withColumns({"alert_id": F.substring("alert_id", 1, 100), "channel": F.substring("channel", 1, 40), "status": F.substring("status", 1, 40), "detail": F.substring("detail", 1, 500), "attempt": F.greatest("attempt", F.lit(0))})
    if path:
        cut.write.mode("append").parquet(path)
    return cut


STATUSES = ["queued", "attempt", "success", "failure"]


def job_state(transitions: DataFrame) -> DataFrame:
    """The newest transition of each alert's job; unknown statuses are rejected, priorities kept within 0 and 100.

    The stored key is blank until the delivery succeeds.
    """
    ok = transitions.where(F.col("status").isin(STATUSES)).withColumn("priority", F.least(F.greatest("priority", F.lit(0)), F.lit(100)))
    last = ok.groupBy("alert_id").agg(F.max_by(F.struct("priority", "original_dedup_key", "status", "attempt", "updated_ms"), F.struct("updated_ms", "attempt")).alias("j"))
    return last.select("alert_id", "j.*", F.when(F.col("j.status") == "success", F.col("j.original_dedup_key")).otherwise("").alias("dedup_key"))


def channel_outcome(transitions: DataFrame) -> DataFrame:
    """Newest terminal transition of each channel."""
    done = transitions.where(F.col("status").isin("success", "failure"))
    return done.groupBy("channel").agg(F.max_by("status", "updated_ms").alias("status"), F.max_by("alert_id", "updated_ms").alias("alert_id"), F.max("updated_ms").alias("updated_ms"))


def receipt_counts(receipts: DataFrame) -> DataFrame:
    """Per channel: receipts by status, the newest receipt and the newest terminal outcome."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    terminal = F.when(F.col("status").isin("success", "failure"), F.col("timestamp_ms"))
    return receipts.groupBy("channel").agg(*(count(s) for s in STATUSES), F.max("timestamp_ms").alias("last_ms"), F.max_by("status", F.struct("timestamp_ms", "id")).alias("last_status"), F.max_by("status", F.when(terminal.isNotNull(), F.struct("timestamp_ms", "id"))).alias("last_outcome"))
