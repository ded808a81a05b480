"""Queries over the persisted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions.stats import finite


def _clamp(limit: int, most: int) -> int:
    return max(1, min(most, int(limit)))


def list_alerts(alerts: DataFrame, limit: int = 100) -> DataFrame:
    """The newest alerts (1 to 1000), newest first."""
    return alerts.orderBy(F.desc("timestamp_ms"), F.desc("sequence")).limit(_clamp(limit, 1000))


def recent_dedup(alerts: DataFrame, jobs: DataFrame, cutoff_ms: int, limit: int | None = 10_000) -> DataFrame:
    """Keys whose newest row since the cutoff restores a cooldown: emitted alerts do, local jobs only after success.

    An alert counts with its own time, a job with that of its last change. At equal times a row that does not restore
    goes first.
    """
    plain = alerts.where((F.col("dedup_key") != "") & (F.col("timestamp_ms") >= cutoff_ms)).select("dedup_key", "timestamp_ms", "severity", F.lit(1).alias("restores"))
    recent = jobs.where((F.col("original_dedup_key") != "") & (F.col("updated_ms") >= cutoff_ms))
    met = recent.join(alerts.select(F.col("id").alias("alert_id"), "severity"), "alert_id")
    local = met.select(F.col("original_dedup_key").alias("dedup_key"), F.col("updated_ms").alias("timestamp_ms"), "severity", (F.col("status") == "success").cast("int").alias("restores"))
    rows = plain.unionByName(local)
    if limit is not None:
        rows = rows.orderBy(F.desc("timestamp_ms"), "restores", "dedup_key").limit(limit)
    first = Window.partitionBy("dedup_key").orderBy(F.desc("timestamp_ms"), "restores")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1 and restores = 1").drop("__n", "restores")


def pending_alarms(jobs: DataFrame, alerts: DataFrame, limit: int = 100, exclude: DataFrame | None = None) -> DataFrame:
    """Open jobs with their alerts, by priority, then age of the job, then alert time; ids in `exclude` left out."""
    open_jobs = jobs.where(F.col("status").isin("queued", "attempt"))
    if exclude is not None:
        open_jobs = open_jobs.join(exclude.select("alert_id"), "alert_id", "left_anti")
    met = open_jobs.join(alerts.select(F.col("id").alias("alert_id"), "timestamp_ms", "severity", "title"), "alert_id")
    return met.orderBy("priority", "updated_ms", "timestamp_ms", "alert_id").limit(_clamp(limit, 1000))


def list_metrics(metrics: DataFrame, symbol: str | None = None, exchange: str | None = None, window_seconds: int | None = None, since_ms: int | None = None, limit: int = 500) -> DataFrame:
    """The newest metrics (1 to 5000) that meet all given filters, oldest first. Filters reach the scan."""
    for name, value in (("symbol", symbol), ("exchange", exchange), ("window_seconds", window_seconds)):
        if value is not None:
            metrics = metrics.where(F.col(name) == value)
    if since_ms is not None:
        metrics = metrics.where(F.col("timestamp_ms") >= since_ms)
    tie = ["exchange", "symbol", "window_seconds"]
    return metrics.orderBy(F.desc("timestamp_ms"), *tie).limit(_clamp(limit, 5000)).orderBy("timestamp_ms", *tie)


def list_receipts(receipts: DataFrame, alert_id: str | None = None, limit: int = 200) -> DataFrame:
    if alert_id is not None:
        receipts = receipts.where(F.col("alert_id") == alert_id)
    return receipts.orderBy(F.desc("timestamp_ms"), F.desc("id")).limit(_clamp(limit, 2000))


def latest_outcome(receipts: DataFrame, channel: str | None = None) -> DataFrame:
    """Newest success or failure, of one channel or of each."""
    done = receipts.where(F.col("status").isin("success", "failure"))
    if channel is not None:
        done = done.where(F.col("channel") == channel)
    last = done.groupBy("channel").agg(F.max_by(F.struct("id", "alert_id", "timestamp_ms", "status", "attempt", "detail"), F.struct("timestamp_ms", "id")).alias("r"))
    return last.select("channel", "r.*")


def latest_local_outcome(outcomes: DataFrame, jobs: DataFrame) -> DataFrame:
    """The stored local outcome, or without one the newest terminal job: at most one row (alert_id, status, updated_ms)."""
    cols = ["alert_id", "status", "updated_ms"]
    rows = outcomes.select(F.lit(0).alias("__p"), *cols).unionByName(jobs.where(F.col("status").isin("success", "failure")).select(F.lit(1).alias("__p"), *cols))
    return rows.orderBy("__p", F.desc("updated_ms"), "alert_id").limit(1).drop("__p")


def prune(df: DataFrame, cutoff_ms: int) -> tuple[DataFrame, DataFrame]:
    """(kept, removed count) of rows older than the cutoff; for metrics and receipts, never alerts."""
    old = F.col("timestamp_ms") < cutoff_ms
    return df.where(~old), df.agg(F.count_if(old).alias("removed"))


def change_feed(alerts: DataFrame, cursor: str | None, epoch: str, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows, state) after a cursor `epoch:sequence`.

    Sequences are given anew at each upsert, so a rewritten alert comes again. The reset reason is
    source_restarted for another epoch, source_history_reset for a cursor beyond the newest row and
    source_history_gap where rows after the cursor are gone; a reset starts from the oldest row.
    """
    limit = _clamp(limit, 200)
    seen_epoch, _, seen = (cursor or "").partition(":")
    at = int(seen) if seen.isdigit() else 0
    lo, hi = alerts.agg(F.min("sequence"), F.max("sequence")).first()
    reason = None
    if cursor:
        if seen_epoch != epoch:
            reason = "source_restarted"
        elif at > (hi or 0):
            reason = "source_history_reset"
        elif lo is not None and at + 1 < lo:
            reason = "source_history_gap"
    start = 0 if reason else at
    after = alerts.where(F.col("sequence") > start).orderBy("sequence").limit(limit + 1)
    numbered = after.withColumn("__n", F.row_number().over(Window.orderBy("sequence")))  # at most limit + 1 rows
    rows = numbered.where(F.col("__n") <= limit).drop("__n")
    state = numbered.agg(F.coalesce(F.max(F.when(F.col("__n") <= limit, F.col("sequence"))), F.lit(start)).alias("next"), (F.count("*") > limit).alias("has_more"))
    return rows, state.select(F.concat_ws(":", F.lit(epoch), "next").alias("cursor"), "has_more", F.lit(reason).cast("string").alias("reset_reason"))


def alert_kind(own_source: str = "detector") -> Column:
    """test, monitoring, external (of another source than `own_source`) or market, looked at in this order."""
    c = F.substring("category", 1, 80)
    monitoring = c.isin("monitoring_gap", "feed_health", "runtime_health") | F.coalesce(F.col("symbol") == "SYSTEM", F.lit(False))
    external = F.coalesce(F.col("source") != own_source, F.lit(True))
    return F.when(c == "system_test", "test").when(monitoring, "monitoring").when(external, "external").otherwise("market")


def feed_metadata(status: DataFrame) -> DataFrame:
    """Bounded view of feed status: texts cut, ages only if finite and not negative, time as ISO text."""
    number = lambda c: F.when(finite(F.col(c)) & (F.col(c) >= 0), F.col(c)).alias(c)
    iso = F.date_format(F.timestamp_millis(F.col("timestamp_ms")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return status.select(F.substring("exchange", 1, 40).alias("exchange"), "connected", "subscription_acknowledged", number("message_age_seconds"), iso.alias("time"))


def filter_alerts(alerts: DataFrame, symbol: str | None = None, venue: str | None = None, severity: str | None = None, category: str | None = None, since_ms: int | None = None, until_ms: int | None = None, text: str | None = None) -> DataFrame:
    """Alerts that meet all given filters; the text is looked for in title and message, in any case."""
    for name, value in (("symbol", symbol), ("severity", severity), ("category", category)):
        if value is not None:
            alerts = alerts.where(F.col(name) == value)
    if venue is not None:
        alerts = alerts.where(F.array_contains("exchanges", venue))
    if since_ms is not None:
        alerts = alerts.where(F.col("timestamp_ms") >= since_ms)
    if until_ms is not None:
        alerts = alerts.where(F.col("timestamp_ms") <= until_ms)
    if text is not None:
        alerts = alerts.where(F.lower(F.concat_ws(" ", "title", "message")).contains(text.lower()))
    return alerts


def export(alerts: DataFrame, path: str, fmt: str = "csv") -> None:
    """Writes a filtered set as CSV (with header; lists as joined text) or JSON lines."""
    if fmt == "csv":
        alerts.withColumn("exchanges", F.array_join("exchanges", ",")).write.option("header", True).csv(path)
    elif fmt == "json":
        alerts.write.json(path)
    else:
        raise ValueError(f"unknown format {fmt}")
