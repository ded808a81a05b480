"""Feed and market health over event logs and metric tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions.series import by_time, previous

FEED = ["exchange"]


def _age(now: Column, col: str) -> Column:
    return F.when(F.col(col).isNotNull(), F.round(F.greatest((now - F.col(col)) / 1000.0, F.lit(0.0)), 2))


def feed_counters(messages: DataFrame, feed_log: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(per feed, per feed and symbol): messages, trades, liquidations, newest message and its age.

    messages: exchange, symbol, kind (trade or liquidation), received_wall_ms. feed_log: exchange, kind (connect,
    reconnect, queue_drop, ...), timestamp_ms. Counts are of all messages; ages only of those since the last connect.
    """
    log = feed_log.groupBy("exchange").agg(F.max(F.when(F.col("kind").isin("connect", "reconnect"), F.col("timestamp_ms"))).alias("connected_ms"), F.count_if(F.col("kind") == "reconnect").alias("reconnects"), F.count_if(F.col("kind") == "queue_drop").alias("drops"))
    fresh = F.when(F.col("received_wall_ms") >= F.coalesce("connected_ms", F.lit(0)), F.col("received_wall_ms"))
    sums = [F.count("*").alias("messages"), F.count_if(F.col("kind") == "trade").alias("trades"), F.count_if(F.col("kind") == "liquidation").alias("liquidations"), F.max(fresh).alias("last_ms")]
    joined = messages.join(log.select("exchange", "connected_ms"), "exchange", "left")
    by_symbol = joined.groupBy("exchange", "symbol").agg(*sums)
    by_feed = by_symbol.groupBy("exchange").agg(*(F.sum(c).alias(c) for c in ("messages", "trades", "liquidations")), F.max("last_ms").alias("last_ms"))
    by_feed = log.join(by_feed, "exchange", "full").na.fill(0, ["messages", "trades", "liquidations", "reconnects", "drops"])
    now = F.lit(now_ms)
    return by_feed.withColumn("age_seconds", _age(now, "last_ms")), by_symbol.withColumn("age_seconds", _age(now, "last_ms"))


def feed_ages(by_symbol: DataFrame, configured: DataFrame) -> DataFrame:
    """Per feed: message_age (oldest symbol) if every configured symbol was seen since connect, else null; newest and oldest seen age."""
    all_pairs = configured.select("exchange", "symbol").distinct().join(by_symbol.select("exchange", "symbol", "age_seconds"), ["exchange", "symbol"], "left")
    return all_pairs.groupBy("exchange").agg(F.when(F.min(F.col("age_seconds").isNotNull()), F.max("age_seconds")).alias("message_age_seconds"), F.min("age_seconds").alias("latest_age_seconds"), F.max("age_seconds").alias("oldest_seen_age_seconds"), F.count_if(F.col("age_seconds").isNull()).alias("unseen"))


def subscription_status(expected: DataFrame, acked: DataFrame) -> DataFrame:
    """Per feed (topics as arrays): whether all expected topics are acknowledged, and those missing, sorted."""
    met = expected.select("exchange", F.col("topics").alias("want")).join(acked.select("exchange", F.col("topics").alias("got")), "exchange", "left")
    missing = F.array_sort(F.array_except("want", F.coalesce("got", F.array().cast("array<string>"))))
    return met.select("exchange", (F.size(missing) == 0).alias("subscription_acknowledged"), missing.alias("missing_topics"))


def feed_readiness(feeds: DataFrame, stale_seconds: float) -> DataFrame:
    """feeds: exchange, connected, subscription_acknowledged, open_break, message_age_seconds, unseen. Adds reasons and ready."""
    reasons = F.array_compact(F.array(
        F.when(~F.col("connected"), "disconnected"),
        F.when(~F.col("subscription_acknowledged"), "subscriptions not acknowledged"),
        F.when(F.col("open_break"), "waiting for fresh trades after a break"),
        F.when(F.col("message_age_seconds").isNull() | (F.col("message_age_seconds") > stale_seconds), "no fresh payload"),
    ))
    return feeds.withColumn("reasons", reasons).withColumn("ready", F.size("reasons") == 0)


def _episodes(history: DataFrame, keys: list[str], bad: Column) -> DataFrame:
    """Adds bad, was_bad (null at the first row)."""
    return previous(history.withColumn("bad", bad), keys, ["timestamp_ms"], by_time(), F.col("bad"), "was_bad")


def _told(back: Column, what: str, name: Column) -> tuple[Column, Column]:
    """Category and key: those of the problem, or of the return, whose key also has the time."""
    category = F.when(back, f"{what}_recovery").otherwise(f"{what}_health")
    again = F.concat(name, F.lit(":recovered:"), F.col("timestamp_ms").cast("string"))
    return category, F.when(back, again).otherwise(F.concat(name, F.lit(":unhealthy")))


def feed_health_alerts(history: DataFrame, stale_seconds: float) -> DataFrame:
    """Alerts from sampled feed health (exchange, timestamp_ms, healthy, age_seconds).

    Unhealthy: warning, critical beyond three times the stale age; the first of an episode bypasses the cooldown. The
    return to health is reported once, as info. Cooldown is applied afterwards (apply_cooldown).
    """
    e = _episodes(history, FEED, ~F.col("healthy"))
    first = F.col("bad") & ~F.coalesce("was_bad", F.lit(False))
    back = ~F.col("bad") & F.coalesce("was_bad", F.lit(False))
    severity = F.when(back, "info").when(F.col("age_seconds") > 3 * stale_seconds, "critical").otherwise("warning")
    category, key = _told(back, "feed", F.concat(F.lit("health:"), "exchange"))
    return e.where(F.col("bad") | back).select(
        "timestamp_ms", "exchange", severity.alias("severity"), category.alias("category"), F.lit("SYSTEM").alias("symbol"), key.alias("dedup_key"), (first | back).alias("bypass")
    )


def pipeline_health_alerts(samples: DataFrame, interval_seconds: float) -> DataFrame:
    """Alerts from queue samples (source, timestamp_ms, size, capacity, drops_total, lag_seconds).

    New drops are critical and bypass the cooldown; utilisation from 0.8 or lag over max(5, 2 intervals) warns, from
    0.95 or three times that lag is critical; the first of an episode bypasses; recovery is reported once.
    """
    samples = previous(samples, ["source"], ["timestamp_ms"], by_time(), F.col("drops_total"), "__drops")
    use, lag_limit = F.col("size") / F.col("capacity"), max(5.0, 2 * interval_seconds)
    new_drops = F.greatest(F.col("drops_total") - F.coalesce("__drops", F.lit(0)), F.lit(0))
    s = samples.withColumn("utilization", use).withColumn("new_drops", new_drops)
    severity = F.when((F.col("new_drops") > 0) | (use >= 0.95) | (F.col("lag_seconds") > 3 * lag_limit), "critical").when((use >= 0.8) | (F.col("lag_seconds") > lag_limit), "warning")
    e = _episodes(s.withColumn("severity", severity), ["source"], F.col("severity").isNotNull())
    first, back = F.col("bad") & ~F.coalesce("was_bad", F.lit(False)), ~F.col("bad") & F.coalesce("was_bad", F.lit(False))
    category, key = _told(back, "runtime", F.lit("runtime:market-queue"))
    return e.where(F.col("bad") | back).select(
        "timestamp_ms", "source", F.when(back, "info").otherwise(F.col("severity")).alias("severity"), category.alias("category"), F.lit("SYSTEM").alias("symbol"), key.alias("dedup_key"),
        (first | back | (F.col("new_drops") > 0)).alias("bypass"), "utilization", "new_drops",
    )


def continuity_episodes(metrics: DataFrame, freshness_seconds: float) -> DataFrame:
    """Monitoring gaps over all pairs: an episode opens with any pair recovering after a gap and closes once every pair
    it touched is ready and fresh on all its windows.

    Ticks are first reduced to one row each (the pairs recovering, the pairs whole, and extremes), then folded in
    order; the fold depends on what the open episode has touched, so it runs over these small rows of a source.
    Returns opened_ms, closed_ms (null: still open), pairs, min_coverage, max_gap_seconds, max_recovery_seconds.
    """
    pair = F.concat_ws(":", "exchange", "symbol")
    whole = F.col("ready") & F.col("data_age_seconds").between(0, freshness_seconds)
    per_pair = metrics.groupBy("timestamp_ms", pair.alias("pair")).agg(F.max(F.col("readiness_reason") == "recovering_after_gap").alias("gap"), F.min(F.coalesce(whole, F.lit(False))).alias("whole"), F.min("window_coverage_ratio").alias("cov"), F.max("largest_gap_seconds").alias("largest"), F.max("recovery_seconds_remaining").alias("rec"))
    per_tick = per_pair.groupBy("timestamp_ms").agg(F.collect_set(F.when(F.col("gap"), F.col("pair"))).alias("gaps"), F.collect_set(F.when(F.col("whole"), F.col("pair"))).alias("wholes"), F.min(F.when(F.col("gap"), F.col("cov"))).alias("cov"), F.max(F.when(F.col("gap"), F.col("largest"))).alias("largest"), F.max(F.when(F.col("gap"), F.col("rec"))).alias("rec"))
    # ticks at which nothing recovers and nothing changes cannot open or close an episode
    order = Window.partitionBy(F.floor(F.col("timestamp_ms") / 86_400_000)).orderBy("timestamp_ms")
    changed = per_tick.withColumn("before", F.lag(F.array_sort("wholes")).over(order)).where((F.size("gaps") > 0) | F.col("before").isNull() | (F.col("before") != F.array_sort("wholes"))).drop("before")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, now = [], None
        for r in pdf.sort_values("timestamp_ms").itertuples(index=False):
            gaps, wholes = set(r.gaps), set(r.wholes)
            if gaps:
                now = now or {"opened_ms": r.timestamp_ms, "pairs": set(), "cov": 1.0, "largest": 0.0, "rec": 0.0}
                now["pairs"] |= gaps
                now["cov"], now["largest"], now["rec"] = min(now["cov"], r.cov), max(now["largest"], r.largest), max(now["rec"], r.rec)
            elif now and now["pairs"] <= wholes:
                out.append((now["opened_ms"], r.timestamp_ms, sorted(now["pairs"]), now["cov"], now["largest"], now["rec"]))
                now = None
        if now:
            out.append((now["opened_ms"], None, sorted(now["pairs"]), now["cov"], now["largest"], now["rec"]))
        return pd.DataFrame(out, columns=["opened_ms", "closed_ms", "pairs", "min_coverage", "max_gap_seconds", "max_recovery_seconds"]).astype({"closed_ms": "Int64"})

    return changed.withColumn("one", F.lit("1")).groupBy("one").applyInPandas(fold, "opened_ms long, closed_ms long, pairs array<string>, min_coverage double, max_gap_seconds double, max_recovery_seconds double")


def episode_alerts(episodes: DataFrame) -> DataFrame:
    """A monitoring_gap at the opening of each episode and a monitoring_recovery, with its duration, at the closing."""
    seconds = ((F.col("closed_ms") - F.col("opened_ms")) / 1000.0).alias("duration_seconds")
    gap = episodes.select(F.col("opened_ms").alias("timestamp_ms"), F.lit("monitoring_gap").alias("category"), F.lit("warning").alias("severity"), "pairs", F.lit(None).cast("double").alias("duration_seconds"))
    back = episodes.where("closed_ms is not null").select(F.col("closed_ms").alias("timestamp_ms"), F.lit("monitoring_recovery").alias("category"), F.lit("info").alias("severity"), "pairs", seconds)
    return gap.unionByName(back)


def eligibility(metrics: DataFrame, freshness_seconds: float) -> DataFrame:
    """Adds alert_eligible; the reason of a ready but old row becomes stale_data."""
    fresh = F.coalesce(F.col("data_age_seconds").between(0, freshness_seconds), F.lit(False))
    reason = F.when(F.col("ready") & ~fresh, "stale_data").otherwise(F.col("readiness_reason"))
    return metrics.withColumn("alert_eligible", F.coalesce(F.col("ready") & fresh, F.lit(False))).withColumn("readiness_reason", reason)


def market_status(metrics: DataFrame, configured: DataFrame, windows: list[int], freshness_seconds: float) -> DataFrame:
    """Per symbol, from the newest metrics of each configured venue and window.

    Median fresh price and venues with one; median return and largest scores on the shortest window; venues ready on
    all windows (a missing window counts as missing_window_metric); least coverage, largest gap and recovery; reasons.
    """
    want = configured.select("exchange", "symbol").distinct().withColumn("window_seconds", F.explode(F.array(*(F.lit(w) for w in windows))))
    newest = metrics.groupBy("exchange", "symbol", "window_seconds").agg(F.max_by(F.struct("timestamp_ms", "ready", "price", "return_bps", "return_z", "volume_z", "data_age_seconds", "readiness_reason", "window_coverage_ratio", "largest_gap_seconds", "recovery_seconds_remaining"), "timestamp_ms").alias("m")).select("exchange", "symbol", "window_seconds", "m.*")
    m = eligibility(want.join(newest, ["exchange", "symbol", "window_seconds"], "left"), freshness_seconds).withColumn("readiness_reason", F.coalesce("readiness_reason", F.lit("missing_window_metric")))
    short = F.col("window_seconds") == min(windows)
    priced = short & F.col("price").isNotNull() & F.coalesce(F.col("data_age_seconds").between(0, freshness_seconds), F.lit(False))
    venue = m.groupBy("symbol", "exchange").agg(
        F.min("alert_eligible").alias("ready"), F.collect_set("readiness_reason").alias("reasons"), F.max(F.when(priced, F.col("price"))).alias("price"), F.max(F.when(short, F.col("return_bps"))).alias("return_bps"),
        F.max(F.when(short, F.abs("return_z"))).alias("return_z"), F.max(F.when(short, F.col("volume_z"))).alias("volume_z"), F.min("window_coverage_ratio").alias("cov"), F.max("largest_gap_seconds").alias("gap"), F.max("recovery_seconds_remaining").alias("rec"),
    )
    return venue.groupBy("symbol").agg(
        F.median("price").alias("median_price"), F.array_sort(F.collect_list(F.when(F.col("price").isNotNull(), F.col("exchange")))).alias("priced_venues"), F.median("return_bps").alias("median_return_bps"), F.max("return_z").alias("max_abs_return_z"), F.max("volume_z").alias("max_volume_z"),
        F.count("*").alias("configured_venues"), F.count_if("ready").alias("ready_venues"), F.min("cov").alias("min_window_coverage_ratio"), F.max("gap").alias("max_largest_gap_seconds"), F.max("rec").alias("max_recovery_seconds_remaining"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("readiness_reasons"),
    )


def overall_readiness(reasons: DataFrame) -> DataFrame:
    """One row from ordered reasons (position, reason): the distinct ones in order, ready iff there are none."""
    first = reasons.where("reason is not null").groupBy("reason").agg(F.min("position").alias("position"))
    listed = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "reason"))), lambda x: x["reason"]).alias("reasons"))
    return listed.withColumn("ready", F.size("reasons") == 0)


def public_readiness(feeds: DataFrame, stale_seconds: float, explicit: bool | None = None) -> DataFrame:
    """One row: an explicit flag wins; else every feed is connected, acknowledged, fresh, and not marked unready; no feed is not ready."""
    good = F.col("connected") & F.col("subscription_acknowledged") & F.col("message_age_seconds").between(0, stale_seconds) & F.coalesce("ready", F.lit(True))
    every = F.coalesce(F.min(F.coalesce(good, F.lit(False))), F.lit(False))
    return feeds.agg((F.lit(explicit) if explicit is not None else every).alias("ready"))
