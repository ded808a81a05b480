"""Window metrics on the bucket grid: as-of prices, returns, volumes, robust baselines, readiness.

Ticks are the last milliseconds of buckets, so every window and every baseline segment is a whole number of rows of a
dense grid per series. Series are cut into chunks (functions/series.py), so that a long one is spread over many tasks.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions.series import DAY_MS, by_time, carried, chunk_rows, with_halo
from tapewatch.functions.stats import with_robust_zscore
from tapewatch.operators.continuity import overlaps_break, segment_continuity
from tapewatch.params import Grid

SERIES = ["exchange", "symbol"]


def grid(buckets: DataFrame, bucket_seconds: int) -> DataFrame:
    """One row for each series and bucket number between its first bucket and the last one of all series.

    Empty buckets have null values; a venue that has fallen silent keeps its rows, so that its data grows old.
    """
    ms = bucket_seconds * 1000
    numbered = buckets.withColumn("idx", F.floor(F.col("start_ms") / ms).cast("long"))
    span = numbered.groupBy(*SERIES).agg(F.min("idx").alias("lo"))
    end = numbered.agg(F.max("idx").alias("hi"))  # one row
    dense = span.crossJoin(F.broadcast(end)).select(*SERIES, F.explode(F.sequence("lo", "hi")).alias("idx"))
    return dense.join(numbered, [*SERIES, "idx"], "left").withColumn("timestamp_ms", (F.col("idx") + 1) * ms - 1)


def asof_price(buckets: DataFrame, ticks: DataFrame, chunk_ms: int = DAY_MS) -> DataFrame:
    """For each tick (exchange, symbol, t_ms) the close of the last bucket whose last trade is not after it; null before the first.

    Ticks and buckets are merged in one sorted pass per series and chunk of time instead of a range join.
    """
    none = F.lit(None)
    b = buckets.select(*SERIES, F.col("last_trade_ms").alias("__at"), F.lit(0).alias("__kind"), none.cast("long").alias("t_ms"), "close")
    t = ticks.select(*SERIES, F.col("t_ms").alias("__at"), F.lit(1).alias("__kind"), "t_ms", none.cast("double").alias("close"))
    met = carried(b.unionByName(t), SERIES, ["__at", "__kind"], by_time("__at", chunk_ms), F.col("close"), "price")
    return met.where("__kind = 1").select(*SERIES, "t_ms", "price")


def window_columns(dense: DataFrame, g: Grid, length: int | None = None) -> DataFrame:
    """Adds price, ret, volume, buy, sell, n_trades, price_start_ms and last_ms of the window that ends at each grid row.

    Series are cut into chunks of `length` rows with a halo of one window.
    """
    length = length or chunk_rows(g.n)
    close = F.when(F.col("close").isNotNull(), F.struct("close", "last_trade_ms"))
    filled = carried(dense, SERIES, ["idx"], F.floor(F.col("idx") / length), close, "__at")
    order = Window.partitionBy(*SERIES, "__chunk").orderBy("idx")
    inside = order.rowsBetween(-(g.n - 1), 0)
    total = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0.0))
    found = with_halo(filled, length, g.n).select(
        *SERIES, "idx", "timestamp_ms", "__own", "__at", F.lag("__at", g.n).over(order).alias("__then"), F.count("close").over(inside).alias("__filled"),
        total("quote_volume").alias("volume"), total("buy_quote_volume").alias("buy"), total("sell_quote_volume").alias("sell"),
        F.coalesce(F.sum("trades").over(inside), F.lit(0)).alias("n_trades"),
    )
    price, start = F.col("__at.close"), F.col("__then.close")
    return found.where("__own").select(
        *SERIES, "idx", "timestamp_ms", price.alias("price"), F.when((F.col("__filled") > 0) & (start > 0), price / start - 1).alias("ret"),
        "volume", "buy", "sell", "n_trades", F.col("__then.last_trade_ms").alias("price_start_ms"), F.col("__at.last_trade_ms").alias("last_ms"),
    )


def taker_imbalance(buy: Column, sell: Column) -> Column:
    return F.when(buy + sell > 0, (buy - sell) / (buy + sell)).otherwise(0.0)


def baseline_samples(points: DataFrame, g: Grid, length: int | None = None) -> DataFrame:
    """Adds `sample`: (ret, volume) of past windows, one window back and then every stride, as far as the baseline goes.

    Only windows with a return that were continuous (column `hist`) count, and at most the newest max_points of them.
    A window is a whole number of strides, so the rows of a sample share their phase: frames run over the rows of one
    phase, in chunks of `length` grid rows with a halo of one baseline.
    """
    cut = with_halo(points, length or chunk_rows(g.baseline), g.baseline).withColumn("__phase", F.pmod("idx", F.lit(g.stride)))
    order = Window.partitionBy(*SERIES, "__chunk", "__phase").orderBy("idx")
    past = order.rowsBetween(-(g.baseline // g.stride), -(g.n // g.stride))
    counted = F.when(F.col("ret").isNotNull() & F.col("hist"), F.struct("ret", "volume"))
    found = cut.withColumn("__past", F.collect_list(counted).over(past)).where("__own")
    return found.select(*points.columns, F.slice(F.reverse("__past"), 1, g.max_points).alias("sample"))


def metric_snapshots(buckets: DataFrame, breaks: DataFrame | None = None, g: Grid = Grid(), every: int = 1, pairs: DataFrame | None = None) -> DataFrame:
    """Metrics of one window size at every `every`-th tick of each series.

    Columns follow METRIC without the age, which needs a clock (see data_age): return in basis points, z-scores of
    return and volume against the baseline, imbalance, readiness and its reason, coverage and gaps. Breaks are merged
    ones. A pair in `pairs` without any bucket yields one no_data row.
    """
    points = window_columns(grid(buckets, g.bucket_seconds), g)
    if breaks is not None:
        seg = points.select(*SERIES, "idx", F.col("timestamp_ms").alias("t_ms"), F.lit(g.window_seconds * 1000).cast("long").alias("w_ms"), "price_start_ms", F.concat_ws("|", *SERIES, "idx").alias("seg_id"))
        then = segment_continuity(seg, breaks, g.max_gap_seconds, g.min_coverage, now=False).select(*SERIES, "idx", F.col("continuous").alias("hist"))
        now = segment_continuity(seg, breaks, g.max_gap_seconds, g.min_coverage, now=True).select(*SERIES, "idx", "continuous", "coverage_ratio", "largest_gap_seconds", "last_gap_end_ms")
        points = points.join(then, [*SERIES, "idx"]).join(now, [*SERIES, "idx"])
    else:
        points = points.withColumns({"hist": F.lit(True), "continuous": F.lit(True), "coverage_ratio": F.lit(1.0), "largest_gap_seconds": F.lit(0.0), "last_gap_end_ms": F.lit(None).cast("long")})
    # phases of the stride that hold no wanted tick are left out before the windows
    points = points.where(F.pmod(F.col("idx") + 1, F.lit(gcd(every, g.stride))) == 0)
    found = baseline_samples(points, g).where(F.pmod(F.col("idx") + 1, F.lit(every)) == 0)
    found = with_robust_zscore(found, "ret", F.transform("sample", lambda x: x["ret"]), "return_z")
    found = with_robust_zscore(found, "volume", F.transform("sample", lambda x: x["volume"]), "volume_z")
    found = found.withColumn("baseline_points", F.size("sample")).drop("sample")
    reason = (
        F.when(F.col("ret").isNull(), "insufficient_window")
        .when(~F.col("continuous"), "recovering_after_gap")
        .when((F.col("baseline_points") < g.min_points) | F.col("return_z").isNull() | F.col("volume_z").isNull(), "baseline_warmup")
        .otherwise("ready")
    )
    left = F.when(F.col("ret").isNull(), F.lit(float(g.window_seconds))).when(~F.col("continuous"), F.greatest((F.col("last_gap_end_ms") + g.window_seconds * 1000 - F.col("timestamp_ms")) / 1000.0, F.lit(0.0))).otherwise(0.0)
    out = found.select(
        "timestamp_ms", *SERIES, F.lit(g.window_seconds).alias("window_seconds"), (reason == "ready").alias("ready"), "price", (F.col("ret") * 10_000).alias("return_bps"), "return_z",
        F.col("volume").alias("quote_volume"), "volume_z", taker_imbalance(F.col("buy"), F.col("sell")).alias("taker_imbalance"), F.col("n_trades").alias("trades"), "baseline_points",
        F.greatest((F.col("timestamp_ms") - F.col("last_ms")) / 1000.0, F.lit(0.0)).alias("data_age_seconds"), reason.alias("readiness_reason"),
        F.col("coverage_ratio").alias("window_coverage_ratio"), "largest_gap_seconds", left.alias("recovery_seconds_remaining"),
    )
    # One row per key as it is, so this aggregate changes nothing and needs no shuffle; but filters on the metrics stop
    # here, where they would otherwise be pushed down as copies of all the score expressions.
    key = ["timestamp_ms", *SERIES, "window_seconds"]
    out = out.groupBy(*key).agg(*(F.first(c).alias(c) for c in out.columns if c not in key)).select(*out.columns)
    if pairs is None:
        return out
    absent = pairs.select(*SERIES).distinct().join(buckets.select(*SERIES).distinct(), SERIES, "left_anti")
    empty = absent.select(*SERIES, F.lit(False).alias("ready"), F.lit(g.window_seconds).alias("window_seconds"), F.lit("no_data").alias("readiness_reason"), F.lit(0.0).alias("quote_volume"), F.lit(0).cast("long").alias("trades"), F.lit(0).alias("baseline_points"))
    return out.unionByName(empty, allowMissingColumns=True)


def latest_prices(buckets: DataFrame, now_ms: int, freshness_seconds: float) -> DataFrame:
    """Per symbol a map venue -> close of its newest bucket, where that is fresh."""
    last = buckets.where(F.col("last_trade_ms") <= now_ms).groupBy(*SERIES).agg(F.max_by("close", "start_ms").alias("price"), F.max("last_trade_ms").alias("at"))
    fresh = last.where((now_ms - F.col("at")) / 1000.0 <= freshness_seconds)
    return fresh.groupBy("symbol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("exchange", "price")))).alias("prices"))


def liquidation_window(liqs: DataFrame, window_seconds: int, tick_seconds: int, breaks: DataFrame | None = None) -> DataFrame:
    """Liquidated value per symbol in [t - w, t] at every tick t that is the last millisecond of a `tick_seconds` bucket.

    Each event is copied to the ticks whose window holds it, which is an equality on tick afterwards. A venue with a
    break touching the window is left out whole. Direction: more longs liquidated means down, more shorts up.
    """
    ms, w = tick_seconds * 1000, window_seconds * 1000
    first = F.floor(F.col("timestamp_ms") / ms)
    ticks = F.sequence(first, F.floor((F.col("timestamp_ms") + w + 1) / ms) - 1)
    spread = liqs.withColumn("tick", F.explode(ticks)).withColumn("t_ms", (F.col("tick") + 1) * ms - 1)
    spread = spread.where((F.col("timestamp_ms") <= F.col("t_ms")) & (F.col("timestamp_ms") >= F.col("t_ms") - w))
    if breaks is not None:
        spread = overlaps_break(spread.withColumn("__from", F.col("t_ms") - w), breaks, "__from", "t_ms", keep=False).drop("__from")
    usd = F.col("price") * F.col("quantity")
    venue = spread.groupBy("t_ms", "symbol", "exchange").agg(F.sum(usd).alias("usd"), F.sum(F.when(F.col("liquidated_side") == "long", usd).otherwise(0.0)).alias("long_usd"), F.count("*").alias("events"))
    out = venue.groupBy("t_ms", "symbol").agg(
        F.sum("usd").alias("total_usd"), F.sum("long_usd").alias("long_usd"), (F.sum("usd") - F.sum("long_usd")).alias("short_usd"), F.sum("events").alias("events"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("usd") > 0, F.struct("exchange", "usd"))))).alias("exchanges"),
    )
    side = F.when(F.col("long_usd") > F.col("short_usd"), "down").when(F.col("long_usd") < F.col("short_usd"), "up").otherwise("mixed")
    return out.withColumn("direction", side)
