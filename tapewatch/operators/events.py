"""Event state: duplicates, time buckets, lateness, ages, restored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions.series import by_time, scanned
from tapewatch.functions.stats import finite

SERIES = ["exchange", "symbol"]


def notional() -> Column:
    return F.col("price") * F.col("quantity")


#: Arrivals of one chunk of a series; chunks are sorted in tasks of their own.
CHUNK = 1 << 20


def running_max(df: DataFrame, keys: list[str], value: Column, out: str, chunk: int = CHUNK) -> DataFrame:
    """Adds the largest value so far in arrival order, this row included, for each combination of keys.

    Series are cut into chunks of `chunk` arrival numbers. Within a chunk the maximum runs over its own rows; what came
    before is one row for each chunk, so that no task sorts a whole series. Nulls count as nothing.
    """
    rows = df.withColumn("__chunk", F.floor(F.col("arrival_seq") / chunk)).withColumn("__value", value)
    per = rows.groupBy(*keys, "__chunk").agg(F.max("__value").alias("__top"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "__chunk", F.max("__top").over(before).alias("__before"))
    own = Window.partitionBy(*keys, "__chunk").orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("__own", F.max("__value").over(own)).join(per, [*keys, "__chunk"])
    return met.withColumn(out, F.greatest("__own", "__before")).select(*df.columns, out)


def _dedup(df: DataFrame, keys: list[str], horizon_ms: int) -> DataFrame:
    """Keeps an event unless its id was accepted less than the horizon before the newest event so far.

    Ids that are null or empty are never duplicates; such rows move the newest time but meet no window. The newest time
    runs over arrival order; an id that was already older than the horizon when it arrived is passed and not remembered.
    """
    named = F.col("event_id").isNotNull() & (F.col("event_id") != "")
    seen = running_max(df, keys, F.col("timestamp_ms"), "__max").withColumn("__late", F.col("timestamp_ms") < F.col("__max") - horizon_ms)
    before = Window.partitionBy(*keys, "event_id", "__late").orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max("timestamp_ms").over(before)
    again = ~F.col("__late") & last.isNotNull() & (last >= F.col("__max") - horizon_ms)
    kept = seen.where(named).withColumn("__again", again).where(~F.col("__again"))
    return kept.select(*df.columns).unionByName(df.where(~named))


def dedup_trades(df: DataFrame, horizon_seconds: int = 120) -> DataFrame:
    """Drops repeated trade ids within the horizon, per (exchange, symbol), in arrival order."""
    return _dedup(df, SERIES, horizon_seconds * 1000)


def dedup_liquidations(df: DataFrame, horizon_seconds: int = 4500, chunk: int = CHUNK) -> DataFrame:
    """Drops repeated liquidation ids over all venues in arrival order; rows without an id stay.

    The cutoff of a row is the newest time so far, over all rows with an id, less the horizon. An accepted id is
    remembered until the cutoff passes the newest time at its arrival; a row already behind its cutoff is not
    remembered. Ids are spread over the cluster by their own hash; an id's times, not its rows, are folded.
    """
    named = F.col("event_id").isNotNull() & (F.col("event_id") != "")
    seen = running_max(df.where(named).withColumn("__all", F.lit(0)), ["__all"], F.col("timestamp_ms"), "__max", chunk).drop("__all")
    horizon = horizon_seconds * 1000
    row = F.struct(F.col("arrival_seq").alias("seq"), F.col("__max").alias("top"), (F.col("timestamp_ms") < F.col("__max") - horizon).alias("late"))
    rows = seen.groupBy("event_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    state = F.struct(F.lit(None).cast("long").alias("top"), F.array().cast("array<long>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        again = F.coalesce(s["top"] >= x["top"] - horizon, F.lit(False))
        taken = F.struct(F.when(x["late"], s["top"]).otherwise(x["top"]).alias("top"), F.concat(s["out"], F.array(x["seq"])).alias("out"))
        return F.when(again, s).otherwise(taken)

    kept = rows.select("event_id", F.explode(F.aggregate("rows", state, step, lambda s: s["out"])).alias("arrival_seq"))
    return df.where(named).join(kept, ["event_id", "arrival_seq"], "left_semi").select(*df.columns).unionByName(df.where(~F.coalesce(named, F.lit(False))))


def bucket_columns() -> list[Column]:
    """Aggregates of one bucket; ties in time go to the first arrival for open and the last for close."""
    at = F.struct("timestamp_ms", "arrival_seq")
    return [
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum(notional()).alias("quote_volume"),
        F.sum(F.when(F.col("taker_side") == "buy", notional()).otherwise(0.0)).alias("buy_quote_volume"),
        F.sum(F.when(F.col("taker_side") == "sell", notional()).otherwise(0.0)).alias("sell_quote_volume"),
        F.count("*").alias("trades"),
        F.min("timestamp_ms").alias("first_trade_ms"),
        F.max("timestamp_ms").alias("last_trade_ms"),
    ]


def bucketize(trades: DataFrame, bucket_seconds: int = 5) -> DataFrame:
    """Tumbling buckets of trades per (exchange, symbol): open, high, low, close, volumes, counts. One shuffle, with map-side partial aggregates."""
    ms = bucket_seconds * 1000
    start = (F.col("timestamp_ms") - F.pmod("timestamp_ms", F.lit(ms))).alias("start_ms")
    return trades.groupBy(*SERIES, start).agg(*bucket_columns())


def drop_late(trades: DataFrame, retention_seconds: int = 4500, bucket_seconds: int = 5) -> DataFrame:
    """Drops trades whose bucket starts more than the retention before the series' newest trade at their arrival."""
    ms = bucket_seconds * 1000
    start = F.col("timestamp_ms") - F.pmod("timestamp_ms", F.lit(ms))
    return running_max(trades, SERIES, F.col("timestamp_ms"), "__max").where(F.col("__max") - start <= retention_seconds * 1000).drop("__max")


def data_age(trades: DataFrame, now_ms: Column | int) -> DataFrame:
    """Seconds since the newest trade of each series, by event time or by the receipt of a trade that moved it, the larger one."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    moved = running_max(trades, SERIES, F.col("timestamp_ms"), "__front").where(F.col("timestamp_ms") >= F.col("__front"))
    latest = moved.groupBy(*SERIES).agg(F.max("timestamp_ms").alias("last_event_ms"), F.max_by("received_wall_ms", "arrival_seq").alias("last_received_ms"))
    age = lambda c: F.greatest((now - F.col(c)) / 1000.0, F.lit(0.0))
    return latest.withColumn("data_age_seconds", F.greatest(age("last_event_ms"), age("last_received_ms")))


def order_liquidations(liqs: DataFrame, retention_seconds: int = 4500) -> DataFrame:
    """Liquidations within the retention of the newest one with an id, of any series, numbered in time order (ties:
    arrival) for each exchange and symbol."""
    named = F.col("event_id").isNotNull() & (F.col("event_id") != "")
    newest = liqs.agg(F.coalesce(F.max(F.when(named, F.col("timestamp_ms"))), F.max("timestamp_ms")).alias("__newest"))  # one row
    kept = liqs.crossJoin(F.broadcast(newest)).where(F.col("timestamp_ms") >= F.col("__newest") - retention_seconds * 1000).drop("__newest")
    return scanned(kept, SERIES, ["timestamp_ms", "arrival_seq"], by_time(), F.lit(1), "position")


def restore_buckets(saved: DataFrame, allowed: DataFrame, now_ms: int, saved_ms: int, bucket_seconds: int = 5, retention_seconds: int = 4500, skew_seconds: int = 5, max_age_seconds: int = 3600) -> DataFrame:
    """Buckets that a warm start takes over: allowed pairs, sound values, inside the retention, the newest ones of each series.

    A snapshot older than the largest age, or more than 300 s ahead, restores nothing.
    """
    if now_ms - saved_ms > max_age_seconds * 1000 or saved_ms - now_ms > 300_000:
        return saved.where(F.lit(False))
    prices, volumes = ["open", "high", "low", "close"], ["quote_volume", "buy_quote_volume", "sell_quote_volume"]
    sound = F.lit(True)
    for c in prices:
        sound = sound & finite(F.col(c)) & (F.col(c) > 0)
    for c in volumes:
        sound = sound & finite(F.col(c)) & (F.col(c) >= 0)
    inside = F.col("start_ms").between(now_ms - retention_seconds * 1000, now_ms + skew_seconds * 1000)
    kept = saved.where(sound & inside).join(allowed.select(*SERIES).distinct(), SERIES, "left_semi")
    newest = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("start_ms")))
    return kept.withColumn("__n", newest).where(F.col("__n") <= retention_seconds // bucket_seconds + 4).drop("__n")
