"""Ticks, frames, breaks, alerts and samples derived by Spark from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.params import Grid, Rules, Threshold, WindowRule

GRID = Grid(bucket_seconds=3600, window_seconds=21_600, baseline_seconds=864_000, min_points=12, max_gap_seconds=14_400, min_coverage=0.3)
WARNING, CRITICAL = Threshold(60, 1.0, 0.5, 0.3, 1), Threshold(100, 2.0, 1.0, 0.3, 2)
RULES = Rules((WindowRule(21_600, WARNING, CRITICAL),), 0.0, 7200.0, 1.75, 8000.0, 12_000.0, 3, 40.0, 120.0, 2, 3)

TICKS_SQL = """
tick AS (SELECT ['binance','bybit','okx'][1 + user_id % 3] AS exchange, ['BTCUSDT','ETHUSDT'][1 + (user_id // 3) % 2] AS symbol,
  epoch_us(ts) // 1000 AS timestamp_ms, 100 + value / 50 AS price, CAST(1 + event_id % 17 AS DOUBLE) AS quantity,
  CASE WHEN event_type IN ('click', 'purchase') THEN 'buy' ELSE 'sell' END AS taker_side, event_id AS arrival_seq, event_type,
  epoch_us(ts) // 1000 + (event_id % 11 - 3) * 1000 AS received_wall_ms FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
trades AS (SELECT * FROM tick WHERE event_type <> 'error'),
liqs AS (SELECT *, CASE WHEN arrival_seq % 2 = 0 THEN 'long' ELSE 'short' END AS liquidated_side FROM tick WHERE event_type = 'error'),
bucket AS (SELECT exchange, symbol, timestamp_ms - timestamp_ms % 3600000 AS start_ms, arg_min(price, (timestamp_ms, arrival_seq)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (timestamp_ms, arrival_seq)) AS close, sum(price * quantity) AS quote_volume, sum(CASE WHEN taker_side = 'buy' THEN price * quantity ELSE 0 END) AS buy_quote_volume,
  sum(CASE WHEN taker_side = 'sell' THEN price * quantity ELSE 0 END) AS sell_quote_volume, count(*) AS trades, min(timestamp_ms) AS first_trade_ms, max(timestamp_ms) AS last_trade_ms
  FROM trades GROUP BY 1, 2, 3)"""

BREAKS_SQL = """
clog AS (SELECT exchange, symbol, CASE arrival_seq % 3 WHEN 0 THEN 'end' ELSE 'start' END AS phase, timestamp_ms, 'r' || (arrival_seq % 4) AS reason, arrival_seq FROM tick),
ep AS (SELECT *, coalesce(sum(CASE WHEN phase = 'end' THEN 1 ELSE 0 END) OVER (PARTITION BY exchange, symbol ORDER BY timestamp_ms, CASE WHEN phase = 'start' THEN 0 ELSE 1 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM clog),
paired AS (SELECT exchange, symbol, e, greatest(min(timestamp_ms) FILTER (phase = 'start'), 1) AS start_ms, min(timestamp_ms) FILTER (phase = 'end') AS endx,
  array_to_string(list_sort(list(DISTINCT reason) FILTER (phase = 'start')), ',') AS reason FROM ep GROUP BY 1, 2, 3 HAVING count(*) FILTER (phase = 'start') > 0),
breaks AS (SELECT exchange, symbol, start_ms, CASE WHEN endx IS NOT NULL THEN greatest(endx, start_ms + 1) END AS end_ms, reason FROM paired)"""

METRICS_SQL = """
span AS (SELECT exchange, symbol, min(start_ms) // 3600000 AS lo, (SELECT max(start_ms) // 3600000 FROM bucket) AS hi FROM bucket GROUP BY 1, 2),
dense0 AS (SELECT exchange, symbol, unnest(range(lo, hi + 1)) AS idx FROM span),
dense AS (SELECT d.exchange, d.symbol, d.idx, (d.idx + 1) * 3600000 - 1 AS timestamp_ms, b.close, b.quote_volume, b.buy_quote_volume, b.sell_quote_volume, b.trades, b.last_trade_ms
  FROM dense0 d LEFT JOIN bucket b ON b.exchange = d.exchange AND b.symbol = d.symbol AND b.start_ms = d.idx * 3600000),
pt0 AS (SELECT exchange, symbol, idx, timestamp_ms, last_value(close IGNORE NULLS) OVER sofar AS price, last_value(close IGNORE NULLS) OVER prior AS ps, count(close) OVER ins AS nb,
  coalesce(sum(quote_volume) OVER ins, 0) AS volume, coalesce(sum(buy_quote_volume) OVER ins, 0) AS buy, coalesce(sum(sell_quote_volume) OVER ins, 0) AS sell, coalesce(sum(trades) OVER ins, 0) AS n_trades,
  last_value(last_trade_ms IGNORE NULLS) OVER prior AS price_start_ms, last_value(last_trade_ms IGNORE NULLS) OVER sofar AS last_ms FROM dense
  WINDOW ins AS (PARTITION BY exchange, symbol ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), prior AS (PARTITION BY exchange, symbol ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING),
  sofar AS (PARTITION BY exchange, symbol ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pt AS (SELECT *, CASE WHEN nb > 0 AND ps > 0 THEN price / ps - 1 END AS ret, CASE WHEN buy + sell > 0 THEN (buy - sell) / (buy + sell) ELSE 0 END AS imbalance FROM pt0),
smp AS (SELECT p.exchange, p.symbol, p.idx, count(*) AS np, median(q.ret) AS mr, mad(q.ret) AS dr, median(q.volume) AS mv, mad(q.volume) AS dv FROM pt p JOIN pt q ON q.exchange = p.exchange AND q.symbol = p.symbol
  AND q.idx BETWEEN p.idx - 240 AND p.idx - 6 AND (p.idx - 6 - q.idx) % 3 = 0 AND q.ret IS NOT NULL WHERE (p.idx + 1) % 6 = 0 GROUP BY 1, 2, 3),
met AS (SELECT p.timestamp_ms, p.exchange, p.symbol, p.price, p.ret * 10000 AS return_bps, CASE WHEN np >= 5 THEN 0.6744897501960817 * (p.ret - mr) / dr END AS return_z, p.volume AS quote_volume,
  CASE WHEN np >= 5 THEN 0.6744897501960817 * (p.volume - mv) / dv END AS volume_z, p.imbalance AS taker_imbalance, p.n_trades AS trades, coalesce(np, 0) AS baseline_points, greatest((p.timestamp_ms - p.last_ms) / 1000.0, 0) AS data_age_seconds,
  CASE WHEN p.ret IS NULL THEN 'insufficient_window' WHEN coalesce(np, 0) < 12 OR dr IS NULL OR dv IS NULL THEN 'baseline_warmup' ELSE 'ready' END AS readiness_reason
  FROM pt p LEFT JOIN smp s ON s.exchange = p.exchange AND s.symbol = p.symbol AND s.idx = p.idx WHERE (p.idx + 1) % 6 = 0)"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").where("value is not null and ts is not null")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    pick = lambda names, k: F.element_at(F.array(*(F.lit(n) for n in names)), k.cast("int") + 1)
    return e.select(
        pick(["binance", "bybit", "okx"], F.col("user_id") % 3).alias("exchange"), pick(["BTCUSDT", "ETHUSDT"], F.floor(F.col("user_id") / 3) % 2).alias("symbol"), ms.alias("timestamp_ms"),
        (100 + F.col("value") / 50).alias("price"), (1 + F.col("event_id") % 17).cast("double").alias("quantity"), F.when(F.col("event_type").isin("click", "purchase"), "buy").otherwise("sell").alias("taker_side"),
        F.col("event_id").cast("string").alias("event_id"), (ms + (F.col("event_id") % 11 - 3) * 1000).alias("received_wall_ms"), (ms / 1000.0).alias("received_monotonic_s"), F.floor(F.col("event_id") / 500).cast("long").alias("continuity_generation"), F.col("event_id").alias("arrival_seq"), "event_type",
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).where("event_type <> 'error'").drop("event_type")


def liquidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("arrival_seq") % 2 == 0, "long").otherwise("short")
    return ticks(spark, sf_dir).where("event_type = 'error'").withColumn("liquidated_side", side).drop("event_type", "taker_side")


def continuity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return t.select("exchange", "symbol", F.when(F.col("arrival_seq") % 3 == 0, "end").otherwise("start").alias("phase"), "timestamp_ms", F.concat(F.lit("r"), (F.col("arrival_seq") % 4).cast("string")).alias("reason"))


def symbol_map(spark: SparkSession) -> DataFrame:
    rows = [(x, s.lower(), s) for x in ("binance", "bybit", "okx") for s in ("BTCUSDT", "ETHUSDT")]
    return spark.createDataFrame(rows, "exchange string, venue_symbol string, canonical string")


def _frame(df: DataFrame, body) -> DataFrame:
    return df.select(F.to_json(body).alias("frame"), "received_wall_ms", "received_monotonic_s", "continuity_generation", "arrival_seq")


def _t(c: str):
    return F.col(c).cast("string")


def agg_trade_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).where("exchange = 'binance'")
    return _frame(t, F.struct(F.struct(F.lit("aggTrade").alias("e"), F.col("timestamp_ms").alias("T"), F.lower("symbol").alias("s"), F.col("arrival_seq").alias("a"), _t("price").alias("p"), _t("quantity").alias("q"), (F.col("taker_side") == "sell").alias("m")).alias("data")))


def force_order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = liquidations(spark, sf_dir).where("exchange = 'binance'")
    o = F.struct(F.lower("symbol").alias("s"), F.when(F.col("liquidated_side") == "long", "SELL").otherwise("BUY").alias("S"), _t("price").alias("ap"), F.lit("1").alias("p"), _t("quantity").alias("q"), F.lit("0").alias("l"), _t("quantity").alias("z"), F.col("timestamp_ms").alias("T"))
    return _frame(t, F.struct(F.struct(F.lit("forceOrder").alias("e"), o.alias("o")).alias("data")))


def _topic_frames(t: DataFrame, topic: str, side) -> DataFrame:
    item = F.struct(F.col("timestamp_ms").alias("T"), F.lower("symbol").alias("s"), side.alias("S"), _t("quantity").alias("v"), _t("price").alias("p"), F.col("arrival_seq").cast("string").alias("i"))
    return _frame(t, F.struct(F.concat(F.lit(topic), F.col("symbol")).alias("topic"), F.array(item).alias("data")))


def public_trade_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topic_frames(trades(spark, sf_dir).where("exchange = 'bybit'"), "publicTrade.", F.initcap("taker_side"))


def liquidation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topic_frames(liquidations(spark, sf_dir).where("exchange = 'bybit'"), "allLiquidation.", F.when(F.col("liquidated_side") == "long", "Buy").otherwise("Sell"))


def swap_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).where("exchange = 'okx'")
    item = F.struct(F.col("timestamp_ms").cast("string").alias("ts"), _t("price").alias("px"), F.format_string("%.1f", F.col("quantity") * 2).alias("sz"), F.col("taker_side").alias("side"), F.col("arrival_seq").cast("string").alias("tradeId"))
    return _frame(t, F.struct(F.struct(F.lit("trades").alias("channel"), F.lower("symbol").alias("instId")).alias("arg"), F.array(item).alias("data")))


def instruments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("btcusdt", "0.5", None), ("ethusdt", "5", "0.1")], "instId string, ctVal string, ctMult string")


ALERTS_SQL = """
al AS (SELECT CAST(event_id AS VARCHAR) AS id, epoch_us(ts) // 1000 AS timestamp_ms, CASE WHEN event_type = 'purchase' THEN 'critical' WHEN event_type = 'view' THEN 'info' ELSE 'warning' END AS severity,
  CASE WHEN event_id % 5 = 0 THEN 'liquidation' WHEN event_id % 7 = 0 THEN 'monitoring_gap' WHEN event_id % 11 = 0 THEN 'system_test' ELSE 'price' END AS category, ['BTCUSDT','ETHUSDT'][1 + user_id % 2] AS symbol,
  'key:' || (user_id % 40) AS dedup_key, event_id AS sequence, CASE WHEN event_id % 13 = 0 THEN 'external' ELSE 'detector' END AS source, 'Alert ' || event_type AS title, coalesce(props, '') AS message FROM events WHERE ts IS NOT NULL),
jb AS (SELECT CAST(event_id AS VARCHAR) AS alert_id, CAST(event_id % 3 AS INTEGER) AS priority, 'key:' || (user_id % 40) AS original_dedup_key, ['queued','attempt','success','failure'][1 + event_id % 4] AS status, CAST(event_id % 3 AS INTEGER) AS attempt, epoch_us(ts) // 1000 + 500 AS updated_ms FROM events WHERE ts IS NOT NULL),
rc AS (SELECT event_id AS id, CAST(event_id // 3 AS VARCHAR) AS alert_id, epoch_us(ts) // 1000 AS timestamp_ms, ['local','push','hook'][1 + user_id % 3] AS channel, ['queued','attempt','success','failure'][1 + event_id % 4] AS status, CAST(event_id % 3 AS INTEGER) AS attempt FROM events WHERE ts IS NOT NULL)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").where("ts is not null")
    k = F.col("event_id")
    return e.select(
        k.cast("string").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.when(F.col("event_type") == "purchase", "critical").when(F.col("event_type") == "view", "info").otherwise("warning").alias("severity"),
        F.when(k % 5 == 0, "liquidation").when(k % 7 == 0, "monitoring_gap").when(k % 11 == 0, "system_test").otherwise("price").alias("category"), F.when(F.col("user_id") % 2 == 0, "BTCUSDT").otherwise("ETHUSDT").alias("symbol"),
        F.concat(F.lit("key:"), (F.col("user_id") % 40).cast("string")).alias("dedup_key"), k.alias("sequence"), F.when(k % 13 == 0, "external").otherwise("detector").alias("source"),
        F.concat(F.lit("Alert "), "event_type").alias("title"), F.coalesce("props", F.lit("")).alias("message"), F.array(F.when(F.col("user_id") % 3 == 0, "binance").otherwise("okx")).alias("exchanges"),
    )


def _status(k):
    return F.element_at(F.array(*(F.lit(s) for s in ("queued", "attempt", "success", "failure"))), (k % 4).cast("int") + 1)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = _read(spark, sf_dir, "events").where("ts is not null"), F.col("event_id")
    return e.select(k.cast("string").alias("alert_id"), (k % 3).cast("int").alias("priority"), F.concat(F.lit("key:"), (F.col("user_id") % 40).cast("string")).alias("original_dedup_key"), _status(k).alias("status"), (k % 3).cast("int").alias("attempt"), (F.unix_millis(F.col("ts").cast("timestamp")) + 500).alias("updated_ms"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = _read(spark, sf_dir, "events").where("ts is not null"), F.col("event_id")
    channel = F.element_at(F.array(F.lit("local"), F.lit("push"), F.lit("hook")), (F.col("user_id") % 3).cast("int") + 1)
    return e.select(k.alias("id"), F.floor(k / 3).cast("string").alias("alert_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), channel.alias("channel"), _status(k).alias("status"), (k % 3).cast("int").alias("attempt"), F.lit("").alias("detail"))


def evidence(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Samples (timestamp_ms, body) whose instances are derived from events; every seventh is not ok.

    Markets are unready (every eighth), quiet (every eighth), recovering or missing (one in sixteen each), else ready.
    """
    e = _read(spark, sf_dir, "events").where("ts is not null")
    if dealt:  # where samples take far more work than their events; those of one second then come in any order
        e = e.select("event_id", "ts").repartition(4 * spark.sparkContext.defaultParallelism, "event_id")
    k = F.col("event_id")
    ms = (F.unix_millis(F.col("ts").cast("timestamp")) / 1000).cast("long") * 1000
    up = F.struct(F.lit(True).alias("ready"), F.lit(True).alias("alert_eligible"), F.lit("ready").alias("reason"))
    stale = F.struct(F.lit(False).alias("ready"), F.lit(False).alias("alert_eligible"), F.lit("stale_data").alias("reason"))
    low, half, back, gone = k % 8 == 0, k % 8 == 4, k % 16 == 1, k % 16 == 3
    venues = F.when(low, F.create_map(F.lit("okx"), stale)).when(half, F.create_map(F.lit("okx"), up, F.lit("binance"), stale)).otherwise(F.create_map(F.lit("okx"), up))
    market = F.struct(
        F.lit("BTC").alias("symbol"), F.when(low, 0).otherwise(1).alias("ready_venues"), F.when(half, 2).otherwise(1).alias("configured_venues"),
        F.when(half, F.array(F.lit(" Stale_Data"), F.lit("ready"))).otherwise(F.array(F.lit("ready"))).alias("readiness_reasons"),
        F.when(back, 5.0).otherwise(0.0).alias("max_recovery_seconds_remaining"), venues.alias("venue_readiness"),
    )
    feeds = F.create_map(F.lit("okx"), F.struct(F.lit(True).alias("healthy"), F.lit(True).alias("connected"), F.lit(True).alias("subscription_acknowledged"), F.lit(1.0).alias("message_age_seconds"), (k % 3).alias("dropped_events"), F.lit(0).alias("reconnects"), F.lit(1).alias("trades"), F.lit(0).alias("liquidations"), F.create_map(F.lit("BTC"), F.struct(F.lit(True).alias("healthy"), F.lit(1.0).alias("message_age_seconds"), (k % 2).alias("messages"))).alias("symbols")))
    inst = F.struct((k % 7 != 0).alias("ok"), F.floor(k / 400).alias("runtime_started_ms"), (k % 400).cast("double").alias("uptime_seconds"), feeds.alias("feeds"), F.when(~gone, F.array(market)).alias("markets"), F.struct((k % 7 != 0).alias("ready")).alias("readiness"))
    box = F.struct(F.lit(True).alias("observed"), F.lit(True).alias("present"), (k % 50 != 0).alias("running"), F.when(k % 50 != 0, "running").otherwise("exited").alias("status"), F.lit("healthy").alias("health"), F.lit(0).alias("restart_count"), F.concat(F.lit("c"), F.floor(k / 300)).alias("container_id"), F.lit("s").alias("started_at"))
    body = F.struct(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), inst.alias("primary"), inst.alias("shadow"), box.alias("docker"))
    return e.select(ms.alias("timestamp_ms"), F.to_json(body).alias("body"))


EVIDENCE_SQL = "evd AS (SELECT event_id AS k, (epoch_us(ts) // 1000000) * 1000 AS t FROM events WHERE ts IS NOT NULL)"
