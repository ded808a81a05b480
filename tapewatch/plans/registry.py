"""All registered queries of the tick library and their DuckDB equivalents.

Each query runs over a whole given table, mapped to ticks, alerts or receipts (driver_data). Doubles are rounded, as
sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.operators import alerts as A
from tapewatch.operators import continuity as C
from tapewatch.operators import events as E
from tapewatch.operators import evidence as G
from tapewatch.operators import health as H
from tapewatch.operators import normalize as N
from tapewatch.operators import rules as R
from tapewatch.operators import tables as P
from tapewatch.operators import windows as W
from tapewatch.params import Channel
from tapewatch.plans import driver_data as D

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "w9_metric_snapshots"
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None, *parts: str) -> Callable[[Query], Query]:
    """Registers a query; parts are common table expressions that the SQL needs."""

    def add(f: Query) -> Query:
        _FOUND[name] = (f, ("WITH " + ",".join(parts) + " " + sql if parts else sql) if sql else None)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _FOUND.items() if s}


def r(name: str, places: int = 6) -> Column:
    return F.round(F.col(name).cast("double"), places).alias(name)


T, B, M, AL = D.TICKS_SQL, D.BREAKS_SQL, D.METRICS_SQL, D.ALERTS_SQL
EVENT = ["exchange", "symbol", "timestamp_ms", "arrival_seq"]


def _event(df: DataFrame, side: str) -> DataFrame:
    return df.select(*EVENT, r("price"), r("quantity"), side)


# ---- N: normalisation

_PARSED = "SELECT exchange, symbol, timestamp_ms, arrival_seq, round(price, 6) AS price, round(quantity, 6) AS quantity, {side} FROM {of} WHERE exchange = '{x}'"


@query("n2_normalize_agg_trades", _PARSED.format(side="taker_side", of="trades", x="binance"), T)
def _n2(s, d):
    return _event(N.normalize_agg_trades(D.agg_trade_frames(s, d), D.symbol_map(s)), "taker_side")


@query("n3_normalize_force_orders", _PARSED.format(side="liquidated_side", of="liqs", x="binance"), T)
def _n3(s, d):
    return _event(N.normalize_force_orders(D.force_order_frames(s, d), D.symbol_map(s)), "liquidated_side")


@query("n4_normalize_public_trades", _PARSED.format(side="taker_side", of="trades", x="bybit"), T)
def _n4(s, d):
    return _event(N.normalize_public_trades(D.public_trade_frames(s, d), D.symbol_map(s)), "taker_side")


@query("n5_normalize_liquidations", _PARSED.format(side="liquidated_side", of="liqs", x="bybit"), T)
def _n5(s, d):
    return _event(N.normalize_liquidations(D.liquidation_frames(s, d), D.symbol_map(s)), "liquidated_side")


@query("n6_normalize_swap_trades", _PARSED.format(side="taker_side", of="trades", x="okx").replace("round(quantity, 6)", "round(quantity * 2 * 0.5, 6)"), T)
def _n6(s, d):
    return _event(N.normalize_swap_trades(D.swap_frames(s, d), D.symbol_map(s), N.contract_values(D.instruments(s))), "taker_side")


@query("n7_canonicalize", "SELECT arrival_seq, exchange, symbol FROM trades WHERE exchange = 'okx' AND symbol = 'BTCUSDT'", T)
def _n7(s, d):
    t = D.trades(s, d).where("exchange = 'okx'").withColumn("venue_symbol", F.lower("symbol")).drop("symbol", "exchange")
    return N.canonicalize(t, D.symbol_map(s).where("canonical = 'BTCUSDT'"), "okx").select("arrival_seq", "exchange", "symbol")


@query("n8_contract_values", "SELECT 'P' || p_partkey AS inst, CAST(CASE WHEN p_size % 7 = 0 THEN 1 ELSE p_size * 0.5 END AS DOUBLE) AS contract_value FROM part")
def _n8(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    meta = p.select(F.concat(F.lit("p"), "p_partkey").alias("instId"), F.when(F.col("p_size") % 7 == 0, "0").otherwise(F.col("p_size").cast("string")).alias("ctVal"), F.lit("0.5").alias("ctMult"))
    return N.contract_values(meta)


def _odd(s, d):
    return D.trades(s, d).withColumn("quantity", F.col("quantity") - 1).withColumn("symbol", F.when(F.col("arrival_seq") % 19 != 0, F.col("symbol")))


@query("n9_valid_events", "SELECT arrival_seq, arrival_seq % 17 <> 0 AND arrival_seq % 19 <> 0 AND exchange <> 'okx' AS valid FROM trades", T)
def _n9(s, d):
    odd = _odd(s, d).withColumn("exchange", F.when(F.col("exchange") == "okx", "other").otherwise("feed"))
    good, bad = N.valid_events(odd, symbols=["BTCUSDT", "ETHUSDT"], exchange="feed")
    return good.select("arrival_seq", F.lit(True).alias("valid")).unionByName(bad.select("arrival_seq", F.lit(False).alias("valid")))


@query("n10_quarantine_future", "SELECT arrival_seq, least(timestamp_ms, received_wall_ms) AS timestamp_ms, timestamp_ms > received_wall_ms AS clock_normalized FROM trades WHERE timestamp_ms - received_wall_ms <= 2000", T)
def _n10(s, d):
    return N.quarantine_future(D.trades(s, d), 2.0)[0].select("arrival_seq", "timestamp_ms", "clock_normalized")


@query("n11_clock_counters", "SELECT count(*) FILTER (timestamp_ms - received_wall_ms > 2000) AS quarantined_total, count(*) FILTER (timestamp_ms > received_wall_ms AND timestamp_ms - received_wall_ms <= 2000) AS normalized_total, max(received_wall_ms) FILTER (timestamp_ms - received_wall_ms > 2000) AS last_quarantine_ms, count(DISTINCT exchange || symbol) FILTER (timestamp_ms - received_wall_ms > 2000) AS feeds FROM trades", T)
def _n11(s, d):
    c = N.clock_counters(*N.quarantine_future(D.trades(s, d), 2.0))
    return c.select("quarantined_total", "normalized_total", "last_quarantine_ms", F.size("by_feed").cast("long").alias("feeds"))


@query("n12_normalize_external_alerts", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'warning' END AS severity, 'Ext' AS category, upper('sym' || user_id) AS symbol, CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'mixed' END AS direction,
 greatest(now - 300000, least(x, now)) AS timestamp_ms, x < now - 300000 OR x > now AS moved, 'src' || user_id % 3 AS exchange, 'External alert: ' || upper('sym' || user_id) AS title, 'm' || event_id AS message,
 'external:' || CASE WHEN event_id % 3 = 0 THEN 'external:k' || event_id ELSE 'src' || user_id % 3 || ':' || upper('sym' || user_id) || ':Ext:' || CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'mixed' END END AS dedup_key
 FROM (SELECT *, epoch_us(ts) // 1000 AS x, (SELECT max(epoch_us(ts) // 1000) FROM events) - 300000 AS now FROM events WHERE ts IS NOT NULL)""")
def _n12(s, d):
    e = s.read.parquet(f"{d}/events.parquet").where("ts is not null").withColumn("x", F.unix_millis(F.col("ts").cast("timestamp")))
    last = e.agg(F.max("x")).first()[0]
    k = F.col("event_id")
    body = F.struct(
        F.when(F.col("event_type") == "error", "CRITICAL").otherwise("odd").alias("severity"), F.lit("Ext").alias("category"), F.concat(F.lit("sym"), "user_id").alias("symbol"),
        F.when(k % 2 == 0, "UP").otherwise("sideways").alias("direction"), F.col("x").alias("timestamp_ms"), F.when(k % 3 == 0, F.concat(F.lit("external:k"), k)).alias("dedup_key"),
        F.concat(F.lit("src"), F.col("user_id") % 3).alias("source"), F.concat(F.lit("m"), k).alias("message"),
    )
    got = N.normalize_external_alerts(e.select(F.to_json(body).alias("payload"), F.lit(last - 300_000).alias("now_ms")))
    moved = F.coalesce(F.element_at("metrics", "_timestamp_normalized") == "true", F.lit(False))
    return got.select(F.substring("message", 2, 30).cast("long").alias("event_id"), "severity", "category", "symbol", "direction", "timestamp_ms", moved.alias("moved"), F.col("exchanges")[0].alias("exchange"), "title", "message", "dedup_key")


#: What the samples of n13 hold besides the event; eleven of the thirteen lists stay above the mark.
_N13 = ("k" * 120, "[" * 13, "]" * 13)


@query("n13_sanitize_json", f"""SELECT event_id, '{{"z":' || replace(props, ' ', '') || ',"b":{{"nan":null,"id":' || event_id || '}},"a":['
  || array_to_string(range(least(500, 450 + event_id % 100)), ',') || '],"{"k" * 100}":"' || event_type || '","d":{"[" * 11}"<maximum nesting reached>"{"]" * 11}}}' AS safe FROM events""")
def _n13_json(s, d):
    e = D._read(s, d, "events")
    long, opened, closed = _N13
    many = F.array_join(F.sequence(F.lit(0), (449 + F.col("event_id") % 100).cast("int")), ",")
    body = F.concat(
        F.lit('{"z":'), "props", F.lit(',"b":{"nan":NaN,"id":'), F.col("event_id").cast("string"), F.lit('},"a":['), many, F.lit(f'],"{long}":"'), "event_type",
        F.lit(f'","d":{opened}'), F.col("event_id").cast("string"), F.lit(closed + "}"),
    )
    return e.select("event_id", N.sanitize_json(body).alias("safe"))


@query("n13_sanitize_numbers", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value, 6) END AS a, round(value, 6) AS b FROM events")
def _n13(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    m = F.create_map(F.lit("a"), F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")), F.lit("b"), F.col("value"))
    return e.select("event_id", N.sanitize_numbers(m).alias("m")).select("event_id", F.round("m.a", 6).alias("a"), F.round("m.b", 6).alias("b"))


@query("n14_read_evidence", "SELECT count(*) AS lines, count(*) FILTER (event_id % 3 <> 0) AS valid, count(*) FILTER (event_id % 3 = 0) AS invalid FROM events WHERE ts IS NOT NULL")
def _n14(s, d):
    from tapewatch.sources.frames import read_evidence

    e = s.read.parquet(f"{d}/events.parquet").where("ts is not null")
    line = F.when(F.col("event_id") % 3 == 0, F.lit('{"timestamp": "no time"')).otherwise(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))))
    return read_evidence(e.select(line.alias("line")))[1]


# ---- E: event state


@query("e1_dedup_trades", """SELECT arrival_seq FROM (SELECT *, lag(arrival_seq) OVER (PARTITION BY exchange, symbol, arrival_seq // 12 ORDER BY arrival_seq) AS again FROM trades) WHERE again IS NULL""", T)
def _e1(s, d):
    t = D.trades(s, d).withColumn("event_id", F.concat(F.lit("t"), F.floor(F.col("arrival_seq") / 12)))
    return E.dedup_trades(t, 86_400 * 20).select("arrival_seq")


@query("e2_dedup_liquidations", "SELECT min(arrival_seq) AS arrival_seq FROM liqs GROUP BY arrival_seq // 9", T)
def _e2(s, d):
    t = D.liquidations(s, d).withColumn("event_id", F.concat(F.lit("l"), F.floor(F.col("arrival_seq") / 9)))
    return E.dedup_liquidations(t, 86_400 * 20).select("arrival_seq")


@query("e3_bucketize", "SELECT exchange, symbol, start_ms, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(quote_volume, 4) AS quote_volume, round(buy_quote_volume, 4) AS buy_quote_volume, round(sell_quote_volume, 4) AS sell_quote_volume, trades, first_trade_ms, last_trade_ms FROM bucket", T)
def _e3(s, d):
    b = E.bucketize(D.trades(s, d), 3600)
    return b.select("exchange", "symbol", "start_ms", *(r(c) for c in ("open", "high", "low", "close")), *(r(c, 4) for c in ("quote_volume", "buy_quote_volume", "sell_quote_volume")), "trades", "first_trade_ms", "last_trade_ms")


@query("e3_bucketize_lineitem", """SELECT s.n_name AS symbol, CAST(l_shipdate AS DATE) AS day, round(sum(l_extendedprice), 2) AS quote_volume, count(*) AS trades, round(max(l_extendedprice), 2) AS high, round(min(l_extendedprice), 2) AS low
 FROM lineitem JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) s ON s_suppkey = l_suppkey GROUP BY 1, 2""")
def _e3l(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag", "l_orderkey", "l_linenumber")
    sup = s.read.parquet(f"{d}/supplier.parquet").join(s.read.parquet(f"{d}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    t = li.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(F.lit("x").alias("exchange"), F.col("n_name").alias("symbol"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("timestamp_ms"), F.col("l_extendedprice").cast("double").alias("price"), F.lit(1.0).alias("quantity"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("taker_side"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("arrival_seq"))
    return E.bucketize(t, 86_400).select("symbol", F.to_date(F.timestamp_millis("start_ms")).alias("day"), r("quote_volume", 2), "trades", r("high", 2), r("low", 2))


@query("e4_drop_late", "SELECT arrival_seq FROM (SELECT *, max(x) OVER (PARTITION BY exchange, symbol ORDER BY arrival_seq) AS mx FROM (SELECT *, CASE WHEN arrival_seq % 23 = 0 THEN timestamp_ms - 200000000 ELSE timestamp_ms END AS x FROM trades)) WHERE mx - (x - x % 3600000) <= 86400000", T)
def _e4(s, d):
    t = D.trades(s, d).withColumn("timestamp_ms", F.when(F.col("arrival_seq") % 23 == 0, F.col("timestamp_ms") - 200_000_000).otherwise(F.col("timestamp_ms")))
    return E.drop_late(t, 86_400, 3600).select("arrival_seq")


@query("e5_data_age", """SELECT exchange, symbol, max(timestamp_ms) AS last_event_ms, arg_max(received_wall_ms, arrival_seq) AS last_received_ms, round(greatest((now - max(timestamp_ms)) / 1000.0, (now - arg_max(received_wall_ms, arrival_seq)) / 1000.0, 0), 6) AS data_age_seconds
 FROM (SELECT *, max(timestamp_ms) OVER (PARTITION BY exchange, symbol ORDER BY arrival_seq) AS front, 1706745600000 AS now FROM trades) WHERE timestamp_ms >= front GROUP BY exchange, symbol, now""", T)
def _e5(s, d):
    return E.data_age(D.trades(s, d), 1_706_745_600_000).select("exchange", "symbol", "last_event_ms", "last_received_ms", r("data_age_seconds"))


@query("e6_order_liquidations", "SELECT arrival_seq, row_number() OVER (PARTITION BY exchange, symbol ORDER BY timestamp_ms, arrival_seq) AS position FROM (SELECT *, max(timestamp_ms) OVER () AS m FROM liqs) WHERE timestamp_ms >= m - 864000000", T)
def _e6(s, d):
    return E.order_liquidations(D.liquidations(s, d), 864_000).select("arrival_seq", F.col("position").cast("long").alias("position"))


@query("e7_restore_buckets", "SELECT exchange, symbol, start_ms FROM (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY start_ms DESC) AS n FROM bucket WHERE start_ms BETWEEN 1706745600000 - 864000000 AND 1706745605000 AND exchange <> 'okx') WHERE n <= 244", T)
def _e7(s, d):
    b = E.bucketize(D.trades(s, d), 3600)
    allowed = D.symbol_map(s).where("exchange <> 'okx'").select("exchange", F.col("canonical").alias("symbol"))
    return E.restore_buckets(b, allowed, 1_706_745_600_000, 1_706_745_000_000, 3600, 864_000).select("exchange", "symbol", "start_ms")


# ---- C: continuity

_BR = ["exchange", "symbol", "start_ms", "end_ms", "reason"]


@query("c1_pair_breaks", "SELECT exchange, symbol, start_ms, end_ms, reason FROM breaks", T, B)
def _c1(s, d):
    return C.pair_breaks(D.continuity_log(s, d)).select(*_BR)


_WIDE = """wide AS (SELECT exchange, symbol, timestamp_ms AS start_ms, CASE WHEN arrival_seq % 8009 = 8000 THEN NULL ELSE timestamp_ms + (arrival_seq % 37) * 60000 END AS end_ms, 'r' || (arrival_seq % 4) AS reason FROM tick),
w1 AS (SELECT *, coalesce(end_ms, 9223372036854775807) AS e, max(coalesce(end_ms, 9223372036854775807)) OVER (PARTITION BY exchange, symbol ORDER BY start_ms, coalesce(end_ms, 9223372036854775807) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wide),
w2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY exchange, symbol ORDER BY start_ms, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM w1),
merged AS (SELECT exchange, symbol, min(start_ms) AS start_ms, nullif(max(e), 9223372036854775807) AS end_ms, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reason FROM w2 GROUP BY exchange, symbol, isl)"""


def _wide(s, d):
    t = D.ticks(s, d)
    end = F.when(F.col("arrival_seq") % 8009 != 8000, F.col("timestamp_ms") + (F.col("arrival_seq") % 37) * 60_000)
    return t.select("exchange", "symbol", F.col("timestamp_ms").alias("start_ms"), end.alias("end_ms"), F.concat(F.lit("r"), (F.col("arrival_seq") % 4).cast("string")).alias("reason"))


@query("c2_merge_breaks", "SELECT exchange, symbol, start_ms, end_ms, reason FROM merged", T, _WIDE)
def _c2(s, d):
    return C.merge_breaks(_wide(s, d)).select(*_BR)


@query("c3_overlaps_break", "SELECT exchange, symbol, start_ms FROM bucket a WHERE EXISTS (SELECT 1 FROM merged b WHERE a.exchange = b.exchange AND a.symbol = b.symbol AND b.start_ms <= a.last_trade_ms AND (b.end_ms IS NULL OR b.end_ms >= a.first_trade_ms))", T, _WIDE)
def _c3(s, d):
    return C.overlaps_break(E.bucketize(D.trades(s, d), 3600), C.merge_breaks(_wide(s, d)), "first_trade_ms", "last_trade_ms").select("exchange", "symbol", "start_ms")


_FB = "fb AS (SELECT exchange, symbol, timestamp_ms AS start_ms, arrival_seq // 500 AS generation, 'feed_disconnect' AS reason FROM tick)"


@query("c4_close_on_first_trade", "SELECT fb.exchange, fb.symbol, fb.start_ms, greatest(fb.start_ms + 1, min(t.received_wall_ms) FILTER (t.timestamp_ms >= fb.start_ms)) AS end_ms, fb.generation FROM fb LEFT JOIN trades t ON t.exchange = fb.exchange AND t.symbol = fb.symbol AND t.arrival_seq // 500 = fb.generation GROUP BY fb.exchange, fb.symbol, fb.start_ms, fb.generation".replace("greatest(fb.start_ms + 1, min(t.received_wall_ms) FILTER (t.timestamp_ms >= fb.start_ms))", "CASE WHEN min(t.received_wall_ms) FILTER (t.timestamp_ms >= fb.start_ms) IS NOT NULL THEN greatest(fb.start_ms + 1, min(t.received_wall_ms) FILTER (t.timestamp_ms >= fb.start_ms)) END"), T, _FB)
def _c4(s, d):
    fb = D.ticks(s, d).select("exchange", "symbol", F.col("timestamp_ms").alias("start_ms"), F.col("continuity_generation").alias("generation"), F.lit("feed_disconnect").alias("reason"))
    return C.close_on_first_trade(fb, D.trades(s, d)).select("exchange", "symbol", "start_ms", "end_ms", "generation")


@query("c5_fan_out_breaks", "SELECT t.exchange, m.symbol, t.timestamp_ms FROM tick t, (VALUES ('BTCUSDT'), ('ETHUSDT')) m(symbol)", T)
def _c5(s, d):
    log = D.ticks(s, d).select("exchange", F.lit("start").alias("phase"), "timestamp_ms", F.lit("x").alias("reason"), F.lit(None).cast("string").alias("symbol"))
    return C.fan_out_breaks(log, D.symbol_map(s)).select("exchange", "symbol", "timestamp_ms")


def _feed_log(s, d):
    kinds = F.array(*(F.lit(k) for k in ("process_start", "feed_disconnect", "connect", "queue_drop", "reconnect")))
    t = D.ticks(s, d)
    return t.select("exchange", F.element_at(kinds, (F.col("arrival_seq") % 5).cast("int") + 1).alias("kind"), "timestamp_ms")


_FL = "fl AS (SELECT exchange, ['process_start','feed_disconnect','connect','queue_drop','reconnect'][1 + arrival_seq % 5] AS kind, timestamp_ms FROM tick)"


@query("c6_loss_breaks", "SELECT exchange, timestamp_ms, kind AS reason, count(*) OVER (PARTITION BY exchange ORDER BY timestamp_ms, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS generation FROM fl WHERE kind IN ('process_start', 'feed_disconnect', 'queue_drop')", T, _FL)
def _c6(s, d):
    return C.loss_breaks(_feed_log(s, d)).select("exchange", "timestamp_ms", "reason", "generation")


def _receipts_of_clock(s, d):
    t = D.ticks(s, d)
    drift = F.when(F.floor(F.col("arrival_seq") / 300) % 3 == 1, 60_000).otherwise(0)
    return t.select(F.col("exchange").alias("source"), (F.col("timestamp_ms") + drift).alias("wall_ms"), (F.col("timestamp_ms") / 1000.0).alias("monotonic_s"))


@query("c7_runtime_pauses", "SELECT exchange AS source, greatest(timestamp_ms - ((timestamp_ms - p) - 900000), 1) AS start_ms, timestamp_ms AS end_ms FROM (SELECT *, lag(timestamp_ms) OVER (PARTITION BY exchange ORDER BY timestamp_ms) AS p FROM tick) WHERE (timestamp_ms - p) - 900000 > 600000", T)
def _c7(s, d):
    t = D.ticks(s, d).select(F.col("exchange").alias("source"), F.col("timestamp_ms").alias("wall_ms"), (F.col("timestamp_ms") / 1000.0).alias("monotonic_s"))
    return C.runtime_pauses(t, 900, 600).select("source", "start_ms", "end_ms")


@query("c8_clock_jumps")
def _c8(s, d):
    return C.clock_jumps(_receipts_of_clock(s, d), 5.0)


@query("c9_downtime_breaks", "SELECT DISTINCT exchange, symbol, CAST(1704067200000 AS BIGINT) AS start_ms, 'checkpoint_downtime' AS reason FROM trades", T)
def _c9(s, d):
    return C.downtime_breaks(D.trades(s, d), 1_704_067_200_000, 1_704_067_300_000).select("exchange", "symbol", "start_ms", "reason")


_SEG = """seg AS (SELECT exchange, symbol, idx, timestamp_ms AS t, 21600000 AS w, price_start_ms AS pst FROM pt),
mt AS (SELECT g.*, b.start_ms AS bs, (b.end_ms IS NULL OR b.end_ms > g.t) AS op, CASE WHEN b.end_ms IS NULL OR b.end_ms > g.t THEN g.t ELSE b.end_ms END AS en FROM seg g JOIN merged b ON b.exchange = g.exchange AND b.symbol = g.symbol
 AND (b.start_ms < g.t OR ((b.end_ms IS NULL OR b.end_ms > g.t) AND b.start_ms <= g.t)) AND ((b.end_ms IS NULL OR b.end_ms > g.t) OR b.end_ms > coalesce(g.pst, g.t - g.w))),
pr AS (SELECT exchange, symbol, idx, bool_or(op) AS op, max(en - bs) AS gap, sum(greatest(least(en, t) - greatest(bs, t - w), 0)) AS lost FROM mt GROUP BY 1, 2, 3)"""


@query("c10_segment_continuity", "SELECT seg.exchange, seg.symbol, seg.idx, round(1 - least(coalesce(lost, 0), w) / w, 9) AS coverage_ratio, round(coalesce(gap, 0) / 1000.0, 6) AS largest_gap_seconds, NOT coalesce(op, false) AND coalesce(gap, 0) / 1000.0 <= 14400 AND 1 - least(coalesce(lost, 0), w) / w >= 0.3 AS continuous FROM seg LEFT JOIN pr ON pr.exchange = seg.exchange AND pr.symbol = seg.symbol AND pr.idx = seg.idx", T, _WIDE, M, _SEG)
def _c10(s, d):
    g = D.GRID
    p = W.window_columns(W.grid(E.bucketize(D.trades(s, d), g.bucket_seconds), g.bucket_seconds), g)
    seg = p.select("exchange", "symbol", "idx", F.col("timestamp_ms").alias("t_ms"), F.lit(g.window_seconds * 1000).cast("long").alias("w_ms"), "price_start_ms", F.concat_ws("|", "exchange", "symbol", "idx").alias("seg_id"))
    return C.segment_continuity(seg, C.merge_breaks(_wide(s, d)), g.max_gap_seconds, g.min_coverage).select("exchange", "symbol", "idx", r("coverage_ratio", 9), r("largest_gap_seconds"), "continuous")


# ---- W: window metrics


def _buckets(s, d):
    return E.bucketize(D.trades(s, d), D.GRID.bucket_seconds)


def _metrics(s, d):
    return W.metric_snapshots(_buckets(s, d), None, D.GRID, every=6)


@query("w1_asof_price", "SELECT l.arrival_seq, round((SELECT arg_max(b.close, b.last_trade_ms) FROM bucket b WHERE b.exchange = l.exchange AND b.symbol = l.symbol AND b.last_trade_ms <= l.timestamp_ms), 6) AS price FROM liqs l", T)
def _w1(s, d):
    liq = D.liquidations(s, d).drop("price")
    got = W.asof_price(_buckets(s, d), liq.select("exchange", "symbol", F.col("timestamp_ms").alias("t_ms")).distinct())
    return liq.join(got, (liq["exchange"] == got["exchange"]) & (liq["symbol"] == got["symbol"]) & (liq["timestamp_ms"] == got["t_ms"])).select("arrival_seq", r("price"))


@query("w2_w4_window_columns", "SELECT exchange, symbol, idx, round(price, 6) AS price, round(ret, 8) AS ret, round(volume, 4) AS volume, round(buy, 4) AS buy, round(sell, 4) AS sell, CAST(n_trades AS BIGINT) AS n_trades, round(imbalance, 6) AS imbalance FROM pt", T, M)
def _w2(s, d):
    p = W.window_columns(W.grid(_buckets(s, d), D.GRID.bucket_seconds), D.GRID).withColumn("imbalance", W.taker_imbalance(F.col("buy"), F.col("sell")))
    return p.select("exchange", "symbol", "idx", r("price"), r("ret", 8), r("volume", 4), r("buy", 4), r("sell", 4), "n_trades", r("imbalance"))


@query("w5_baseline_samples", "SELECT p.exchange, p.symbol, p.idx, coalesce(np, 0) AS points, round(mr, 8) AS median_return FROM pt p LEFT JOIN smp s ON s.exchange = p.exchange AND s.symbol = p.symbol AND s.idx = p.idx WHERE (p.idx + 1) % 6 = 0", T, M)
def _w5(s, d):
    from tapewatch.functions.stats import array_median

    p = W.window_columns(W.grid(_buckets(s, d), D.GRID.bucket_seconds), D.GRID).withColumn("hist", F.lit(True))
    b = W.baseline_samples(p, D.GRID).where("(idx + 1) % 6 = 0")
    return b.select("exchange", "symbol", "idx", F.size("sample").cast("long").alias("points"), F.round(array_median(F.transform("sample", lambda x: x["ret"])), 8).alias("median_return"))


@query("w9_metric_snapshots", "SELECT timestamp_ms, exchange, symbol, readiness_reason, readiness_reason = 'ready' AS ready, round(price, 6) AS price, round(return_bps, 4) AS return_bps, round(return_z, 4) AS return_z, round(quote_volume, 4) AS quote_volume, round(volume_z, 4) AS volume_z, round(taker_imbalance, 6) AS taker_imbalance, CAST(trades AS BIGINT) AS trades, CAST(baseline_points AS INTEGER) AS baseline_points, round(data_age_seconds, 3) AS data_age_seconds FROM met", T, M)
def _w9(s, d):
    m = _metrics(s, d)
    return m.select("timestamp_ms", "exchange", "symbol", "readiness_reason", "ready", r("price"), r("return_bps", 4), r("return_z", 4), r("quote_volume", 4), r("volume_z", 4), r("taker_imbalance"), "trades", "baseline_points", r("data_age_seconds", 3))


@query("w9_metric_snapshots_with_breaks")
def _w9b(s, d):
    pairs = D.symbol_map(s).select("exchange", F.col("canonical").alias("symbol"))
    return W.metric_snapshots(_buckets(s, d), C.merge_breaks(_wide(s, d)), D.GRID, every=6, pairs=pairs)


@query("w10_latest_prices", "SELECT symbol, exchange, round(price, 6) AS price FROM (SELECT symbol, exchange, arg_max(close, start_ms) AS price, max(last_trade_ms) AS a FROM bucket WHERE last_trade_ms <= 1705276800000 GROUP BY 1, 2) WHERE 1705276800000 - a <= 86400000", T)
def _w10(s, d):
    return W.latest_prices(_buckets(s, d), 1_705_276_800_000, 86_400).select("symbol", F.explode("prices").alias("exchange", "price")).select("symbol", "exchange", r("price"))


_LW = """lt AS (SELECT l.*, unnest(range(timestamp_ms // 3600000, (timestamp_ms + 21600001) // 3600000)) AS k FROM liqs l), lw0 AS (SELECT *, (k + 1) * 3600000 - 1 AS t_ms FROM lt),
lw1 AS (SELECT t_ms, symbol, exchange, sum(price * quantity) AS usd, sum(CASE WHEN liquidated_side = 'long' THEN price * quantity ELSE 0 END) AS long_usd, count(*) AS events FROM lw0 WHERE timestamp_ms <= t_ms AND timestamp_ms >= t_ms - 21600000 GROUP BY 1, 2, 3),
lw AS (SELECT t_ms, symbol, sum(usd) AS total_usd, sum(long_usd) AS long_usd, sum(events) AS events, count(*) AS venues, CASE WHEN sum(long_usd) > sum(usd) - sum(long_usd) THEN 'down' WHEN sum(long_usd) < sum(usd) - sum(long_usd) THEN 'up' ELSE 'mixed' END AS direction FROM lw1 GROUP BY 1, 2)"""


def _liq(s, d):
    return W.liquidation_window(D.liquidations(s, d), 21_600, 3600)


@query("w11_liquidation_window", "SELECT t_ms, symbol, round(total_usd, 4) AS total_usd, round(long_usd, 4) AS long_usd, CAST(events AS BIGINT) AS events, venues, direction FROM lw", T, _LW)
def _w11(s, d):
    return _liq(s, d).select("t_ms", "symbol", r("total_usd", 4), r("long_usd", 4), "events", F.size("exchanges").cast("long").alias("venues"), "direction")


# ---- R: rules

_CAND = """cd AS (SELECT *, CASE WHEN return_bps > 0 THEN 'up' ELSE 'down' END AS direction, CASE
 WHEN readiness_reason = 'ready' AND abs(return_bps) >= 100 AND abs(return_z) >= 2 AND (volume_z >= 1 OR (abs(taker_imbalance) >= 0.3 AND return_bps * taker_imbalance > 0)) THEN 'critical'
 WHEN readiness_reason = 'ready' AND abs(return_bps) >= 60 AND abs(return_z) >= 1 AND (volume_z >= 0.5 OR (abs(taker_imbalance) >= 0.3 AND return_bps * taker_imbalance > 0)) THEN 'warning'
 WHEN readiness_reason = 'baseline_warmup' AND abs(return_bps) >= 175 THEN 'warning' END AS level FROM met WHERE data_age_seconds BETWEEN 0 AND 7200),
cand AS (SELECT * FROM cd WHERE level IS NOT NULL)"""
_CONF = """sides AS (SELECT timestamp_ms, symbol, direction, count(*) AS n, count(DISTINCT exchange) AS confirmations, bool_or(level = 'critical') AS anyc, min(abs(return_bps)) AS least, median(return_bps) AS median_return_bps, max(abs(return_z)) AS max_abs_return_z FROM cand GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY timestamp_ms, symbol ORDER BY n DESC, CASE WHEN direction = 'up' THEN 0 ELSE 1 END) AS k FROM sides),
conf AS (SELECT *, CASE WHEN confirmations >= 2 AND (anyc OR least >= 100) THEN 'critical' WHEN confirmations >= 1 THEN 'warning' END AS severity FROM best WHERE k = 1)"""


@query("r1_passes", "SELECT timestamp_ms, exchange, symbol FROM cand WHERE level IN ('warning', 'critical') AND readiness_reason = 'ready'", T, M, _CAND)
def _r1(s, d):
    return _metrics(s, d).where(R.passes(D.WARNING) & (F.col("data_age_seconds") <= 7200)).select("timestamp_ms", "exchange", "symbol")


@query("r2_candidates", "SELECT timestamp_ms, exchange, symbol, level, direction FROM cand", T, M, _CAND)
def _r2(s, d):
    return R.candidates(_metrics(s, d), D.RULES).select("timestamp_ms", "exchange", "symbol", "level", "direction")


def _confirmed(s, d):
    return R.confirm(R.candidates(_metrics(s, d), D.RULES), D.RULES)


@query("r3_confirm", "SELECT timestamp_ms, symbol, direction, confirmations, severity FROM conf", T, M, _CAND, _CONF)
def _r3(s, d):
    return _confirmed(s, d).select("timestamp_ms", "symbol", "direction", "confirmations", "severity")


@query("r4_price_alerts", "SELECT timestamp_ms, symbol, severity, 'market:' || symbol || ':' || direction || ':21600' AS dedup_key, round(median_return_bps, 4) AS median_return_bps, round(max_abs_return_z, 4) AS max_abs_return_z FROM conf", T, M, _CAND, _CONF)
def _r4(s, d):
    return R.price_alerts(_confirmed(s, d)).select("timestamp_ms", "symbol", "severity", "dedup_key", r("median_return_bps", 4), r("max_abs_return_z", 4))


@query("r5_liquidation_alerts", "SELECT t_ms AS timestamp_ms, symbol, CASE WHEN total_usd >= 12000 OR venues >= 3 THEN 'critical' ELSE 'warning' END AS severity, 'liquidation:' || symbol || ':' || direction AS dedup_key FROM lw WHERE total_usd >= 8000", T, _LW)
def _r5(s, d):
    return R.liquidation_alerts(_liq(s, d), D.RULES).select("timestamp_ms", "symbol", "severity", "dedup_key")


_SPR = """spr AS (SELECT timestamp_ms, symbol, (max(price) - min(price)) / median(price) * 10000 AS spread_bps, count(DISTINCT exchange) AS v, arg_min(exchange, (price, exchange)) AS low_venue, arg_max(exchange, (price, exchange)) AS high_venue FROM met WHERE readiness_reason = 'ready' AND data_age_seconds BETWEEN 0 AND 7200 GROUP BY 1, 2)"""


@query("r6_spread_alerts", "SELECT timestamp_ms, symbol, round(spread_bps, 4) AS spread_bps, CASE WHEN spread_bps >= 120 THEN 'critical' ELSE 'warning' END AS severity, low_venue, high_venue FROM spr WHERE v >= 2 AND spread_bps >= 40", T, M, _SPR)
def _r6(s, d):
    return R.spread_alerts(_metrics(s, d), D.RULES).select("timestamp_ms", "symbol", r("spread_bps", 4), "severity", "low_venue", "high_venue")


@query("r7_strongest_window", "SELECT timestamp_ms, symbol, severity, direction FROM conf", T, M, _CAND, _CONF)
def _r7(s, d):
    return R.strongest_window(R.price_alerts(_confirmed(s, d))).select("timestamp_ms", "symbol", "severity", "direction")


_SHOCK = """pa AS (SELECT timestamp_ms, symbol, severity, direction, 'market:' || symbol || ':' || direction || ':21600' AS dedup_key FROM conf),
la AS (SELECT t_ms AS timestamp_ms, symbol, CASE WHEN total_usd >= 12000 OR venues >= 3 THEN 'critical' ELSE 'warning' END AS severity, direction, 'liquidation:' || symbol || ':' || direction AS dedup_key FROM lw WHERE total_usd >= 8000),
sh AS (SELECT pa.timestamp_ms, pa.symbol, CASE WHEN la.direction IS NOT NULL AND pa.severity = 'warning' THEN 'critical' ELSE pa.severity END AS severity, CASE WHEN la.direction IS NOT NULL THEN 'market_shock' ELSE 'price' END AS category, pa.direction, pa.dedup_key FROM pa LEFT JOIN la ON la.timestamp_ms = pa.timestamp_ms AND la.symbol = pa.symbol AND la.direction = pa.direction AND la.direction <> 'mixed'
 UNION ALL SELECT la.timestamp_ms, la.symbol, la.severity, 'liquidation', la.direction, la.dedup_key FROM la WHERE NOT EXISTS (SELECT 1 FROM pa WHERE la.timestamp_ms = pa.timestamp_ms AND la.symbol = pa.symbol AND la.direction = pa.direction AND la.direction <> 'mixed'))"""


@query("r8_merge_shock", "SELECT * FROM sh", T, M, _CAND, _CONF, _LW, _SHOCK)
def _r8(s, d):
    merged = R.merge_shock(R.strongest_window(R.price_alerts(_confirmed(s, d))), R.liquidation_alerts(_liq(s, d), D.RULES))
    return merged.select("timestamp_ms", "symbol", "severity", "category", "direction", "dedup_key")


@query("r9_evaluate", "SELECT timestamp_ms, symbol, severity, category, direction, dedup_key FROM sh UNION ALL SELECT timestamp_ms, symbol, CASE WHEN spread_bps >= 120 THEN 'critical' ELSE 'warning' END, 'spread', 'mixed', 'spread:' || symbol FROM spr WHERE v >= 2 AND spread_bps >= 40", T, M, _CAND, _CONF, _LW, _SHOCK, _SPR)
def _r9(s, d):
    return R.evaluate(_metrics(s, d), _liq(s, d), D.RULES).select("timestamp_ms", "symbol", "severity", "category", "direction", "dedup_key")


# ---- A: alert life cycle

_RANK = "CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END"


@query("a1_apply_cooldown", f"""WITH RECURSIVE {AL.strip()}, num AS (SELECT dedup_key, timestamp_ms, sequence, {_RANK} AS rank, row_number() OVER (PARTITION BY dedup_key ORDER BY timestamp_ms, sequence) AS k FROM al),
fold AS (SELECT dedup_key, k, timestamp_ms AS at, rank AS best, sequence, true AS emitted FROM num WHERE k = 1 UNION ALL
 SELECT n.dedup_key, n.k, CASE WHEN n.rank <= f.best AND n.timestamp_ms - f.at < 43200000 THEN f.at ELSE n.timestamp_ms END, CASE WHEN n.rank <= f.best AND n.timestamp_ms - f.at < 43200000 THEN f.best ELSE n.rank END, n.sequence, NOT (n.rank <= f.best AND n.timestamp_ms - f.at < 43200000) FROM fold f JOIN num n ON n.dedup_key = f.dedup_key AND n.k = f.k + 1)
SELECT sequence FROM fold WHERE emitted""")
def _a1(s, d):
    return A.apply_cooldown(D.alerts(s, d), 43_200).select("sequence")


@query("a2_restore_cooldown", "SELECT dedup_key, least(max(timestamp_ms), 1705276800000) AS timestamp_ms FROM al GROUP BY 1", AL)
def _a2(s, d):
    return A.restore_cooldown(D.alerts(s, d), 1_705_276_800_000).select("dedup_key", "timestamp_ms")


@query("a3_release_failed_cooldown")
def _a3(s, d):
    return A.release_failed_cooldown(A.restore_cooldown(D.alerts(s, d), 1_705_276_800_000), D.jobs(s, d))


@query("a4_route", f"SELECT id, channel FROM al, (VALUES ('local', 1), ('push', 2), ('web', 0)) c(channel, least) WHERE {_RANK} >= least", AL)
def _a4(s, d):
    return A.route(D.alerts(s, d), [Channel("local", "warning"), Channel("push", "critical"), Channel("web", "info"), Channel("off", "info", False)]).select("id", "channel")


@query("a5_pending_order", "SELECT id, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, sequence) AS position FROM al QUALIFY position <= 200", AL)
def _a5(s, d):
    return A.pending_order(D.alerts(s, d), 200).select("id", F.col("position").cast("long").alias("position"))


@query("a6_sample_metrics", "SELECT exchange, symbol, timestamp_ms FROM met WHERE (timestamp_ms - (SELECT min(timestamp_ms) FROM met)) % 64800000 = 0", T, M)
def _a6(s, d):
    return A.sample_metrics(_metrics(s, d), 64_800).select("exchange", "symbol", "timestamp_ms")


@query("a7_latest_per_key", "SELECT dedup_key, max(sequence) AS sequence FROM al GROUP BY 1", AL)
def _a7(s, d):
    a = D.alerts(s, d)
    return A.latest_per_key(a.where("sequence % 2 = 0"), a.where("sequence % 2 = 1"), ["dedup_key"]).select("dedup_key", "sequence")


@query("a8_sink_receipts", "SELECT id, greatest(attempt - 1, 0) AS attempt, channel FROM rc", AL)
def _a8(s, d):
    return A.sink_receipts(D.receipts(s, d).withColumn("attempt", F.col("attempt") - 1)).select("id", "attempt", "channel")


@query("a9_job_state", "SELECT original_dedup_key AS alert_id, arg_max(status, (updated_ms, attempt, CAST(alert_id AS BIGINT))) AS status, max(updated_ms) AS updated_ms FROM jb GROUP BY 1", AL)
def _a9(s, d):
    return A.job_state(D.jobs(s, d).withColumn("alert_id", F.col("original_dedup_key"))).select("alert_id", "status", "updated_ms")


@query("a10_receipt_counts", "SELECT channel, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'failure') AS n_failure, max(timestamp_ms) AS last_ms, arg_max(status, (timestamp_ms, id)) FILTER (status IN ('success', 'failure')) AS last_outcome FROM rc GROUP BY 1", AL)
def _a10(s, d):
    return A.receipt_counts(D.receipts(s, d)).select("channel", "n_success", "n_failure", "last_ms", "last_outcome")


# ---- P: persisted tables


@query("p1_list_alerts", "SELECT id, timestamp_ms FROM al ORDER BY timestamp_ms DESC, sequence DESC LIMIT 1000", AL)
def _p1(s, d):
    return P.list_alerts(D.alerts(s, d), 5000).select("id", "timestamp_ms")


@query("p2_recent_dedup", """SELECT dedup_key, timestamp_ms FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY timestamp_ms DESC, restores) AS n FROM (SELECT dedup_key, timestamp_ms, 1 AS restores FROM al UNION ALL
 SELECT original_dedup_key, jb.updated_ms, CASE WHEN status = 'success' THEN 1 ELSE 0 END FROM jb JOIN al a ON a.id = jb.alert_id)) WHERE n = 1 AND restores = 1""", AL)
def _p2(s, d):
    return P.recent_dedup(D.alerts(s, d), D.jobs(s, d), 0, None).select("dedup_key", "timestamp_ms")


@query("p3_pending_alarms", "SELECT jb.alert_id, jb.priority FROM jb JOIN al ON al.id = jb.alert_id WHERE status IN ('queued', 'attempt') AND jb.alert_id NOT IN (SELECT alert_id FROM rc WHERE channel = 'push') ORDER BY priority, updated_ms, timestamp_ms, jb.alert_id LIMIT 500", AL)
def _p3(s, d):
    j = D.jobs(s, d)
    return P.pending_alarms(j, D.alerts(s, d), 500, D.receipts(s, d).where("channel = 'push'").select("alert_id").distinct()).select("alert_id", "priority")


@query("p4_list_metrics", "SELECT timestamp_ms, exchange FROM met WHERE symbol = 'BTCUSDT' ORDER BY timestamp_ms DESC, exchange LIMIT 100", T, M)
def _p4(s, d):
    return P.list_metrics(_metrics(s, d), symbol="BTCUSDT", limit=100).select("timestamp_ms", "exchange")


@query("p5_list_receipts", "SELECT id, status FROM rc ORDER BY timestamp_ms DESC, id DESC LIMIT 2000", AL)
def _p5(s, d):
    return P.list_receipts(D.receipts(s, d), limit=9999).select("id", "status")


@query("p6_latest_outcome", "SELECT channel, arg_max(id, (timestamp_ms, id)) AS id, arg_max(status, (timestamp_ms, id)) AS status FROM rc WHERE status IN ('success', 'failure') GROUP BY 1", AL)
def _p6(s, d):
    return P.latest_outcome(D.receipts(s, d)).select("channel", "id", "status")


@query("p7_latest_local_outcome", "SELECT alert_id, status, updated_ms FROM jb WHERE status IN ('success', 'failure') ORDER BY updated_ms DESC, alert_id LIMIT 1", AL)
def _p7(s, d):
    j = D.jobs(s, d)
    return P.latest_local_outcome(j.where("false"), j)


@query("p8_prune", "SELECT id FROM rc WHERE timestamp_ms >= 1705276800000", AL)
def _p8(s, d):
    return P.prune(D.receipts(s, d), 1_705_276_800_000)[0].select("id")


@query("p9_change_feed", "SELECT sequence FROM al WHERE sequence > 250 ORDER BY sequence LIMIT 200", AL)
def _p9(s, d):
    return P.change_feed(D.alerts(s, d), "e:250", "e", 999)[0].select("sequence")


@query("p10_alert_kind", "SELECT id, CASE WHEN category = 'system_test' THEN 'test' WHEN category IN ('monitoring_gap', 'feed_health', 'runtime_health') OR symbol = 'SYSTEM' THEN 'monitoring' WHEN source <> 'detector' THEN 'external' ELSE 'market' END AS kind FROM al", AL)
def _p10(s, d):
    return D.alerts(s, d).select("id", P.alert_kind().alias("kind"))


@query("p11_feed_metadata", "SELECT exchange, arrival_seq % 2 = 0 AS connected, CASE WHEN arrival_seq % 11 >= 3 THEN (arrival_seq % 11 - 3) * 1.0 END AS message_age_seconds, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS time FROM tick", T)
def _p11(s, d):
    t = D.ticks(s, d).select("exchange", (F.col("arrival_seq") % 2 == 0).alias("connected"), F.lit(True).alias("subscription_acknowledged"), ((F.col("received_wall_ms") - F.col("timestamp_ms")) / 1000.0).alias("message_age_seconds"), "timestamp_ms")
    return P.feed_metadata(t).select("exchange", "connected", "message_age_seconds", "time")


@query("p12_filter_alerts", "SELECT id FROM al WHERE symbol = 'BTCUSDT' AND severity = 'critical' AND lower(title || ' ' || message) LIKE '%purchase%' AND timestamp_ms >= 1704500000000", AL)
def _p12(s, d):
    return P.filter_alerts(D.alerts(s, d), symbol="BTCUSDT", severity="critical", since_ms=1_704_500_000_000, text="PURCHASE").select("id")


# ---- H: health


def _messages(s, d):
    return D.ticks(s, d).select("exchange", "symbol", F.when(F.col("event_type") == "error", "liquidation").otherwise("trade").alias("kind"), "received_wall_ms")


_H1 = """lg AS (SELECT exchange, max(timestamp_ms) FILTER (kind IN ('connect', 'reconnect')) AS c, count(*) FILTER (kind = 'reconnect') AS reconnects, count(*) FILTER (kind = 'queue_drop') AS drops FROM fl GROUP BY 1),
bs AS (SELECT t.exchange, symbol, count(*) AS messages, count(*) FILTER (event_type <> 'error') AS trades, count(*) FILTER (event_type = 'error') AS liquidations, max(CASE WHEN received_wall_ms >= coalesce(c, 0) THEN received_wall_ms END) AS last_ms FROM tick t LEFT JOIN lg ON lg.exchange = t.exchange GROUP BY 1, 2)"""


@query("h1_feed_counters", "SELECT exchange, symbol, messages, trades, liquidations, last_ms, CASE WHEN last_ms IS NOT NULL THEN round(greatest((1707000000000 - last_ms) / 1000.0, 0), 2) END AS age_seconds FROM bs", T, _FL, _H1)
def _h1(s, d):
    return H.feed_counters(_messages(s, d), _feed_log(s, d), 1_707_000_000_000)[1]


@query("h2_feed_ages", "SELECT exchange, CASE WHEN bool_and(last_ms IS NOT NULL) THEN max(round(greatest((1707000000000 - last_ms) / 1000.0, 0), 2)) END AS message_age_seconds, min(CASE WHEN last_ms IS NOT NULL THEN round(greatest((1707000000000 - last_ms) / 1000.0, 0), 2) END) AS latest_age_seconds FROM bs GROUP BY 1", T, _FL, _H1)
def _h2(s, d):
    by = H.feed_counters(_messages(s, d), _feed_log(s, d), 1_707_000_000_000)[1]
    return H.feed_ages(by, _messages(s, d)).select("exchange", "message_age_seconds", "latest_age_seconds")


@query("h3_subscription_status", "SELECT o_custkey AS exchange, bool_and(o_orderkey % 3 <> 0) AS subscription_acknowledged, count(*) FILTER (o_orderkey % 3 = 0) AS missing FROM orders GROUP BY 1")
def _h3(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("exchange"), F.col("o_orderkey").cast("string").alias("t"), (F.col("o_orderkey") % 3 != 0).alias("ok"))
    sub = H.subscription_status(o.groupBy("exchange").agg(F.collect_set("t").alias("topics")), o.where("ok").groupBy("exchange").agg(F.collect_set("t").alias("topics")))
    return sub.select("exchange", "subscription_acknowledged", F.size("missing_topics").cast("long").alias("missing"))


def _health_history(s, d):
    t = D.ticks(s, d)
    return t.select("exchange", (F.col("timestamp_ms") * 2 + F.col("arrival_seq") % 2).alias("timestamp_ms"), (F.floor(F.col("arrival_seq") / 5) % 4 != 0).alias("healthy"), (F.col("arrival_seq") % 50).cast("double").alias("age_seconds"))


_HH = "hh AS (SELECT exchange, timestamp_ms * 2 + arrival_seq % 2 AS timestamp_ms, (arrival_seq // 5) % 4 = 0 AS bad, arrival_seq % 50 AS age FROM tick), h2 AS (SELECT *, coalesce(lag(bad) OVER (PARTITION BY exchange ORDER BY timestamp_ms), false) AS was FROM hh)"


@query("h5_feed_health_alerts", "SELECT timestamp_ms, exchange, CASE WHEN NOT bad THEN 'info' WHEN age > 30 THEN 'critical' ELSE 'warning' END AS severity, NOT bad OR NOT was AS bypass, CASE WHEN bad THEN 'feed_health' ELSE 'feed_recovery' END AS category, 'health:' || exchange || CASE WHEN bad THEN ':unhealthy' ELSE ':recovered:' || timestamp_ms END AS dedup_key FROM h2 WHERE bad OR was", T, _HH)
def _h5(s, d):
    return H.feed_health_alerts(_health_history(s, d), 10).select("timestamp_ms", "exchange", "severity", "bypass", "category", "dedup_key")


@query("h4_feed_readiness", "SELECT timestamp_ms, exchange, (CASE WHEN bad THEN 1 ELSE 0 END) + (CASE WHEN age > 10 THEN 1 ELSE 0 END) AS n FROM h2", T, _HH)
def _h4(s, d):
    f = _health_history(s, d).select("timestamp_ms", "exchange", F.col("healthy").alias("connected"), F.lit(True).alias("subscription_acknowledged"), F.lit(False).alias("open_break"), F.col("age_seconds").alias("message_age_seconds"))
    return H.feed_readiness(f, 10).select("timestamp_ms", "exchange", F.size("reasons").alias("n"))


@query("h6_pipeline_health_alerts", """SELECT source, timestamp_ms, CASE WHEN NOT bad THEN 'info' WHEN nd > 0 OR size >= 95 OR lg > 30 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN bad THEN 'runtime_health' ELSE 'runtime_recovery' END AS category,
 'runtime:market-queue:' || CASE WHEN bad THEN 'unhealthy' ELSE 'recovered:' || timestamp_ms END AS dedup_key, NOT bad OR NOT coalesce(was, false) OR nd > 0 AS bypass, CAST(nd AS BIGINT) AS new_drops FROM (SELECT *, lag(bad) OVER (PARTITION BY source ORDER BY timestamp_ms, arrival_seq) AS was FROM (SELECT *, nd > 0 OR size >= 80 OR lg > 10 AS bad
 FROM (SELECT *, greatest(drops - coalesce(lag(drops) OVER (PARTITION BY source ORDER BY timestamp_ms, arrival_seq), 0), 0) AS nd FROM (SELECT exchange AS source, timestamp_ms, arrival_seq, arrival_seq % 100 AS size, arrival_seq // 1000 AS drops, arrival_seq % 37 AS lg FROM tick)))) WHERE bad OR was""", T)
def _h6(s, d):
    t = D.ticks(s, d)
    samples = t.select(F.col("exchange").alias("source"), "timestamp_ms", (F.col("arrival_seq") % 100).alias("size"), F.lit(100).alias("capacity"), F.floor(F.col("arrival_seq") / 1000).alias("drops_total"), (F.col("arrival_seq") % 37).cast("double").alias("lag_seconds"))
    return H.pipeline_health_alerts(samples, 5.0).select("source", "timestamp_ms", "severity", "category", "dedup_key", "bypass", F.col("new_drops").cast("long").alias("new_drops"))


@query("h7_continuity_episodes")
def _h7(s, d):
    return H.continuity_episodes(W.metric_snapshots(_buckets(s, d), C.merge_breaks(_wide(s, d).where("end_ms is not null")), D.GRID, every=6), 7200)


@query("h8_market_status", """SELECT symbol, round(median(CASE WHEN age_ok THEN price END), 6) AS median_price, count(*) AS configured_venues, count(*) FILTER (readiness_reason = 'ready' AND age_ok) AS ready_venues FROM (SELECT *, data_age_seconds BETWEEN 0 AND 7200 AS age_ok, row_number() OVER (PARTITION BY exchange, symbol ORDER BY timestamp_ms DESC) AS n FROM met) WHERE n = 1 GROUP BY 1""", T, M)
def _h8(s, d):
    pairs = D.symbol_map(s).select("exchange", F.col("canonical").alias("symbol"))
    return H.market_status(_metrics(s, d), pairs, [21_600], 7200).select("symbol", r("median_price"), "configured_venues", "ready_venues")


@query("h9_eligibility", "SELECT timestamp_ms, exchange, symbol, readiness_reason = 'ready' AND data_age_seconds BETWEEN 0 AND 3600 AS alert_eligible, CASE WHEN readiness_reason = 'ready' AND NOT data_age_seconds BETWEEN 0 AND 3600 THEN 'stale_data' ELSE readiness_reason END AS readiness_reason FROM met", T, M)
def _h9(s, d):
    return H.eligibility(_metrics(s, d), 3600).select("timestamp_ms", "exchange", "symbol", "alert_eligible", "readiness_reason")


@query("h10_overall_readiness", "SELECT array_to_string(list(reason ORDER BY p), ',') AS reasons, false AS ready FROM (SELECT 'feed ' || exchange AS reason, min(timestamp_ms) AS p FROM h2 WHERE bad GROUP BY 1)", T, _HH)
def _h10(s, d):
    bad = _health_history(s, d).where("not healthy").select(F.col("timestamp_ms").alias("position"), F.concat(F.lit("feed "), "exchange").alias("reason"))
    return H.overall_readiness(bad).select(F.array_join("reasons", ",").alias("reasons"), "ready")


@query("h11_public_readiness", "SELECT bool_and(NOT bad AND age BETWEEN 0 AND 60) AS ready FROM h2", T, _HH)
def _h11(s, d):
    f = _health_history(s, d).select(F.col("healthy").alias("connected"), F.lit(True).alias("subscription_acknowledged"), F.col("age_seconds").alias("message_age_seconds"), F.lit(True).alias("ready"))
    return H.public_readiness(f, 60)


# ---- G: evidence gate

V = D.EVIDENCE_SQL


@query("g3_dedup_samples", "SELECT DISTINCT t AS timestamp_ms FROM evd", V)
def _g3(s, d):
    return G.dedup_samples(D.evidence(s, d))[0].select("timestamp_ms")


@query("g4_coverage", "SELECT count(*) AS samples, round((max(t) - min(t)) / 1000.0, 3) AS duration_seconds, round(least(1, count(*) / greatest(1, floor((max(t) - min(t)) / 1000.0 / 600) + 1)), 6) AS coverage FROM evd", V)
def _g4(s, d):
    return G.coverage(D.evidence(s, d), 600).select("samples", r("duration_seconds", 3), r("coverage"))


@query("g5_failure_counts", """SELECT i AS instance, CAST(sum(n) AS BIGINT) AS failures, max(n) AS longest_run FROM (SELECT i, run, count(*) FILTER (bad) AS n FROM (SELECT *, sum(st) OVER (PARTITION BY i ORDER BY t, k) AS run FROM
 (SELECT *, CASE WHEN bad AND NOT coalesce(lag(bad) OVER (PARTITION BY i ORDER BY t, k), false) THEN 1 ELSE 0 END AS st FROM (SELECT unnest(['primary', 'shadow']) AS i, k, t, k % 7 = 0 AS bad FROM evd))) GROUP BY 1, 2) GROUP BY 1""", V)
def _g5(s, d):
    return G.failure_counts(G.parsed(D.evidence(s, d)))


@query("g6_monitor_gaps", "SELECT count(*) FILTER (step >= 900) AS gaps, coalesce(max(step) FILTER (step >= 900), 0) AS largest_gap_seconds FROM (SELECT (t - lag(t) OVER (ORDER BY t)) / 1000.0 AS step FROM evd)", V)
def _g6(s, d):
    return G.monitor_gaps(G.parsed(D.evidence(s, d)), 600)


@query("g8_container_restarts", "SELECT count(*) AS restarts FROM (SELECT k // 300 AS c, lag(k // 300) OVER (ORDER BY t, k) AS p FROM evd) WHERE c <> p", V)
def _g8(s, d):
    return G.container_restarts(G.parsed(D.evidence(s, d)))


@query("g7_runtime_restarts")
def _g7(s, d):
    return G.runtime_restarts(G.parsed(D.evidence(s, d)))


@query("g1_flatten_status", "SELECT t AS timestamp_ms, i AS instance, true AS feed_healthy, k % 2 > 0 AS symbol_healthy FROM (SELECT k, t, unnest(['primary', 'shadow']) AS i FROM evd)", V)
def _g1(s, d):
    return G.flatten_status(G.parsed(D.evidence(s, d)), 30, 30).select("timestamp_ms", "instance", "feed_healthy", "symbol_healthy")


@query("g2_g9_instance_evidence_errors")
def _g9(s, d):
    return G.instance_evidence_errors(G.parsed(D.evidence(s, d, dealt=True)))


@query("g10_container_evidence_errors", "SELECT t AS timestamp_ms, CASE WHEN k % 50 = 0 THEN 1 ELSE 0 END AS n FROM evd", V)
def _g10(s, d):
    return G.container_evidence_errors(G.parsed(D.evidence(s, d))).select("timestamp_ms", F.size("errors").alias("n"))


_MARKETS = """mk AS (SELECT i, k % 7 <> 0 AS ok, CASE WHEN k % 8 = 0 THEN 'low' WHEN k % 8 = 4 THEN 'half' WHEN k % 16 = 1 THEN 'back' WHEN k % 16 = 3 THEN 'gone' ELSE 'ready' END AS m
  FROM (SELECT k, unnest(['primary', 'shadow']) AS i FROM evd)),
st AS (SELECT i || CASE m WHEN 'gone' THEN ':unknown:missing' WHEN 'half' THEN ':BTC:1/2' WHEN 'low' THEN ':BTC:0/1' ELSE ':BTC:1/1' END AS pair,
  CASE WHEN m = 'ready' THEN 'ready' WHEN m = 'half' AND ok THEN 'quiet' ELSE 'unready' END AS s, CASE m WHEN 'half' THEN 0.5 WHEN 'ready' THEN 1.0 WHEN 'back' THEN 1.0 ELSE 0.0 END AS ratio FROM mk)"""


@query("g11_g12_detector_readiness", """SELECT count(*) FILTER (s = 'unready') AS unready_samples, count(*) FILTER (s = 'quiet') AS quiet_samples, CAST(min(ratio) AS DOUBLE) AS min_ready_ratio,
  (SELECT coalesce(string_agg(pair, ',' ORDER BY pair), '') FROM (SELECT DISTINCT pair FROM st WHERE s = 'unready')) AS unready_pairs,
  (SELECT coalesce(string_agg(pair, ',' ORDER BY pair), '') FROM (SELECT DISTINCT pair FROM st WHERE s = 'quiet')) AS quiet_pairs FROM st""", V, _MARKETS)
def _g12(s, d):
    got = G.detector_readiness(G.parsed(D.evidence(s, d)))
    return got.withColumns({f"{n}_pairs": F.array_join(f"{n}_pairs", ",") for n in ("unready", "quiet")})


@query("g13_max_rollups", "SELECT CAST(max(k % 3) AS DOUBLE) AS max_feed_drops, 1.0 AS max_feed_age FROM evd", V)
def _g13(s, d):
    return G.max_rollups(G.parsed(D.evidence(s, d))).select("max_feed_drops", "max_feed_age")


@query("g14_gate")
def _g14(s, d):
    return G.gate(G.summarize(D.evidence(s, d, dealt=True)))
