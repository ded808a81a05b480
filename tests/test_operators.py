"""Example tests: shapes and values from the fixtures, rebuilt as small tables."""

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tapewatch import schemas
from tapewatch.functions import series
from tapewatch.functions.stats import MAD_SCALE, with_robust_zscore
from tapewatch.operators import alerts as A
from tapewatch.operators import continuity as C
from tapewatch.operators import events as E
from tapewatch.operators import evidence as G
from tapewatch.operators import health as H
from tapewatch.operators import normalize as N
from tapewatch.operators import rules as R
from tapewatch.operators import tables as P
from tapewatch.operators import windows as W
from tapewatch.params import Channel, Gate, Grid, Rules, Threshold, WindowRule
from tapewatch.sources.frames import read_evidence

NOW = 1_800_000_000_000


def trades(spark, rows):
    """(exchange, ts, price, qty, side, id) in arrival order."""
    full = [(x, "BTC", t, float(p), float(q), s, i, t, t / 1000, 0, k) for k, (x, t, p, q, s, i) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.TRADE)


def frames(spark, *objects):
    return spark.createDataFrame([(json.dumps(o), NOW, 1.0, 0, k) for k, o in enumerate(objects)], schemas.FRAME)


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame([(x, "BTCUSDT", "BTC") for x in ("binance", "bybit")] + [("okx", "BTC-SWAP", "BTC")], "exchange string, venue_symbol string, canonical string")


def test_frames(spark, symbols):
    t = {"e": "aggTrade", "E": NOW, "s": "BTCUSDT", "a": 7, "p": "100000.0", "q": "0.20", "T": NOW - 5, "m": True}
    got = N.normalize_agg_trades(frames(spark, {"stream": "x", "data": t}, t, {**t, "m": "true"}, {**t, "s": "NONE"}, {**t, "e": "other"}), symbols).collect()
    assert [(r.symbol, r.taker_side, r.price * r.quantity, r.event_id, r.timestamp_ms) for r in got] == [("BTC", "sell", 20_000.0, "binance:trade:BTC:7", NOW - 5)] * 2
    o = {"s": "BTCUSDT", "S": "SELL", "p": "99", "ap": "100", "q": "5", "l": "2", "z": "4", "T": NOW}
    got = N.normalize_force_orders(frames(spark, {"data": {"e": "forceOrder", "E": NOW, "o": o}}, {"e": "forceOrder", "E": NOW, "o": {**o, "ap": "0", "l": "0", "S": "BUY"}}, {"e": "forceOrder", "o": {**o, "ap": "0", "p": "0"}}), symbols).collect()
    assert [(r.price, r.quantity, r.liquidated_side) for r in got] == [(100.0, 2.0, "long"), (99.0, 4.0, "short")]
    d = {"T": NOW, "s": "BTCUSDT", "S": "Buy", "v": "2", "p": "10", "i": "x"}
    got = N.normalize_public_trades(frames(spark, {"topic": "publicTrade.BTCUSDT", "data": [d, {**d, "S": "none"}]}, {"topic": "other", "data": [d]}), symbols).collect()
    assert [(r.taker_side, r.event_id) for r in got] == [("buy", "bybit:trade:BTC:x")]
    got = N.normalize_liquidations(frames(spark, {"topic": "allLiquidation.BTCUSDT", "data": [d, d]}), symbols).collect()
    assert {r.liquidated_side for r in got} == {"long"} and len({r.event_id for r in got}) == 2
    values = N.contract_values(spark.createDataFrame([("BTC-SWAP", "0.01", None), ("B", "-1", "2")], "instId string, ctVal string, ctMult string"))
    s = {"arg": {"channel": "trades", "instId": "BTC-SWAP"}, "data": [{"ts": str(NOW), "px": "50", "sz": "300", "side": "sell", "tradeId": "9"}]}
    got = N.normalize_swap_trades(frames(spark, s), symbols, values).collect()
    assert [(r.quantity, r.taker_side) for r in got] == [(3.0, "sell")] and {r.contract_value for r in values.collect()} == {0.01, 1.0}


def test_validity_and_quarantine(spark):
    rows = [("binance", NOW, 1, 1, "buy", "a"), ("binance", NOW, float("nan"), 1, "buy", "b"), ("binance", NOW, 1, 0, "buy", "c"), ("binance", NOW, 1, 1, "x", "d"), ("okx", NOW, 1, 1, "buy", "e"), ("binance", 0, 1, 1, "buy", "f")]
    good, bad = N.valid_events(trades(spark, rows), symbols=["BTC"], exchange="binance")
    assert [r.event_id for r in good.collect()] == ["a"] and bad.count() == 5
    t = trades(spark, [("x", NOW + d, 1, 1, "buy", str(d)) for d in (-1, 0, 2000, 9000)]).withColumn("received_wall_ms", F.lit(NOW))
    kept, out = N.quarantine_future(t, 5)
    assert {r.event_id: (r.timestamp_ms, r.clock_normalized) for r in kept.collect()} == {"-1": (NOW - 1, False), "0": (NOW, False), "2000": (NOW, True)}
    c = N.clock_counters(kept, out).first()
    assert (c.quarantined_total, c.normalized_total, c.by_feed) == (1, 1, {"x:BTC:trade": 1})


def test_buckets_out_of_order_and_ties(spark):
    b = E.bucketize(trades(spark, [("x", 12_000, 103, 1, "buy", None), ("x", 2_000, 100, 1, "buy", None), ("x", 10_500, 101, 1, "sell", None), ("x", 12_000, 104, 1, "buy", None)]), 5).orderBy("start_ms").collect()
    assert [(r.start_ms, r.open, r.close, r.trades) for r in b] == [(0, 100, 100, 1), (10_000, 101, 104, 3)]
    assert b[1].buy_quote_volume == 207 and b[1].sell_quote_volume == 101


def test_dedup_and_lateness(spark):
    t = trades(spark, [("x", 0, 1, 1, "buy", "a"), ("x", 1, 1, 1, "buy", "a"), ("x", 2, 1, 1, "buy", None), ("x", 3, 1, 1, "buy", None), ("x", 200_000, 1, 1, "buy", "z"), ("x", 5, 1, 1, "buy", "a"), ("y", 1, 1, 1, "buy", "a")])
    assert [r.arrival_seq for r in E.dedup_trades(t, 120).orderBy("arrival_seq").collect()] == [0, 2, 3, 4, 5, 6]
    assert E.drop_late(t, 100, 5).count() == 6
    liq = t.withColumnRenamed("taker_side", "liquidated_side")
    assert [r.arrival_seq for r in E.dedup_liquidations(liq, 4500).orderBy("arrival_seq").collect()] == [0, 2, 3, 4]


def breaks(spark, *rows):
    return spark.createDataFrame([("x", "BTC", *r) for r in rows], schemas.BREAK)


def test_pairing_and_merging(spark):
    log = spark.createDataFrame([("x", p, t, r, "BTC") for p, t, r in [("end", 5, ""), ("start", 10, "b"), ("start", 12, "a"), ("end", 20, ""), ("end", 30, ""), ("start", 40, "c")]], schemas.CONTINUITY_EVENT)
    got = sorted((r.start_ms, r.end_ms, r.reason) for r in C.pair_breaks(log).collect())
    assert got == [(10, 20, "a,b"), (40, None, "c")]
    m = C.merge_breaks(breaks(spark, (0, 10, "a"), (10, 15, "b,a"), (20, None, "c"), (30, 40, "d"))).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.reason) for r in m] == [(0, 15, "a,b"), (20, None, "c,d")]
    seg = spark.createDataFrame([("x", "BTC", 15, 17), ("x", "BTC", 16, 19)], "exchange string, symbol string, start_ms long, end_ms long")
    assert C.overlaps_break(seg, C.merge_breaks(breaks(spark, (0, 15, "a")))).count() == 1


@pytest.mark.parametrize(
    ("gaps", "max_gap", "least", "want"),
    [
        ([(-40, -30)], 15, 0.8, (5 / 6, 10.0, True)), ([(0, None)], 15, 0.8, (1.0, 0.0, False)), ([(-50, -34)], 15, 0.5, (1 - 16 / 60, 16.0, False)),
        ([(-55, -45), (-35, -25)], 15, 0.8, (2 / 3, 10.0, False)), ([(-50, -30), (-40, -20)], 40, 0.5, (0.5, 30.0, True)), ([(-64, -61)], 2, 0.8, (1.0, 3.0, False)),
    ],
)
def test_segment_continuity(spark, gaps, max_gap, least, want):
    b = C.merge_breaks(breaks(spark, *((NOW + s * 1000, NOW + e * 1000 if e is not None else None, "r") for s, e in gaps)))
    seg = spark.createDataFrame([("x", "BTC", "1", NOW, 60_000, NOW - 65_000)], "exchange string, symbol string, seg_id string, t_ms long, w_ms long, price_start_ms long")
    r = C.segment_continuity(seg, b, max_gap, least).first()
    assert (r.coverage_ratio, r.largest_gap_seconds, r.continuous) == (pytest.approx(want[0]), want[1], want[2])


def test_break_closes_on_first_trade_of_its_generation(spark):
    fb = spark.createDataFrame([("x", "BTC", 100, 2, "r"), ("x", "ETH", 100, 2, "r")], "exchange string, symbol string, start_ms long, generation long, reason string")
    t = trades(spark, [("x", 90, 1, 1, "buy", "a"), ("x", 150, 1, 1, "buy", "b"), ("x", 160, 1, 1, "buy", "c")]).withColumn("continuity_generation", F.when(F.col("event_id") == "b", 1).otherwise(2).cast("long"))
    closed = C.close_on_first_trade(fb, t)
    assert {r.symbol: r.end_ms for r in closed.collect()} == {"BTC": 160, "ETH": None}
    assert C.feed_break_ends(closed).first().end_ms is None


def test_clock_and_pauses(spark):
    rows = [("p", 0, 0.0), ("p", 5000, 5.0), ("p", 40_000, 10.0), ("p", 45_000, 15.0), ("p", 30_000, 20.0), ("p", 35_000, 25.0)]
    df = spark.createDataFrame(rows, "source string, wall_ms long, monotonic_s double")
    assert [(r.kind, r.start_ms, r.end_ms) for r in C.clock_jumps(df, 5).collect()] == [("forward", 10_000, 40_000), ("backward", 30_000, 50_000)]
    assert [(r.start_ms, r.end_ms) for r in C.runtime_pauses(df, 5, 15).collect()] == [(10_000, 40_000)]


def test_robust_zscore(spark):
    rows = [(0, 10.0, [1.0, 2.0, 3.0, 4.0, 100.0]), (1, 1.0, [1.0] * 4), (2, 5.0, [5.0] * 6), (3, 6.0, [5.0] * 6), (4, 7.0, [1.0, 1.0, 1.0, 1.0, 9.0]), (5, float("nan"), [1.0, 2.0, 3.0, 4.0, 5.0]), (6, 1.0, [float("inf"), 1.0, 2.0, 3.0, 4.0])]
    got = {r.k: r.z for r in with_robust_zscore(spark.createDataFrame(rows, "k int, v double, s array<double>"), "v", F.col("s"), "z").collect()}
    sd = statistics.stdev(rows[4][2])
    assert got[0] == pytest.approx(MAD_SCALE * 7) and got[1] is None and got[2] == 0.0 and got[3] is None
    assert got[4] == pytest.approx((7 - statistics.mean(rows[4][2])) / sd) and got[5] is None and got[6] is None


def test_metrics_match_plain_loop(spark):
    g = Grid(5, 60, 300, 5, 240, 15, 0.8)
    rows = [("x", NOW - 400_000 + k * 5000, 100 + 0.2 * math.sin(k / 3) + 0.002 * k, 10 + k % 5, "buy" if k % 2 else "sell", None) for k in range(80) if k % 11]
    b = E.bucketize(trades(spark, rows), 5)
    got = {r.timestamp_ms: r for r in W.metric_snapshots(b, None, g).collect()}
    cells = {r.start_ms: r for r in b.collect()}

    def at(t):
        past = [c for c in cells.values() if c.last_trade_ms <= t]
        return max(past, key=lambda c: c.start_ms).close if past else None

    def window(t):
        own = [c for s, c in cells.items() if t - 60_000 < s <= t]
        p = at(t - 60_000)
        return (at(t) / p - 1 if own and p else None), sum(c.quote_volume for c in own)

    for t, r in got.items():
        ret, vol = window(t)
        assert (r.return_bps is None) == (ret is None) and r.quote_volume == pytest.approx(vol)
        if ret is not None:
            assert r.return_bps == pytest.approx(ret * 1e4)
            past = [window(u)[0] for u in range(t - 60_000, t - 300_001, -30_000)]
            past = [x for x in past if x is not None]
            assert r.baseline_points == len(past)
            if len(past) >= 5:
                m = statistics.median(past)
                assert r.return_z == pytest.approx(MAD_SCALE * (ret - m) / statistics.median(abs(x - m) for x in past))
                assert r.readiness_reason == "ready"
    absent = spark.createDataFrame([("x", "BTC"), ("y", "BTC")], "exchange string, symbol string")
    assert [r.readiness_reason for r in W.metric_snapshots(b, None, g, pairs=absent).where("exchange = 'y'").collect()] == ["no_data"]


def metric(x, ret, z=5.0, vz=3.0, imb=0.5, ready=True, age=1.0, w=60, price=100.0, reason=None):
    return (NOW, x, "BTC", w, ready, float(price), float(ret), z, 1e6, vz, imb, 10, 50, age, reason or ("ready" if ready else "baseline_warmup"), 1.0, 0.0, 0.0)


RULES = Rules((WindowRule(60, Threshold(20, 2, 2, 0.3, 2), Threshold(50, 4, 3, 0.3, 2)), WindowRule(300, Threshold(40, 2, 2, 0.3, 2), Threshold(80, 4, 3, 0.3, 2))), 0, 30, 1.75, 1e6, 5e6, 2, 20, 50, 2, 3)


def test_rules(spark):
    m = spark.createDataFrame([metric("a", -60), metric("b", -55), metric("c", 70), metric("a", 0, w=300), metric("b", -90, w=300, age=99.0)], schemas.METRIC)
    c = R.confirm(R.candidates(m, RULES), RULES).collect()
    assert [(r.direction, r.confirmations, r.severity, r.window_seconds) for r in c] == [("down", 2, "critical", 60)]
    tie = spark.createDataFrame([metric("a", -60), metric("b", 60)], schemas.METRIC)
    one = Rules((WindowRule(60, Threshold(20, 2, 2, 0.3, 1), Threshold(50, 4, 3, 0.3, 2)),))
    assert [(r.direction, r.severity) for r in R.confirm(R.candidates(tie, one), one).collect()] == [("up", "warning")]
    sudden = spark.createDataFrame([metric("a", -90, None, None, None, False), metric("b", -95, None, None, None, False)], schemas.METRIC)
    assert [r.severity for r in R.confirm(R.candidates(sudden, RULES), RULES).collect()] == ["critical"]


def test_shock_consumes_liquidation(spark):
    m = spark.createDataFrame([metric("a", -60, price=100), metric("b", -55, price=100.5), metric("c", -52, price=100.1, ready=False)], schemas.METRIC)
    liq = spark.createDataFrame([("a", "BTC", NOW - 1000, 100.0, 14_500.0, "long", 1), ("b", "BTC", NOW - 900, 100.0, 12_500.0, "long", 2)], "exchange string, symbol string, timestamp_ms long, price double, quantity double, liquidated_side string, arrival_seq long")
    t = (NOW // 5000) * 5000 + 4999
    windows = W.liquidation_window(liq, 60, 5).where(F.col("t_ms") == t).withColumn("t_ms", F.lit(NOW).cast("long"))
    got = {r.category: r for r in R.evaluate(m, windows, RULES).collect()}
    assert set(got) == {"market_shock", "spread"} and got["market_shock"].severity == "critical" and got["market_shock"].exchanges == ["a", "b"]
    assert json.loads(got["market_shock"].metrics_json)["liquidation"]["total_usd"] == 2_700_000


def alerts(spark, *rows):
    return spark.createDataFrame([(str(k), t * 1000, s, key, k) for k, (t, s, key) in enumerate(rows)], "id string, timestamp_ms long, severity string, dedup_key string, sequence long")


def test_cooldown(spark):
    a = alerts(spark, (0, "warning", "k"), (10, "warning", "k"), (20, "critical", "k"), (30, "warning", "k"), (119, "critical", "k"), (120, "critical", "k"), (1, "info", ""), (2, "info", ""), (5, "warning", "m"))
    assert sorted(r.sequence for r in A.apply_cooldown(a, 100).collect()) == [0, 2, 5, 6, 7, 8]
    seeds = spark.createDataFrame([("m", 4000, "critical")], "dedup_key string, timestamp_ms long, severity string")
    assert 8 not in {r.sequence for r in A.apply_cooldown(a, 100, seeds).collect()}
    bypass = a.withColumn("bypass", F.col("sequence") == 1)
    assert sorted(r.sequence for r in A.apply_cooldown(bypass.where("dedup_key = 'k'"), 100).collect()) == [0, 1, 2, 5]


def test_routing_jobs_and_feed(spark):
    a = alerts(spark, (0, "warning", "k"), (1, "critical", "k"), (2, "info", "k"))
    assert sorted((r.id, r.channel) for r in A.route(a, [Channel("x"), Channel("y", "critical"), Channel("z", enabled=False)]).collect()) == [("0", "x"), ("1", "x"), ("1", "y")]
    assert [r.id for r in A.pending_order(a, 2).orderBy("position").collect()] == ["1", "0"]
    rows, state = P.change_feed(a, "e:0", "e", 1)
    assert [r.sequence for r in rows.collect()] == [1] and tuple(state.first()) == ("e:1", True, None)
    assert P.change_feed(a, "old:2", "e")[1].first().reset_reason == "source_restarted"
    assert P.change_feed(a, "e:99", "e")[1].first().reset_reason == "source_history_reset"
    assert P.change_feed(a.where("sequence > 1"), "e:0", "e")[1].first().reset_reason == "source_history_gap"
    j = spark.createDataFrame([("0", 500, "k", "queued", 0, 1), ("0", 0, "k", "success", 1, 2), ("1", 0, "k", "bad", 0, 3)], schemas.JOB)
    assert [(r.status, r.dedup_key, r.priority) for r in A.job_state(j).collect()] == [("success", "k", 0)]
    assert A.sample_metrics(spark.createDataFrame([(t * 1000,) for t in (0, 5, 29, 30, 59, 61)], "timestamp_ms long"), 30).count() == 3


def test_upsert_sink(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    path = str(tmp_path / "alerts")
    A.sink(spark, alerts(spark, (0, "warning", "k"), (1, "info", "m")), path, ["id"], "sequence")
    A.sink(spark, alerts(spark, (0, "critical", "k")).withColumn("sequence", F.lit(9).cast("long")), path, ["id"], "sequence")
    assert {r.id: r.severity for r in spark.read.parquet(path).collect()} == {"0": "critical", "1": "info"}


def test_health(spark):
    h = spark.createDataFrame([("x", t, ok, 5.0 * t) for t, ok in enumerate([True, False, False, True, True, False])], "exchange string, timestamp_ms long, healthy boolean, age_seconds double")
    got = H.feed_health_alerts(h, 4).orderBy("timestamp_ms").collect()
    assert [(r.timestamp_ms, r.severity, r.bypass) for r in got] == [(1, "warning", True), (2, "warning", False), (3, "info", True), (5, "critical", True)]
    m = spark.createDataFrame([(NOW + t, "a", "BTC", 60, ok, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1, 9, 1.0, "ready" if ok else "recovering_after_gap", 0.9, 3.0, 2.0) for t, ok in ((0, True), (1, False), (2, False), (3, True), (4, True))], schemas.METRIC)
    e = H.continuity_episodes(m, 30)
    assert [(r.opened_ms - NOW, r.closed_ms - NOW, r.pairs) for r in e.collect()] == [(1, 3, ["a:BTC"])] and H.episode_alerts(e).count() == 2
    pairs = spark.createDataFrame([("a", "BTC"), ("b", "BTC")], "exchange string, symbol string")
    s = H.market_status(m, pairs, [60], 30).first()
    assert (s.configured_venues, s.ready_venues, s.priced_venues, s.readiness_reasons) == (2, 1, ["a"], ["missing_window_metric", "ready"])
    f = spark.createDataFrame([(True, True, 1.0, True)], "connected boolean, subscription_acknowledged boolean, message_age_seconds double, ready boolean")
    assert H.public_readiness(f, 5).first().ready and not H.public_readiness(f, 5, False).first().ready and not H.public_readiness(f.where("false"), 5).first().ready


TASKS = ("event-consumer", "detector", "health-monitor", "maintenance", "alert-workers")


def sample(k, **change):
    venue = {"ready": True, "base_ready": True, "alert_eligible": True, "reason": "ready", "data_age_seconds": 1.0}
    inst = {
        "ok": True, "evidence_complete": True, "evidence_errors": [], "runtime_started_ms": 1000, "uptime_seconds": 100.0 + 60 * k, "readiness": {"ready": True, "state": "ready", "reasons": []}, "queue_size": 1, "queue_capacity": 100,
        "feeds": {"okx": {"healthy": True, "connected": True, "subscription_acknowledged": True, "message_age_seconds": 1.0, "dropped_events": 0, "reconnects": 0, "trades": 5, "liquidations": 0, "symbols": {"BTC": {"healthy": True, "message_age_seconds": 1.0, "messages": 5, "trades": 5, "liquidations": 0}}}},
        "expected_tasks": [*TASKS, "feed-okx"], "tasks": {t: {"state": "running", "ready": True, "heartbeat_age_seconds": 1.0, "heartbeat_stale": False, "last_error": ""} for t in (*TASKS, "feed-okx")},
        "queue_health": {"high_water": 3, "drops_total": 0, "drops_since_last_health_check": 0, "consumer_lag_seconds": 0.1, "utilization": 0.01}, "clock_health": {"future_events_quarantined": 0, "clock_adjustments": 0, "last_quarantine_ms": None},
        "alarm_delivery": {"enabled": True, "local_queue_depth": 0, "counts": {"queued": 0, "attempt": 0, "success": 1, "failure": 0}}, "checkpoint_health": {"enabled": False, "healthy": True, "reason": "disabled", "last_failure_ms": None},
        "markets": [{"symbol": "BTC", "ready_venues": 1, "configured_venues": 1, "readiness_reasons": ["ready"], "readiness_reason": "ready", "max_recovery_seconds_remaining": 0.0, "min_window_coverage_ratio": 1.0, "max_largest_gap_seconds": 0.0, "venue_readiness": {"okx": venue}}],
    }
    box = {"observed": True, "present": True, "running": True, "status": "running", "health": "healthy", "restart_count": 0, "container_id": "c", "started_at": "s"}
    return json.dumps({"timestamp": f"2024-01-01T{k // 60:02d}:{k % 60:02d}:00Z", "monitor_gap_seconds": 0, "primary": {**inst, **change}, "shadow": inst, "docker": box})


def verdict(spark, lines, **gate):
    rows, counts = read_evidence(spark.createDataFrame([(x,) for x in lines], "line string"))
    return G.gate(G.summarize(rows, Gate(**gate), counts), Gate(**gate)).first(), counts.first()


def test_gate(spark):
    lines = [sample(k) for k in range(61)]
    v, c = verdict(spark, lines)
    assert v.passed and v.reasons == [] and v.coverage == 1.0 and (c.valid, c.invalid) == (61, 0)
    v, c = verdict(spark, [*lines, "", "no json", '{"timestamp": "x"}'])
    assert not v.passed and v.reasons == ["2 invalid JSONL row(s)"] and (c.valid, c.invalid) == (61, 2)
    counters = {"queue_health": {"high_water": 3, "drops_total": 4, "drops_since_last_health_check": 0, "consumer_lag_seconds": 0.1, "utilization": 0.01}, "clock_health": {"future_events_quarantined": 2, "clock_adjustments": 1, "last_quarantine_ms": None}}
    bad = [*lines[:20], sample(20, ok=False), sample(21, uptime_seconds=1.0), sample(22, expected_tasks=["event-consumer"]), sample(23, **counters), *lines[27:], lines[40]]
    v, _ = verdict(spark, bad)
    assert v.reasons == [
        "sample coverage 95.1% is below 98.0%", "1 duplicate timestamp sample(s)", "1 primary failure sample(s)", "2 incomplete primary evidence sample(s)", "1 monitoring gap(s)", "drop counter reached 0 feed / 4 market queue",
        "future-event quarantine counter reached 2", "clock adjustment counter reached 1", "runtime restarts observed: primary 1, shadow 0, container counter 0, container identity 0",
    ]
    assert verdict(spark, ["{}"])[0].reasons == ["no valid soak samples"]
    assert verdict(spark, lines[:31], min_coverage=0.5)[0].reasons == ["duration 0.50h is below 1.00h"]


def test_liquidation_ids_against_a_fold(spark):
    import random

    rng = random.Random(4)
    rows = [("x", 1_000_000 + k * 300 + rng.choice([0, 0, -900, 4000]), f"i{rng.randrange(40)}" if k % 5 else None, k) for k in range(600)]
    df = spark.createDataFrame(rows, "exchange string, timestamp_ms long, event_id string, arrival_seq long")
    top, kept, want = 0, {}, []
    for _, ts, name, seq in rows:
        if name is None:
            want.append(seq)
            continue
        top = max(top, ts)
        if name in kept and kept[name] >= top - 5000:
            continue
        want.append(seq)
        if ts >= top - 5000:
            kept[name] = top
    for chunk in (1 << 20, 17):
        got = sorted(r.arrival_seq for r in E.dedup_liquidations(df, 5, chunk).collect())
        assert got == want and len(want) < 560


def test_running_max_by_chunks(spark):
    rows = [(f"s{k % 2}", k, (k * 37) % 101 if k % 7 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "symbol string, arrival_seq long, v long").repartition(5)
    top, want = {}, {}
    for s, k, v in rows:
        top[s] = max(x for x in (top.get(s), v) if x is not None) if (s in top or v is not None) else None
        if top[s] is None:
            del top[s]
        want[k] = top.get(s)
    found = E.running_max(df, ["symbol"], F.col("v"), "m", chunk=4)
    assert {r.arrival_seq: r.m for r in found.collect()} == want


def test_windows_by_chunks(spark):
    g = Grid(5, 60, 300, 5, 240, 15, 0.8)
    rows = [("x", NOW - 2_000_000 + k * 5000, 100 + 0.3 * math.sin(k / 3), 10 + k % 5, "buy" if k % 2 else "sell", None) for k in range(400) if k % 11 and not 100 < k < 180]
    rows += [("y", NOW - 2_000_000 + k * 5000, 100.0 + k, 1, "buy", None) for k in range(20)]
    dense = W.grid(E.bucketize(trades(spark, rows), 5), 5)
    assert dense.groupBy("exchange").agg(F.max("idx").alias("hi")).select("hi").distinct().count() == 1
    whole, cut = W.window_columns(dense, g, 10_000), W.window_columns(dense, g, 4)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, cut.collect()), key=str)
    points = whole.withColumn("hist", F.pmod("idx", F.lit(7)) > 0)
    by_id = lambda df: {(r.exchange, r.idx): [tuple(x) for x in r.sample] for r in df.collect()}
    want = by_id(W.baseline_samples(points, g, 10_000))
    assert by_id(W.baseline_samples(points, g, 3)) == want and max(map(len, want.values())) > 5
    last = W.metric_snapshots(E.bucketize(trades(spark, rows), 5), None, g).where("exchange = 'y'").orderBy(F.desc("timestamp_ms")).first()
    assert last.readiness_reason == "insufficient_window" and last.data_age_seconds > 1800 and last.price == 119.0


def test_breaks_in_bins_equal_plain_joins(spark):
    rng = random.Random(9)
    spans = [(lo, None if k % 40 == 39 else lo + rng.randrange(1, 900)) for k in range(80) for lo in [rng.randrange(20_000)]]
    rows = [(k, "x", "BTC", a, a + rng.choice([0, 5, 99, 2500])) for k in range(300) for a in [rng.randrange(22_000)]] + [(900, "x", "BTC", None, 5), (901, "z", "BTC", 1, 5)]
    br = spark.createDataFrame([("x", "BTC", a, b, "r") for a, b in spans], "exchange string, symbol string, start_ms long, end_ms long, reason string")
    df = spark.createDataFrame(rows, "k int, exchange string, symbol string, start_ms long, end_ms long")
    hit = {k for k, x, _, a, b in rows if x == "x" and a is not None and any(s <= b and (e is None or e >= a) for s, e in spans)}
    assert {r.k for r in C.overlaps_break(df, br, width_ms=100).collect()} == hit
    assert {r.k for r in C.overlaps_break(df, br, keep=False, width_ms=100).collect()} == {r[0] for r in rows} - hit
    merged = C.merge_breaks(br.where("start_ms < 15000 and end_ms is not null"))
    seg = df.where("exchange = 'x' and start_ms is not null").selectExpr("exchange", "symbol", "cast(k as string) seg_id", "end_ms t_ms", "cast(700 as long) w_ms", "end_ms - 900 price_start_ms")
    for now in (True, False):
        one, many = (sorted(map(str, C.segment_continuity(seg, merged, 0.5, 0.5, now, width_ms=w).collect())) for w in (10_000_000, 50))
        assert one == many


def test_previous_and_carried_by_chunks(spark):
    rng = random.Random(4)
    rows = [(k % 2, k, rng.choice([None, k])) for k in range(200) if not 40 < k < 90]
    df = spark.createDataFrame(rows, "s int, k long, v long")
    chunk = F.floor(F.col("k") / 7)
    lag = {r.k: r.was for r in series.previous(df, ["s"], ["k"], chunk, F.col("v"), "was").collect()}
    last = {r.k: r.so_far for r in series.carried(df, ["s"], ["k"], chunk, F.col("v"), "so_far").collect()}
    was, so_far = {}, {}
    for s, k, v in rows:
        assert lag[k] == was.get(s)
        was[s] = v
        so_far[s] = so_far.get(s) if v is None else v
        assert last[k] == so_far.get(s)


def test_one_clock_over_days(spark):
    day, step = 86_400_000, 21_600_000
    ticks = [k * step for k in range(40) if k not in (5, 6, 7)] + [9 * step + 7]
    want, last = [], None
    for t in sorted(ticks):
        if last is None or t - last >= 64_800_000:
            want.append(t)
            last = t
    got = A.sample_metrics(spark.createDataFrame([(t,) for t in ticks], "timestamp_ms long"), 64_800)
    assert sorted(r.timestamp_ms for r in got.collect()) == want and len({t // day for t in want}) > 4


def test_external_alerts_and_kinds(spark):
    now = 1_000_000_000
    rows = [('{"source": "bot", "symbol": "btc", "metrics": {"a": 1}, "timestamp_ms": 5}', now), ("{}", now), ('{"dedup_key": "external:k", "severity": "CRITICAL", "timestamp_ms": "x", "category": "Odd"}', now)]
    a, b, c = N.normalize_external_alerts(spark.createDataFrame(rows, "payload string, now_ms long")).collect()
    assert (a.exchanges, a.dedup_key, a.timestamp_ms, a.metrics) == (["bot"], "external:bot:BTC:external:mixed", now - 300_000, {"a": "1", "_timestamp_normalized": "true"})
    assert (b.title, b.message, b.dedup_key, b.metrics) == ("External alert: MARKET", "External alert received.", "external:external:MARKET:external:mixed", {})
    assert (c.dedup_key, c.severity, c.category, c.timestamp_ms) == ("external:external:k", "critical", "Odd", now)
    kinds = spark.createDataFrame([("system_test", "SYSTEM", "x"), ("feed_recovery", "SYSTEM", "detector"), ("runtime_health", "A", "x"), ("test", "A", "bot"), ("monitoring_x", "A", "detector")], "category string, symbol string, source string")
    assert [r.k for r in kinds.select(P.alert_kind().alias("k")).collect()] == ["test", "monitoring", "monitoring", "external", "market"]


def test_streaming_buckets_equal_batch(spark, tmp_path):
    from tapewatch.streaming import jobs

    rows = [("x", 1_000_000 + k * 700, 100 + k % 7, 1, "buy" if k % 3 else "sell", str(k // 2)) for k in range(60)] + [("x", 9_000_000, 1, 1, "buy", "end")]
    t = trades(spark, rows)
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schemas.TRADE).parquet(str(tmp_path / "in"))
    for name, df in (("buckets", jobs.bucket_stream(stream, 5, "10 seconds")), ("ids", jobs.dedup_stream(stream, delay="10 seconds"))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    want = {tuple(r) for r in E.bucketize(t, 5).where("start_ms < 2000000").select("start_ms", "open", "close", "trades").collect()}
    assert {tuple(r) for r in spark.sql("select start_ms, open, close, trades from buckets").collect()} == want
    assert spark.sql("select * from ids").count() == 31


def test_parameters():
    for bad in (lambda: Grid(7, 60), lambda: Grid(5, 15), lambda: Grid(5, 60, 120, 50), lambda: Channel("x", "loud"), lambda: Rules(())):
        with pytest.raises(ValueError):
            bad()
