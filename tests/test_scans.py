"""Running sums and maxima by chunks, and the operators that use them, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapewatch import schemas
from tapewatch.functions.series import scanned
from tapewatch.operators import continuity as C
from tapewatch.operators import events as E
from tapewatch.operators import health as H
from tapewatch.sources.frames import kafka_frames, read_frames

DAY = 86_400_000


@pytest.mark.parametrize(("how", "own"), [("sum", True), ("sum", False), ("max", True), ("max", False)])
def test_scan_equals_a_loop(spark, how, own):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([None, rng.randrange(-9, 9)])) for k in range(300) if not 60 < k < 120]
    df = spark.createDataFrame(rows, "s string, k long, v long").repartition(7)
    found = {r.k: r.x for r in scanned(df, ["s"], ["k"], F.floor(F.col("k") / 7), F.col("v"), "x", how, own).collect()}
    seen, want = {}, {}
    for s, k, v in rows:
        past = seen.setdefault(s, [])
        if own and v is not None:
            past.append(v)
        want[k] = (sum if how == "sum" else max)(past) if past else None
        if not own and v is not None:
            past.append(v)
    assert found == want
    assert scanned(df.where("false"), ["s"], ["k"], F.col("k"), F.col("v"), "x").count() == 0


def test_a_series_of_many_chunks_fills_as_many_groups(spark):
    df = spark.createDataFrame([("x", k) for k in range(1000)], "s string, id long")
    chunk = F.floor(F.col("id") / 10)
    plan = scanned(df, ["s"], ["id"], chunk, F.lit(1), "n")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("__chunk" in line.rsplit("], [", 2)[1] for line in windows) == 1
    assert scanned(df, ["s"], ["id"], chunk, F.lit(1), "n").where("n <> id + 1").count() == 0


def test_breaks_over_days_equal_loops(spark):
    rng = random.Random(8)
    events = [("x", rng.choice(["start", "end"]), rng.randrange(40) * DAY // 4, rng.choice("ab"), rng.choice(["BTC", "ETH"])) for _ in range(120)]
    want = []
    for symbol in ("BTC", "ETH"):
        opened, why = None, set()
        for _, phase, t, reason, _ in sorted((e for e in events if e[4] == symbol), key=lambda e: (e[2], e[1] == "end")):
            if phase == "start":
                opened, why = max(t, 1) if opened is None else min(opened, max(t, 1)), why | {reason}
            elif opened is not None:
                want.append((symbol, opened, max(t, opened + 1), ",".join(sorted(why))))
                opened, why = None, set()
        if opened is not None:
            want.append((symbol, opened, None, ",".join(sorted(why))))
    got = C.pair_breaks(spark.createDataFrame(events, schemas.CONTINUITY_EVENT).repartition(5)).collect()
    assert sorted(map(str, want)) == sorted(str((r.symbol, r.start_ms, r.end_ms, r.reason)) for r in got)

    spans = [(a, None if rng.random() < 0.01 else a + rng.randrange(1, DAY)) for a in (rng.randrange(60) * DAY // 2 for _ in range(150))]
    spans += spans[:40]  # equal breaks
    islands = []
    for a, b in sorted(spans, key=lambda s: (s[0], s[1] if s[1] is not None else C.FOREVER)):
        b = C.FOREVER if b is None else b
        if islands and a <= islands[-1][1]:
            islands[-1][1] = max(islands[-1][1], b)
        else:
            islands.append([a, b])
    df = spark.createDataFrame([("x", "BTC", a, b, "r") for a, b in spans], schemas.BREAK).repartition(6)
    got = sorted((r.start_ms, C.FOREVER if r.end_ms is None else r.end_ms) for r in C.merge_breaks(df).collect())
    assert got == [tuple(i) for i in islands] and len(islands) > 5
    assert C.merge_breaks(df.where("false")).count() == 0


def test_losses_and_positions_over_days(spark):
    log = spark.createDataFrame([("x" if k % 3 else "y", k * DAY // 3, "queue_drop" if k % 4 else "connect") for k in range(60)], "exchange string, timestamp_ms long, kind string")
    got = {(r.exchange, r.timestamp_ms): r.generation for r in C.loss_breaks(log).collect()}
    want, n = {}, {}
    for k in range(60):
        x = "x" if k % 3 else "y"
        if k % 4:
            n[x] = n.get(x, 0) + 1
            want[x, k * DAY // 3] = n[x]
    assert got == want
    liq = spark.createDataFrame([("x", "BTC", (k * 7 % 50) * DAY // 5, "i", k) for k in range(100)], "exchange string, symbol string, timestamp_ms long, event_id string, arrival_seq long")
    order = sorted(((k * 7 % 50) * DAY // 5, k) for k in range(100))
    assert {r.arrival_seq: r.position for r in E.order_liquidations(liq, 10**7).collect()} == {k: i + 1 for i, (_, k) in enumerate(order)}


def test_health_alerts_over_days(spark):
    bad = [k % 7 in (3, 4) for k in range(40)]
    h = spark.createDataFrame([(x, k * DAY // 3, not b, 1.0) for x in ("x", None) for k, b in enumerate(bad)], "exchange string, timestamp_ms long, healthy boolean, age_seconds double")
    got = {r.timestamp_ms: r.bypass for r in H.feed_health_alerts(h, 4).where("exchange = 'x'").collect()}
    want = {k * DAY // 3: not (b and bad[k - 1]) for k, b in enumerate(bad) if b or (k and bad[k - 1])}
    assert got == want and H.feed_health_alerts(h, 4).where("exchange is null").count() == len(want)


def test_trade_ids_against_a_fold(spark):
    rng = random.Random(5)
    rows = [("x", "BTC", 1_000_000 + k * 300 + rng.choice([0, 0, -900, 4000]), f"i{rng.randrange(40)}" if k % 5 else rng.choice([None, ""]), k) for k in range(600)]
    top, seen, want = 0, {}, []
    for _, _, ts, name, k in rows:
        top = max(top, ts)
        if name and ts >= top - 5000:
            if seen.get(name, -1) >= top - 5000:
                seen[name] = max(seen[name], ts)
                continue
            seen[name] = max(seen.get(name, -1), ts)
        want.append(k)
    df = spark.createDataFrame(rows, "exchange string, symbol string, timestamp_ms long, event_id string, arrival_seq long")
    got = sorted(r.arrival_seq for r in E.dedup_trades(df, 5).collect())
    assert got == want and 120 < len(want) < 560


def test_frames_of_several_partitions(spark):
    at = datetime(2024, 1, 1)
    # the second record of partition 0 carries an older stamp than the first, so it arrives right behind it
    rows = [(b"a", at + timedelta(seconds=5), "t", 0, 10), (b"b", at, "t", 0, 11), (b"c", at + timedelta(seconds=1), "t", 1, 10), (b"d", at + timedelta(seconds=90), "t", 1, 12), (None, at + timedelta(seconds=80), "t", 0, 14)]
    df = spark.createDataFrame(rows, "value binary, timestamp timestamp, topic string, partition int, offset long").repartition(3)
    got = kafka_frames(df).orderBy("arrival_seq").collect()
    assert [(r.frame, r.arrival_seq) for r in got] == [("c", 0), ("a", 1), ("b", 2), (None, 3), ("d", 4)]
    assert kafka_frames(df).schema.simpleString() == spark.createDataFrame([], schemas.FRAME).schema.simpleString()
    live = {r.frame: r.arrival_seq for r in kafka_frames(df, streaming=True).collect()}
    assert len(set(live.values())) == 5 and live["a"] < live["b"] and live["c"] < live["d"]
    assert kafka_frames(df.where("false")).count() == 0


def test_frames_of_files(spark, tmp_path):
    df = spark.createDataFrame([("{}", 5, 1.0, 0, 0), (None, None, None, None, 1)], schemas.FRAME)
    for fmt in ("json", "parquet"):
        df.write.format(fmt).save(str(tmp_path / fmt))
        assert sorted(map(str, read_frames(spark, str(tmp_path / fmt), fmt=fmt).collect())) == sorted(map(str, df.collect()))
