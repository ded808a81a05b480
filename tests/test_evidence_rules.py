import copy
import json

import pytest
from pyspark.sql import functions as F
from test_operators import sample

from tapewatch.functions import jsontree
from tapewatch.operators import evidence as G
from tapewatch.operators import evidence_rules as R

GONE = object()
SOUND = json.loads(sample(0))["primary"]
OKX, BTC, M, V, T = ("feeds", "okx"), ("feeds", "okx", "symbols", "BTC"), ("markets", 0), ("markets", 0, "venue_readiness", "okx"), ("tasks", "detector")
ENABLED = {"enabled": True, "healthy": True, "reason": "fresh", "path_exists": True, "within_initial_allowance": False, "last_success_age_seconds": 1.5, "path_age_seconds": None, "last_failure_ms": 5}
WITH_CHECKPOINT = [
    (("checkpoint_health",), ENABLED), (("expected_tasks",), [*SOUND["expected_tasks"], "state-checkpoint"]), (("tasks", "state-checkpoint"), SOUND["tasks"]["detector"]),
]
BAD = "is missing or invalid"


def changed(*changes):
    out = copy.deepcopy(SOUND)
    for path, value in changes:
        at = out
        for p in path[:-1]:
            at = at[p]
        if value is GONE:
            del at[path[-1]]
        else:
            at[path[-1]] = copy.deepcopy(value)
    return out


def fields(path, names, place, values, wording=BAD):
    """Each field with each value gives its message (and no other)."""
    return [([((*path, n), v)], [f"{place}{n} {wording}"]) for n in names for v in values]


COUNT, NUMBER, OPTIONAL = (GONE, -1, 1.0, "1", True), (GONE, None, -0.5, "1", True, float("nan"), float("inf")), (-0.5, "1", True, float("nan"))
CASES = [
    ([], []), (WITH_CHECKPOINT, []),
    ([(("queue_size",), 10**30)], []), ([((*OKX, "message_age_seconds"), None)], []), ([((*OKX, "message_age_seconds"), GONE)], []), ([((*M, "max_largest_gap_seconds"), None)], []),
    ([(("clock_health", "last_quarantine_ms"), 1)], []), ([(("ok",), False), (("readiness", "ready"), False), ((*OKX, "healthy"), False), ((*T, "heartbeat_stale"), True)], []),
    ([((*T, "last_error"), "boom")], []), ([(("queue_size",), 500)], []), ([((*OKX, "connected"), False)], []),
    ([(("evidence_complete",), "true")], ["evidence_complete is not true"]), ([(("evidence_errors",), ["x"])], ["evidence_errors is missing, invalid, or nonempty"]),
    ([(("evidence_errors",), GONE)], ["evidence_errors is missing, invalid, or nonempty"]),
    *fields((), ["ok"], "", (GONE, 1, "true")), *fields((), ["runtime_started_ms"], "", (GONE, 0, "1")), *fields((), ["uptime_seconds"], "", NUMBER),
    *fields((), ["queue_size"], "", COUNT), *fields((), ["queue_capacity"], "", (*COUNT, 0)),
    ([(("readiness",), 5)], [f"readiness {BAD}", f"readiness.ready {BAD}", f"readiness.state {BAD}", f"readiness.reasons {BAD}"]),
    *fields(("readiness",), ["ready"], "readiness.", (GONE, "x")), *fields(("readiness",), ["state"], "readiness.", (GONE, "", 5)), *fields(("readiness",), ["reasons"], "readiness.", (GONE, {}, [5], ["a", None])),
    ([(("readiness", "ready"), False)], ["ok does not match readiness.ready"]),
    ([(("feeds",), {})], ["feeds is missing, invalid, or empty", "expected_tasks does not match feeds/checkpoint evidence"]),
    ([(("feeds", "okx"), 5)], ["feeds.okx is invalid"]),
    *[([((*OKX, "healthy"), v)], [f"feeds.okx.healthy {BAD}", "ready instance contains unhealthy feed okx"]) for v in (GONE, None, "true")],
    ([((*OKX, "healthy"), False)], ["ready instance contains unhealthy feed okx"]),
    *fields(OKX, ["connected", "subscription_acknowledged"], "feeds.okx.", (GONE, 1)), *fields(OKX, ["message_age_seconds"], "feeds.okx.", OPTIONAL, "is invalid"),
    *fields(OKX, ["reconnects", "dropped_events", "trades", "liquidations"], "feeds.okx.", COUNT),
    ([((*OKX, "symbols"), {})], ["feeds.okx.symbols is missing, invalid, or empty"]), ([((*OKX, "symbols"), [1])], ["feeds.okx.symbols is missing, invalid, or empty"]),
    ([(BTC, None)], ["feeds.okx.symbols.BTC is invalid"]), ([((*OKX, "symbols", ""), SOUND["feeds"]["okx"]["symbols"]["BTC"])], ["feeds.okx contains an invalid symbol name"]),
    *fields(BTC, ["healthy"], "feeds.okx.symbols.BTC.", (GONE, 0)), *fields(BTC, ["message_age_seconds"], "feeds.okx.symbols.BTC.", OPTIONAL, "is invalid"),
    *fields(BTC, ["messages", "trades", "liquidations"], "feeds.okx.symbols.BTC.", COUNT, "is invalid"),
    ([(("checkpoint_health",), GONE)], [f"checkpoint_health{x} {BAD}" for x in ("", ".enabled", ".healthy", ".reason")]),
    *fields(("checkpoint_health",), ["reason"], "checkpoint_health.", (GONE, "")),
    *[([*WITH_CHECKPOINT, *c], e) for c, e in fields(("checkpoint_health",), ["path_exists", "within_initial_allowance"], "checkpoint_health.", (GONE, 1))],
    *[([*WITH_CHECKPOINT, *c], e) for c, e in fields(("checkpoint_health",), ["last_success_age_seconds", "path_age_seconds"], "checkpoint_health.", OPTIONAL, "is invalid")],
    ([*WITH_CHECKPOINT, (("checkpoint_health", "last_failure_ms"), 0)], ["checkpoint_health.last_failure_ms is invalid"]),
    ([*WITH_CHECKPOINT, (("checkpoint_health", "healthy"), False)], ["ready instance contains an unhealthy checkpoint"]),
    *fields((), ["expected_tasks"], "", (GONE, "x", ["a", "a"], [""], [5])), ([(("expected_tasks",), ["detector"])], ["expected_tasks does not match feeds/checkpoint evidence"]),
    ([(("tasks",), 7)], [f"tasks {BAD}", *(f"expected task {t} {BAD}" for t in sorted(SOUND["expected_tasks"]))]), ([(("tasks", "feed-okx"), GONE)], [f"expected task feed-okx {BAD}"]),
    *[([((*T, "state"), v)], [f"tasks.detector.state {BAD}", "ready instance contains unhealthy expected task detector"]) for v in (GONE, "", 5)],
    *[([((*T, n), GONE)], [f"tasks.detector.{n} {BAD}", "ready instance contains unhealthy expected task detector"]) for n in ("ready", "heartbeat_stale")],
    *fields(T, ["heartbeat_age_seconds"], "tasks.detector.", NUMBER), *fields(T, ["last_error"], "tasks.detector.", (GONE, None, 5)),
    *[([((*T, n), v)], ["ready instance contains unhealthy expected task detector"]) for n, v in (("state", "failed"), ("ready", False), ("heartbeat_stale", True))],
    *fields(("queue_health",), ["high_water", "drops_total", "drops_since_last_health_check"], "queue_health.", COUNT), *fields(("queue_health",), ["consumer_lag_seconds"], "queue_health.", NUMBER),
    *fields(("queue_health",), ["utilization"], "queue_health.", (*NUMBER, 1.01)), *fields(("clock_health",), ["future_events_quarantined", "clock_adjustments"], "clock_health.", COUNT),
    *fields(("clock_health",), ["last_quarantine_ms"], "clock_health.", (0, "5"), "is invalid"), *fields(("alarm_delivery",), ["enabled"], "alarm_delivery.", (GONE,)), *fields(("alarm_delivery",), ["local_queue_depth"], "alarm_delivery.", COUNT),
    ([(("alarm_delivery", "counts"), [])], [f"alarm_delivery.counts{x} {BAD}" for x in ("", ".attempt", ".failure", ".queued", ".success")]),
    ([(("markets",), [])], ["markets is missing, invalid, or empty"]), ([(M, "x")], ["markets[0] is invalid"]), *fields(M, ["symbol"], "markets[0].", (GONE, "", 5)),
    *[([((*M, n), v)], ["markets[0] venue counts are missing or invalid"]) for n, v in (("configured_venues", 0), ("configured_venues", "1"), ("ready_venues", 2), ("ready_venues", -1))],
    *fields(M, ["readiness_reasons"], "markets[0].", (GONE, [], [""], [5]), "is missing, empty, or invalid"), *fields(M, ["readiness_reason"], "markets[0].", (GONE, "")),
    *fields(M, ["max_recovery_seconds_remaining"], "markets[0].", NUMBER), *fields(M, ["min_window_coverage_ratio"], "markets[0].", (*NUMBER, 1.5)), *fields(M, ["max_largest_gap_seconds"], "markets[0].", OPTIONAL, "is invalid"),
    ([((*M, "venue_readiness"), {})], ["markets[0].venue_readiness is missing, invalid, or empty"]),
    ([((*M, "configured_venues"), 2)], ["markets[0].venue_readiness count does not match configured_venues"]),
    ([((*M, "ready_venues"), 0)], ["markets[0].ready_venues does not match venue readiness evidence"]),
    ([(V, 5)], ["markets[0].venue_readiness.okx is invalid", "markets[0].ready_venues does not match venue readiness evidence"]),
    *fields(V, ["ready", "base_ready"], "markets[0].venue_readiness.okx.", (GONE, 1), "is invalid"), *fields(V, ["reason"], "markets[0].venue_readiness.okx.", (GONE, "")),
    *fields(V, ["data_age_seconds"], "markets[0].venue_readiness.okx.", OPTIONAL, "is invalid"),
]


def test_each_rule_tells_what_is_wrong(spark):
    rows = [(i, json.dumps(changed(*c))) for i, (c, _) in enumerate(CASES)]
    # no map at all, and a value for every rule at once
    rows += [(-1, "[]"), (-2, "null"), (-3, json.dumps({"feeds": {f"f{i}": 1 for i in range(100)}}))]
    v = spark.createDataFrame(rows, "i int, t string").select("i", jsontree.parsed(F.col("t")).alias("v"))
    got = {r.i: r.e for r in v.select("i", R.instance_errors(F.col("v")).alias("e")).collect()}
    for i, (c, want) in enumerate(CASES):
        assert got[i] == want, c
    assert got[-1] == got[-2] == ["instance section is missing or invalid"]
    assert len(got[-3]) == 64


def test_container(spark):
    box = json.loads(sample(0))["docker"]
    cases = [({}, []), ({"observed": None}, ["docker state was not explicitly observed"]), ({"present": False}, ["docker container is absent"]), ({"status": "exited"}, ["docker container is not running"]),
             ({"health": "starting"}, ["docker container is not healthy"]), ({"restart_count": 1.5, "container_id": "", "started_at": 5}, [f"docker {n} {BAD}" for n in ("restart_count", "container_id", "started_at")])]
    df = spark.createDataFrame([(i, json.dumps(box | c)) for i, (c, _) in enumerate(cases)] + [(99, "5")], "i int, t string")
    got = {r.i: r.e for r in df.select("i", R.container_errors(jsontree.parsed(F.col("t"))).alias("e")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)} | {99: [f"docker section {BAD}"]}


def market(ready, configured, reasons=("ready",), recovery=0, venues=None, **more):
    return {"symbol": "BTC", "ready_venues": ready, "configured_venues": configured, "readiness_reasons": list(reasons), "max_recovery_seconds_remaining": recovery, "venue_readiness": venues or {}} | more


UP, STALE = {"ready": True, "alert_eligible": True, "reason": "ready"}, {"ready": False, "alert_eligible": False, "reason": "stale_data"}
QUIET = market(1, 2, (" Ready", "stale_data ", ""), venues={"a": UP, "b": STALE})
STATES = [
    (GONE, "unready", "unknown:missing", 0.0), ([], "unready", "unknown:missing", 0.0), ("x", "unready", "unknown:missing", 0.0), ([5], "unready", "unknown:invalid", 0.0),
    ([market(2, 2)], "ready", "BTC:2/2", 1.0), ([market(2, 2, recovery=3)], "unready", "BTC:2/2", 1.0), ([market(2, 2, recovery=None)], "unready", "BTC:2/2", 1.0), ([market(2, 2, ("ready", "gap"))], "unready", "BTC:2/2", 1.0),
    ([market(2, 2, (5,))], "unready", "BTC:2/2", 1.0), ([market(2, 2, ())], "ready", "BTC:2/2", 1.0), ([market(3, 2)], "unready", "BTC:3/2", 0.0), ([market("1", 2, symbol="")], "unready", "unknown:0/2", 0.0), ([market(0, None)], "unready", "BTC:0/0", 0.0),
    ([QUIET], "quiet", "BTC:1/2", 0.5), ([QUIET | {"max_recovery_seconds_remaining": 1}], "unready", "BTC:1/2", 0.5), ([QUIET | {"ready_venues": 0}], "unready", "BTC:0/2", 0.0), ([QUIET | {"readiness_reasons": ["ready"]}], "unready", "BTC:1/2", 0.5),
    ([QUIET | {"venue_readiness": {"a": UP, "b": STALE | {"ready": True}}}], "unready", "BTC:1/2", 0.5), ([QUIET | {"venue_readiness": {"a": UP, "b": STALE | {"reason": "gap"}}}], "unready", "BTC:1/2", 0.5),
]


def test_market_states(spark):
    up = {"ok": True, "readiness": {"ready": True}, "feeds": {"a": {"healthy": True}}}
    rows = [(i, json.dumps(up if m is GONE else up | {"markets": m})) for i, (m, *_) in enumerate(STATES)]
    down = [{"ok": False}, {"readiness": {"ready": False}}, {"feeds": {}}, {"feeds": {"a": {"healthy": True}, "b": {"healthy": False}}}]
    rows += [(100 + i, json.dumps(up | {"markets": [QUIET]} | d)) for i, d in enumerate(down)] + [(200, "null")]
    v = spark.createDataFrame(rows, "i int, t string").select("i", jsontree.parsed(F.col("t")).alias("v"))
    got = {r.i: [tuple(m) for m in r.m] for r in v.select("i", R.market_states(F.col("v"), F.lit("p")).alias("m")).collect()}
    for i, (m, *want) in enumerate(STATES):
        assert got[i] == [(want[0], f"p:{want[1]}", want[2])], m
    assert all(got[100 + i] == [("unready", "p:BTC:1/2", 0.5)] for i in range(len(down)))
    assert got[200] == [("unready", "p:unknown:missing", 0.0)]


@pytest.fixture
def mixed(spark):
    up = {"ok": True, "readiness": {"ready": True}, "feeds": {"a": {"healthy": True}}}
    bodies = [{"primary": up | {"markets": [QUIET, market(1, 1)]}, "shadow": up | {"markets": [QUIET, market(2, 2, recovery=9)]}, "monitor_gap_seconds": 0}, {"primary": up | {"markets": [market(1, 1)]}}, {}]
    return G.parsed(spark.createDataFrame([(1000 * i, json.dumps(b)) for i, b in enumerate(bodies)], "timestamp_ms long, body string"))


def test_no_evidence_is_unready(mixed):
    got = G.detector_readiness(mixed).first().asDict()
    assert got == {
        "unready_samples": 4, "quiet_samples": 2, "min_ready_ratio": 0.0, "quiet_pairs": ["primary:BTC:1/2", "shadow:BTC:1/2"],
        "unready_pairs": ["primary:unknown:missing", "shadow:BTC:2/2", "shadow:unknown:missing"],
    }
    none = G.detector_readiness(mixed.where("false")).first()
    assert (none.unready_samples, none.min_ready_ratio, none.unready_pairs) == (0, 1.0, [])


def test_issues_in_the_order_of_the_samples(mixed):
    rows = G.evidence_issues(mixed, most=3).collect()
    assert [r.issue for r in rows[:3]] == ["primary: evidence_complete is not true", "primary: evidence_errors is missing, invalid, or nonempty", f"primary: runtime_started_ms {BAD}"]
    assert [(r.issue, r.samples, r.first_ms) for r in rows[3:]] == [(f"sample: monitor_gap_seconds {BAD}", 2, 1000)]
    every = {r.issue: r.samples for r in G.evidence_issues(mixed, most=1000).collect()}
    assert every["shadow: instance section is missing or invalid"] == 2 and every[f"docker: docker section {BAD}"] == 3
