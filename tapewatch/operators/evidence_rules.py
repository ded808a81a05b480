"""Rules on a recorded status, kept as tables and run on each value, read once from its variant, in Arrow batches.

A table lists (field, test, wording): the field of a map, what its value must be, and what the message says of it. A test
that ends in `?` also lets a missing or null value pass. Tables apply to the status itself, to its parts, or to every entry
of a map or list below it; messages name the entry. They come in the order of the tables, entries of maps by name.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewatch.functions import variants
from tapewatch.functions.jsontree import entries, field, flag, is_kind, items, number, text, whole

Table = list[tuple[str, str, str]]

MOST_ERRORS = 64
BAD, WRONG = "is missing or invalid", "is invalid"

# The tasks that every instance runs, the one that it runs where checkpoints are enabled, the states of a
# sound task, the outcomes that are counted, and the reasons of a market that is only quiet.
BASE_TASKS = ["event-consumer", "detector", "health-monitor", "maintenance", "alert-workers"]
CHECKPOINT_TASK = "state-checkpoint"
SOUND_STATES = ["starting", "running"]
OUTCOMES = ["attempt", "failure", "queued", "success"]
QUIET_REASONS = ["ready", "stale_data"]

# Fields, what they must be, and how messages call a value that is not.
STATUS: Table = [
    ("ok", "flag", BAD), ("runtime_started_ms", "time", BAD), ("uptime_seconds", "number", BAD), ("queue_size", "count", BAD), ("queue_capacity", "size", BAD),
]
FEED_FLAGS: Table = [("healthy", "flag", BAD), ("connected", "flag", BAD), ("subscription_acknowledged", "flag", BAD)]
FEED: Table = [
    ("message_age_seconds", "number?", WRONG), ("reconnects", "count", BAD), ("dropped_events", "count", BAD), ("trades", "count", BAD), ("liquidations", "count", BAD),
]
SYMBOL: Table = [
    ("healthy", "flag", BAD), ("message_age_seconds", "number?", WRONG), ("messages", "count", WRONG), ("trades", "count", WRONG), ("liquidations", "count", WRONG),
]
CHECKPOINT: Table = [("enabled", "flag", BAD), ("healthy", "flag", BAD), ("reason", "name", BAD)]
CHECKPOINT_ENABLED: Table = [
    ("path_exists", "flag", BAD), ("within_initial_allowance", "flag", BAD), ("last_success_age_seconds", "number?", WRONG),
    ("path_age_seconds", "number?", WRONG), ("last_failure_ms", "time?", WRONG),
]
TASK: Table = [
    ("state", "name", BAD), ("ready", "flag", BAD), ("heartbeat_age_seconds", "number", BAD), ("heartbeat_stale", "flag", BAD), ("last_error", "text", BAD),
]
QUEUE: Table = [
    ("high_water", "count", BAD), ("drops_total", "count", BAD), ("drops_since_last_health_check", "count", BAD), ("consumer_lag_seconds", "number", BAD),
    ("utilization", "share", BAD),
]
CLOCK: Table = [("future_events_quarantined", "count", BAD), ("clock_adjustments", "count", BAD), ("last_quarantine_ms", "time?", WRONG)]
DELIVERY: Table = [("enabled", "flag", BAD), ("local_queue_depth", "count", BAD), ("counts", "map", BAD)]
COUNTS: Table = [(name, "count", BAD) for name in OUTCOMES]
MARKET: Table = [
    ("readiness_reasons", "names", "is missing, empty, or invalid"), ("readiness_reason", "name", BAD), ("max_recovery_seconds_remaining", "number", BAD),
    ("min_window_coverage_ratio", "share", BAD), ("max_largest_gap_seconds", "number?", WRONG),
]
VENUE_FLAGS: Table = [("ready", "flag", WRONG), ("base_ready", "flag", WRONG), ("alert_eligible", "flag", WRONG)]
VENUE: Table = [("reason", "name", BAD), ("data_age_seconds", "number?", WRONG)]


def _real(v: object, least: float = 0.0, most: float = sys.float_info.max) -> bool:
    return type(v) in (int, float) and least <= v <= most


def _name(v: object) -> bool:
    return type(v) is str and v != ""


def _all(v: object, test: Callable[[object], bool]) -> bool:
    return type(v) is list and all(map(test, v))


#: What a value read from a variant must be; None is missing or null.
TESTS: dict[str, Callable[[object], bool]] = {
    "flag": lambda v: type(v) is bool,
    "text": lambda v: type(v) is str,
    "map": lambda v: type(v) is dict,
    "name": _name,
    "names": lambda v: _all(v, _name) and len(v) > 0,
    "count": lambda v: type(v) is int and v >= 0,
    "size": lambda v: type(v) is int and v > 0,
    "number": _real,
    "share": lambda v: _real(v, 0.0, 1.0),
    "time": lambda v: _real(v, 1.0),
}


def _field(v: object, name: str) -> object:
    return v.get(name) if type(v) is dict else None


def _entries(v: object) -> list[tuple[str, object]]:
    return list(v.items()) if type(v) is dict else []


def _items(v: object) -> list[object]:
    return v if type(v) is list else []


def _told(v: object, table: Table, place: str = "") -> list[str]:
    """One message for each line of the table that does not hold."""
    found = []
    for name, test, wording in table:
        x = _field(v, name)
        if not (TESTS[test.rstrip("?")](x) or x is None and test[-1] == "?"):
            found.append(f"{place}{name} {wording}")
    return found


def _one(bad: bool, message: str) -> list[str]:
    return [message] if bad else []


def _part(i: dict, name: str) -> tuple[object, list[str]]:
    """A map below the status, and the message if it is none."""
    v = i.get(name)
    return v, _one(type(v) is not dict, f"{name} {BAD}")


def _symbols(feed: dict, name: str) -> list[str]:
    symbols = _entries(feed.get("symbols"))
    out = _one(not symbols, f"feeds.{name}.symbols is missing, invalid, or empty")
    for key, v in symbols:
        place = f"feeds.{name}.symbols.{key}"
        out += _one(key == "", f"feeds.{name} contains an invalid symbol name")
        out += _told(v, SYMBOL, f"{place}.") if type(v) is dict else [f"{place} is invalid"]
    return out


def _feeds(i: dict, ready: bool) -> list[str]:
    feeds = _entries(i.get("feeds"))
    out = _one(not feeds, "feeds is missing, invalid, or empty")
    for name, v in feeds:
        out += _one(name == "", "feed name is invalid")
        if type(v) is not dict:
            out.append(f"feeds.{name} is invalid")
            continue
        out += _told(v, FEED_FLAGS, f"feeds.{name}.") + _one(ready and v.get("healthy") is not True, f"ready instance contains unhealthy feed {name}")
        out += _told(v, FEED, f"feeds.{name}.") + _symbols(v, name)
    return out


def _expected_tasks(i: dict) -> list[str]:
    """The tasks that a status must tell of, sorted: the base set, one for each feed, and the checkpoint task where enabled."""
    more = [CHECKPOINT_TASK] if _field(i.get("checkpoint_health"), "enabled") is True else []
    return sorted({*BASE_TASKS, *(f"feed-{name}" for name, _ in _entries(i.get("feeds"))), *more})


def _tasks(i: dict, ready: bool) -> list[str]:
    told, tasks, want = i.get("expected_tasks"), i.get("tasks"), _expected_tasks(i)
    sound = _all(told, _name) and len(set(told)) == len(told)
    out = _one(not sound, f"expected_tasks {BAD}") + _one(sound and sorted(told) != want, "expected_tasks does not match feeds/checkpoint evidence")
    out += _one(type(tasks) is not dict, f"tasks {BAD}")
    for name in want:
        v = _field(tasks, name)
        if type(v) is not dict:
            out.append(f"expected task {name} {BAD}")
            continue
        healthy = v.get("state") in SOUND_STATES and v.get("ready") is True and v.get("heartbeat_stale") is False
        out += _told(v, TASK, f"tasks.{name}.") + _one(ready and not healthy, f"ready instance contains unhealthy expected task {name}")
    return out


def _venues_of(m: dict) -> tuple[int, int, bool]:
    """As `venue_counts`."""
    whole64 = lambda v: v if type(v) is int and -(1 << 63) <= v < 1 << 63 else 0
    configured, ready = (whole64(m.get(f"{n}_venues")) for n in ("configured", "ready"))
    return configured, ready, configured > 0 and 0 <= ready <= configured


def _market(m: dict, prefix: str) -> list[str]:
    configured, ready, valid = _venues_of(m)
    venues = _entries(m.get("venue_readiness"))
    out = _told(m, [("symbol", "name", BAD)], f"{prefix}.") + _one(not valid, f"{prefix} venue counts are missing or invalid") + _told(m, MARKET, f"{prefix}.")
    out += _one(not venues, f"{prefix}.venue_readiness is missing, invalid, or empty")
    out += _one(len(venues) > 0 and valid and len(venues) != configured, f"{prefix}.venue_readiness count does not match configured_venues")
    for key, v in venues:
        place = f"{prefix}.venue_readiness.{key}"
        out += _one(key == "", f"{prefix}.venue_readiness contains an invalid venue name")
        out += _told(v, VENUE_FLAGS, f"{place}.") + _told(v, VENUE, f"{place}.") if type(v) is dict else [f"{place} is invalid"]
    eligible = sum(_field(v, "alert_eligible") is True for _, v in venues)
    return out + _one(len(venues) > 0 and valid and eligible != ready, f"{prefix}.ready_venues does not match venue readiness evidence")


def _markets(i: dict) -> list[str]:
    markets = _items(i.get("markets"))
    out = _one(not markets, "markets is missing, invalid, or empty")
    for at, m in enumerate(markets):
        out += _market(m, f"markets[{at}]") if type(m) is dict else [f"markets[{at}] is invalid"]
    return out


def _readiness(i: dict) -> list[str]:
    v, missing = _part(i, "readiness")
    ok, ready = i.get("ok"), _field(v, "ready")
    differ = type(ok) is bool and type(ready) is bool and ok != ready
    out = missing + _told(v, [("ready", "flag", BAD)], "readiness.") + _one(differ, "ok does not match readiness.ready") + _told(v, [("state", "name", BAD)], "readiness.")
    return out + _one(not _all(_field(v, "reasons"), TESTS["text"]), f"readiness.reasons {BAD}")


def _checkpoint(i: dict, ready: bool) -> list[str]:
    v, missing = _part(i, "checkpoint_health")
    out = missing + _told(v, CHECKPOINT, "checkpoint_health.")
    if _field(v, "enabled") is True:
        out += _told(v, CHECKPOINT_ENABLED, "checkpoint_health.") + _one(ready and v.get("healthy") is not True, "ready instance contains an unhealthy checkpoint")
    return out


def _plain_part(i: dict, name: str, table: Table) -> list[str]:
    v, missing = _part(i, name)
    return missing + _told(v, table, f"{name}.")


def _instance(i: object) -> list[str]:
    if type(i) is not dict:
        return [f"instance section {BAD}"]
    ready = i.get("ok") is True
    listed = (
        _one(i.get("evidence_complete") is not True, "evidence_complete is not true") + _one(i.get("evidence_errors") != [], "evidence_errors is missing, invalid, or nonempty")
        + _told(i, STATUS) + _readiness(i) + _feeds(i, ready) + _checkpoint(i, ready) + _tasks(i, ready) + _plain_part(i, "queue_health", QUEUE) + _plain_part(i, "clock_health", CLOCK)
        + _plain_part(i, "alarm_delivery", DELIVERY) + _told(_field(i.get("alarm_delivery"), "counts"), COUNTS, "alarm_delivery.counts.") + _markets(i)
    )
    return listed[:MOST_ERRORS]


def _container(d: object) -> list[str]:
    if type(d) is not dict:
        return [f"docker section {BAD}"]
    return (
        _one(d.get("observed") is not True, "docker state was not explicitly observed") + _one(d.get("present") is not True, "docker container is absent")
        + _one(d.get("running") is not True or d.get("status") != "running", "docker container is not running") + _one(d.get("health") != "healthy", "docker container is not healthy")
        + _told(d, [("restart_count", "count", BAD), ("container_id", "name", BAD), ("started_at", "name", BAD)], "docker ")
    )


def _column(rules: Callable[[object], list[str]]) -> Callable[[Column], Column]:
    def run(v: pa.Array) -> pa.Array:
        return pa.array([rules(x) for x in variants.values(v)], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")


def instance_errors(i: Column) -> Column:
    """What is wrong with the status of an instance (a variant), at most 64 messages; one if it is no map at all."""
    return _column(_instance)(i)


def container_errors(d: Column) -> Column:
    """What is wrong with the state of the container (a variant)."""
    return _column(_container)(d)


def told(timestamp_ms: Column, sample: Column) -> Column:
    """Which parts of each sample have errors, and those errors that no earlier sample of its batch has, with their place.

    Of an issue, every batch tells the first place, so the first of all is among them.
    """
    return F.arrow_udf(_told_rows, "primary boolean, shadow boolean, docker boolean, malformed_gap boolean, issues array<struct<part:int,at:int,issue:string>>")(timestamp_ms, sample)


def _told_rows(times: pa.Array, samples: pa.Array) -> pa.Array:
    when, found, seen = times.to_pylist(), variants.values(samples), set()
    rows: list[dict | None] = [None] * len(when)
    for k in sorted(range(len(when)), key=lambda k: (when[k] is not None, when[k] or 0)):
        parts = {"primary": _instance(_field(found[k], "primary")), "shadow": _instance(_field(found[k], "shadow")), "docker": _container(_field(found[k], "docker"))}
        rows[k] = {n: len(errors) > 0 for n, errors in parts.items()} | {"malformed_gap": not _real(_field(found[k], "monitor_gap_seconds")), "issues": []}
        for at_part, (n, errors) in enumerate(parts.items()):
            for at, error in enumerate(errors):
                if (n, error) not in seen:
                    seen.add((n, error))
                    rows[k]["issues"].append({"part": at_part, "at": at, "issue": f"{n}: {error}"})
    return pa.array(rows, pa.struct([*((n, pa.bool_()) for n in ("primary", "shadow", "docker", "malformed_gap")), ("issues", pa.list_(pa.struct([("part", pa.int32()), ("at", pa.int32()), ("issue", pa.string())])))]))


# ---- the same as columns


def sure(test: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(test, F.lit(False))


def is_number(v: Column) -> Column:
    """As the test "number"."""
    return sure(number(v).between(0.0, sys.float_info.max))  # not-a-number is above all others


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def venue_counts(market: Column) -> tuple[Column, Column, Column]:
    """(configured, ready, whether they can be so); values that are no whole numbers count as 0."""
    configured, ready = (F.coalesce(whole(field(market, f"{n}_venues")), F.lit(0)) for n in ("configured", "ready"))
    return configured, ready, (configured > 0) & (ready >= 0) & (ready <= configured)


# ---- markets: ready, quiet or unready


def _reasons(m: Column) -> Column:
    """Told reasons, trimmed, in small letters, sorted, each once; a value that is no text makes them invalid."""
    told = items(field(m, "readiness_reasons"))
    trimmed = F.transform(told, lambda x: F.lower(F.regexp_replace(_string(x), r"(?U)^\s+|\s+$", "")))
    sound = F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x != "")))
    none = F.array().cast("array<string>")
    return F.when(told.isNull(), none).when(F.exists(told, lambda x: ~is_kind(x, "text")), F.array(F.lit("<invalid>"))).otherwise(sound)


def _recovered(m: Column) -> Column:
    return sure(number(field(m, "max_recovery_seconds_remaining")) == 0)


def transport_healthy(i: Column) -> Column:
    """The instance is ok and ready and has feeds, all of them healthy."""
    feeds = entries(field(i, "feeds"))
    return sure(flag(field(i, "ok"))) & sure(flag(field(field(i, "readiness"), "ready"))) & sure((F.size(feeds) > 0) & F.forall(feeds, lambda f: sure(flag(field(f["value"], "healthy")))))


def quiet_market(i: Column, m: Column) -> Column:
    """Some but not all venues are ready, all others only stale, nothing recovers, and the feeds are healthy."""
    configured, ready, _ = venue_counts(m)
    venues = entries(field(m, "venue_readiness"))

    def fair(x: Column) -> Column:
        v = x["value"]
        is_ready, eligible, reason = flag(field(v, "ready")), flag(field(v, "alert_eligible")), text(field(v, "reason"))
        return sure((is_ready == eligible) & (reason == F.when(eligible, QUIET_REASONS[0]).otherwise(QUIET_REASONS[1])))

    some = sure((F.size(venues) > 0) & F.forall(venues, fair))
    return (ready > 0) & (ready < configured) & transport_healthy(i) & some & _recovered(m) & (_reasons(m) == F.array(*(F.lit(r) for r in QUIET_REASONS)))


def market_states(i: Column, instance: Column) -> Column:
    """(state, pair, ratio) for each market of a status; a status without markets has one unready market `unknown:missing`."""
    state = lambda s, pair, ratio: F.struct(s.alias("state"), pair.alias("pair"), ratio.alias("ratio"))
    lost = lambda why: state(F.lit("unready"), F.concat(instance, F.lit(f":unknown:{why}")), F.lit(0.0))
    markets = items(field(i, "markets"))

    def one(m: Column) -> Column:
        configured, ready, valid = venue_counts(m)
        pair = F.concat(instance, F.lit(":"), F.coalesce(F.nullif(_string(field(m, "symbol")), F.lit("")), F.lit("unknown")), F.lit(":"), ready.cast("string"), F.lit("/"), configured.cast("string"))
        whole_ready = (F.size(F.array_except(_reasons(m), F.array(F.lit(QUIET_REASONS[0])))) == 0) & _recovered(m)
        of = F.when(~valid, "unready").when(ready < configured, F.when(quiet_market(i, m), "quiet").otherwise("unready")).when(whole_ready, "ready").otherwise("unready")
        return F.when(is_kind(m, "map"), state(of, pair, F.when(valid, ready / configured).otherwise(0.0))).otherwise(lost("invalid"))

    return F.when(sure(F.size(markets) > 0), F.transform(markets, one)).otherwise(F.array(lost("missing")))
