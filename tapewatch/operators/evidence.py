"""Evidence gate: rules and roll-ups over sampled status rows, down to one verdict.

Samples are rows (timestamp_ms, body) with the JSON body as text. Measures read it through explicit schemas, in which values
of a wrong type are null; rules, which tell a wrong type from a missing value, read it as a variant (`evidence_rules`).
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions import jsontree
from tapewatch.functions.series import by_time, previous, scanned
from tapewatch.functions.stats import finite
from tapewatch.operators import evidence_rules as rules
from tapewatch.params import Gate

SYMBOL = "struct<healthy:boolean,message_age_seconds:double,messages:bigint,trades:bigint,liquidations:bigint>"
FEED = f"struct<healthy:boolean,connected:boolean,subscription_acknowledged:boolean,message_age_seconds:double,dropped_events:bigint,reconnects:bigint,trades:bigint,liquidations:bigint,symbols:map<string,{SYMBOL}>>"
TASK = "struct<state:string,ready:boolean,heartbeat_age_seconds:double,heartbeat_stale:boolean,last_error:string>"
VENUE = "struct<ready:boolean,base_ready:boolean,alert_eligible:boolean,reason:string,data_age_seconds:double>"
MARKET = f"struct<symbol:string,ready_venues:bigint,configured_venues:bigint,readiness_reasons:array<string>,max_recovery_seconds_remaining:double,min_window_coverage_ratio:double,max_largest_gap_seconds:double,venue_readiness:map<string,{VENUE}>>"
INSTANCE = (
    "struct<ok:boolean,evidence_complete:boolean,evidence_errors:array<string>,runtime_started_ms:bigint,uptime_seconds:double,readiness:struct<ready:boolean,state:string,reasons:array<string>>,queue_size:bigint,queue_capacity:bigint,"
    f"feeds:map<string,{FEED}>,expected_tasks:array<string>,tasks:map<string,{TASK}>,queue_health:struct<high_water:bigint,drops_total:bigint,drops_since_last_health_check:bigint,consumer_lag_seconds:double,utilization:double>,"
    "clock_health:struct<future_events_quarantined:bigint,clock_adjustments:bigint,last_quarantine_ms:bigint>,alarm_delivery:struct<enabled:boolean,local_queue_depth:bigint,counts:map<string,bigint>>,"
    f"checkpoint_health:struct<enabled:boolean,healthy:boolean,last_success_age_seconds:double,age_seconds:double,failures:bigint,last_failure_ms:bigint>,markets:array<{MARKET}>>"
)
CONTAINER = "struct<observed:boolean,present:boolean,running:boolean,status:string,health:string,restart_count:bigint,container_id:string,started_at:string>"
INSTANCES = ("primary", "shadow")
MALFORMED_GAP = "sample: monitor_gap_seconds is missing or invalid"
SAMPLE = f"struct<timestamp:string,monitor_gap_seconds:double,primary:{INSTANCE},shadow:{INSTANCE},docker:{CONTAINER}>"


def parsed(rows: DataFrame) -> DataFrame:
    """timestamp_ms, the typed sample `s` and the sample as a variant `v`."""
    return rows.select("timestamp_ms", F.from_json("body", SAMPLE).alias("s"), jsontree.parsed(F.col("body")).alias("v"))


def dedup_samples(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first row per timestamp, one row with the count of the others)."""
    order = Window.partitionBy("timestamp_ms").orderBy("body")
    kept = rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return kept, rows.agg((F.count("*") - F.countDistinct("timestamp_ms")).alias("duplicates"))


def coverage(rows: DataFrame, interval_seconds: float) -> DataFrame:
    """Samples against those that fit between the first and the last: min(1, n / max(1, floor(duration / interval) + 1))."""
    d = (F.max("timestamp_ms") - F.min("timestamp_ms")) / 1000.0
    return rows.agg(F.count("*").alias("samples"), F.coalesce(d, F.lit(0.0)).alias("duration_seconds"), F.least(F.lit(1.0), F.count("*") / F.greatest(F.lit(1.0), F.floor(F.coalesce(d, F.lit(0.0)) / interval_seconds) + 1)).alias("coverage"))


def instances(samples: DataFrame) -> DataFrame:
    """One row for each sample and instance: timestamp_ms, instance, i (null if missing) and v, the same as a variant."""
    both = F.explode(F.array(*(F.struct(F.lit(n).alias("instance"), F.col(f"s.{n}").alias("i"), jsontree.field(F.col("v"), n).alias("v")) for n in INSTANCES)))
    return samples.select("timestamp_ms", both.alias("x")).select("timestamp_ms", "x.*")


def failure_counts(samples: DataFrame) -> DataFrame:
    """Per instance: samples that are not ok or missing, and the longest run of them."""
    return _failure_counts(instances(samples).select("instance", "timestamp_ms", _bad(F.col("i")).alias("bad")))


def _bad(i: Column) -> Column:
    return ~F.coalesce(i["ok"], F.lit(False))


def _failure_counts(rows: DataFrame) -> DataFrame:
    # the samples of a run have as many good ones before them
    runs = scanned(rows, ["instance"], ["timestamp_ms"], by_time(), F.when(F.col("bad"), 0).otherwise(1), "__run")
    sizes = runs.groupBy("instance", "__run").agg(F.count_if("bad").alias("n"))
    return sizes.groupBy("instance").agg(F.sum("n").alias("failures"), F.max("n").alias("longest_run"))


def monitor_gaps(samples: DataFrame, interval_seconds: float) -> DataFrame:
    """Explicit gaps above zero plus steps of at least 1.5 intervals between samples: how many and the largest."""
    return _monitor_gaps(samples.select("timestamp_ms", F.coalesce(F.col("s.monitor_gap_seconds"), F.lit(0.0)).alias("told")), interval_seconds)


def _monitor_gaps(told: DataFrame, interval_seconds: float) -> DataFrame:
    t = previous(told.withColumn("one", F.lit(0)), ["one"], ["timestamp_ms"], by_time(), F.col("timestamp_ms"), "before")
    t = t.withColumn("step", (F.col("timestamp_ms") - F.col("before")) / 1000.0)
    wide = F.coalesce(F.col("step") >= 1.5 * interval_seconds, F.lit(False))
    return t.agg((F.count_if(F.col("told") > 0) + F.count_if(wide)).alias("gaps"), F.coalesce(F.greatest(F.max(F.when(F.col("told") > 0, F.col("told"))), F.max(F.when(wide, F.col("step")))), F.lit(0.0)).alias("largest_gap_seconds"))


def runtime_restarts(samples: DataFrame) -> DataFrame:
    """Per instance, among rows with a start and an uptime: the start changed or the uptime fell by over a second."""
    return _runtime_restarts(instances(samples).select("instance", "timestamp_ms", _started(F.col("i")).alias("now")))


def _started(i: Column) -> Column:
    """The start and the uptime, null where either is missing or invalid."""
    valid = i["runtime_started_ms"].isNotNull() & finite(i["uptime_seconds"]) & (i["uptime_seconds"] >= 0)
    return F.when(valid, F.struct(i["runtime_started_ms"].alias("start"), i["uptime_seconds"].alias("uptime")))


def _runtime_restarts(rows: DataFrame) -> DataFrame:
    rows = previous(rows.where("now is not null"), ["instance"], ["timestamp_ms"], by_time(), F.col("now"), "was")
    again = (F.col("now.start") != F.col("was.start")) | (F.col("now.uptime") < F.col("was.uptime") - 1)
    return rows.withColumn("again", F.coalesce(again, F.lit(False))).groupBy("instance").agg(F.count_if("again").alias("restarts"))


def container_restarts(samples: DataFrame) -> DataFrame:
    """How often (container_id, started_at) changed between samples that have both."""
    return _container_restarts(samples.select("timestamp_ms", F.struct("s.docker.container_id", "s.docker.started_at").alias("c")))


def _container_restarts(rows: DataFrame) -> DataFrame:
    rows = previous(rows.withColumn("one", F.lit(0)).where("c.container_id is not null and c.started_at is not null"), ["one"], ["timestamp_ms"], by_time(), F.col("c"), "was")
    return rows.withColumn("again", F.coalesce(F.col("c") != F.col("was"), F.lit(False))).agg(F.count_if("again").alias("restarts"))


def instance_evidence_errors(samples: DataFrame) -> DataFrame:
    """(timestamp_ms, instance, errors): see `evidence_rules`; a sample without the instance has one error."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("instance"), jsontree.field(F.col("v"), n).alias("v")) for n in INSTANCES)))
    return samples.select("timestamp_ms", each.alias("x")).select("timestamp_ms", "x.instance", rules.instance_errors(F.col("x.v")).alias("errors"))


def container_evidence_errors(samples: DataFrame) -> DataFrame:
    """(timestamp_ms, errors) of the container's state."""
    return samples.select("timestamp_ms", rules.container_errors(jsontree.field(F.col("v"), "docker")).alias("errors"))


def _malformed_gap(v: Column) -> Column:
    return ~rules.is_number(jsontree.field(v, "monitor_gap_seconds"))


def evidence_issues(samples: DataFrame, most: int = rules.MOST_ERRORS) -> DataFrame:
    """Distinct issues with their place as prefix: issue, samples, first_ms; the `most` that came first, in that order.

    Within a sample the primary instance comes first, the container last. A malformed gap is told besides the `most`.
    """
    each = instance_evidence_errors(samples).select("timestamp_ms", F.col("instance").alias("part"), "errors")
    each = each.unionByName(container_evidence_errors(samples).select("timestamp_ms", F.lit("docker").alias("part"), "errors"))
    order = F.struct("timestamp_ms", F.array_position(F.array(F.lit("primary"), F.lit("shadow"), F.lit("docker")), F.col("part")).alias("part"), "at")
    told = each.select("timestamp_ms", "part", F.posexplode("errors").alias("at", "error")).select(F.concat_ws(": ", "part", "error").alias("issue"), "timestamp_ms", order.alias("place"))
    found = told.groupBy("issue").agg(F.countDistinct("timestamp_ms").alias("samples"), F.min("place").alias("place"))
    gap = samples.where(_malformed_gap(F.col("v"))).agg(F.count("*").alias("samples"), F.min("timestamp_ms").alias("first_ms")).where("samples > 0")
    first = found.orderBy("place").limit(most).select("issue", "samples", F.col("place.timestamp_ms").alias("first_ms"))
    return first.unionByName(gap.select(F.lit(MALFORMED_GAP).alias("issue"), "samples", "first_ms"))


def flatten_status(samples: DataFrame, stale_seconds: float, freshness_seconds: float) -> DataFrame:
    """Bounded view: per instance, feed and symbol, healthy again from its parts (connected, acknowledged, fresh)."""
    f = instances(samples).select("timestamp_ms", "instance", F.explode("i.feeds").alias("feed", "f"))
    fresh = lambda c, most: F.coalesce(c.between(0, most), F.lit(False))
    ok = F.coalesce(F.col("f.connected") & F.col("f.subscription_acknowledged"), F.lit(False)) & fresh(F.col("f.message_age_seconds"), stale_seconds)
    s = f.select("timestamp_ms", "instance", "feed", ok.alias("feed_healthy"), F.explode("f.symbols").alias("symbol", "y"))
    return s.select("timestamp_ms", "instance", "feed", "symbol", "feed_healthy", (F.coalesce(F.col("y.messages") > 0, F.lit(False)) & fresh(F.col("y.message_age_seconds"), freshness_seconds)).alias("symbol_healthy"), "y.messages")


def detector_readiness(samples: DataFrame) -> DataFrame:
    """One row: how many samples of an instance had an unready market, how many a quiet one, which pairs
    (instance:symbol:ready/configured), and the least share of ready venues.

    An instance without markets is unready; no sample at all gives the share 1.
    """
    return _detector_readiness(instances(samples).select(rules.market_states(F.col("v"), F.col("instance")).alias("m")))


def _detector_readiness(m: DataFrame) -> DataFrame:
    has = lambda name: F.exists("m", lambda x: x["state"] == name)
    per = m.agg(F.count_if(has("unready")).alias("unready_samples"), F.count_if(has("quiet")).alias("quiet_samples"), F.coalesce(F.min(F.array_min(F.transform("m", lambda x: x["ratio"]))), F.lit(1.0)).alias("min_ready_ratio"))
    each = m.select(F.explode("m").alias("m")).select("m.*").distinct()
    pairs = each.agg(*(F.array_sort(F.collect_set(F.when(F.col("state") == n, F.col("pair")))).alias(f"{n}_pairs") for n in ("unready", "quiet")))
    return per.crossJoin(pairs)  # single rows


def max_rollups(samples: DataFrame) -> DataFrame:
    """One row of maxima over feeds, symbols, tasks, queues, clocks, alarms and checkpoints; invalid values count as 0."""
    return instances(samples).where("i is not null").agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(f"max_{n}") for n, c in _maxima(F.col("i")).items()))


def _maxima(i: Column) -> dict[str, Column]:
    """The values of an instance by name, 0 where there is none."""
    most = lambda m, field: F.coalesce(F.array_max(F.transform(F.map_values(m), lambda v: F.when(finite(v[field].cast("double")) & (v[field] >= 0), v[field].cast("double")))), F.lit(0.0))
    one = lambda c: F.when(finite(c.cast("double")) & (c >= 0), c.cast("double")).otherwise(0.0)
    return {
        "feed_age": most(i["feeds"], "message_age_seconds"), "feed_drops": most(i["feeds"], "dropped_events"), "feed_reconnects": most(i["feeds"], "reconnects"),
        "symbol_age": F.coalesce(F.array_max(F.transform(F.map_values(i["feeds"]), lambda f: most(f["symbols"], "message_age_seconds"))), F.lit(0.0)),
        "task_heartbeat_age": most(i["tasks"], "heartbeat_age_seconds"), "queue_size": one(i["queue_size"]), "queue_high_water": one(i["queue_health"]["high_water"]), "queue_drops": one(i["queue_health"]["drops_total"]),
        "queue_lag": one(i["queue_health"]["consumer_lag_seconds"]), "queue_utilization": one(i["queue_health"]["utilization"]), "future_events": one(i["clock_health"]["future_events_quarantined"]), "clock_adjustments": one(i["clock_health"]["clock_adjustments"]),
        "alarm_depth": one(i["alarm_delivery"]["local_queue_depth"]), "alarm_failures": one(F.element_at(i["alarm_delivery"]["counts"], "failure")), "checkpoint_age": one(i["checkpoint_health"]["last_success_age_seconds"]), "checkpoint_failures": one(i["checkpoint_health"]["failures"]),
    }


def summarize(rows: DataFrame, g: Gate = Gate(), counts: DataFrame | None = None) -> DataFrame:
    """One row with everything the gate looks at; `counts` is the row of read_evidence that tells the invalid lines.

    Samples are parsed once, to narrow rows that are kept on disk until the row is made, which is done here at once. Each
    part is an aggregate of its own, so the joins are of single rows.
    """
    kept, duplicates = dedup_samples(rows)
    s = _narrow(parsed(kept)).persist(StorageLevel.DISK_ONLY)
    of = lambda name, value: F.coalesce(F.sum(F.when(F.col("instance") == name, value)), F.lit(0)).alias
    each = s.select("timestamp_ms", F.explode("each").alias("x")).select("timestamp_ms", "x.*")
    failures = _failure_counts(each.select("instance", "timestamp_ms", "bad")).agg(*(of(n, F.col("failures"))(f"{n}_failures") for n in INSTANCES), F.max("longest_run").alias("longest_failure_run"))
    restarts = _runtime_restarts(each.select("instance", "timestamp_ms", "now")).agg(*(of(n, F.col("restarts"))(f"{n}_restarts") for n in INSTANCES))
    samples = s.agg(
        *(F.count_if(f"told.{n}").alias(f"{n}_evidence_failures") for n in INSTANCES), F.count_if("told.docker").alias("container_evidence_failures"), F.count_if("told.malformed_gap").alias("malformed_gaps"),
        F.coalesce(F.max(F.when(F.col("restart_count") >= 0, F.col("restart_count"))), F.lit(0)).alias("container_restart_count"),
    )
    issues = s.select("timestamp_ms", F.explode("told.issues").alias("x")).groupBy("x.issue").agg(F.min(F.struct("timestamp_ms", "x.part", "x.at")).alias("place"))
    issues = issues.orderBy("place").limit(rules.MOST_ERRORS).agg(F.collect_list("issue").alias("issues"))
    gap = F.when(F.col("malformed_gaps") > 0, F.array(F.lit(MALFORMED_GAP))).otherwise(F.array().cast("array<string>"))
    parts = [
        coverage(s, g.interval_seconds), duplicates, failures, samples, _monitor_gaps(s.select("timestamp_ms", "told_gap").withColumnRenamed("told_gap", "told"), g.interval_seconds), restarts,
        _container_restarts(s.select("timestamp_ms", "c")).withColumnRenamed("restarts", "container_identity_restarts"),
        s.agg(F.coalesce(F.sum("unhealthy"), F.lit(0)).alias("checkpoint_unhealthy_samples")), _detector_readiness(s.select(F.explode("markets").alias("m"))),
        s.agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in s.columns if c.startswith("max_"))), issues,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # single rows
    out = out.withColumn("evidence_issues", F.array_sort(F.concat("issues", gap))).drop("issues")
    out = out.withColumn("invalid_rows", F.lit(0).cast("long")) if counts is None else out.crossJoin(counts.select(F.col("invalid").alias("invalid_rows")))
    try:
        return rows.sparkSession.createDataFrame([out.first()], out.schema)
    finally:
        s.unpersist()


def _narrow(samples: DataFrame) -> DataFrame:
    """What the summary looks at of each sample."""
    checkpoint = lambda n: F.col(f"s.{n}.checkpoint_health")
    unhealthy = lambda n: F.coalesce(checkpoint(n)["enabled"], F.lit(False)) & ~F.coalesce(checkpoint(n)["healthy"], F.lit(False))
    primary, shadow = (_maxima(F.col(f"s.{n}")) for n in INSTANCES)
    return samples.select(
        "timestamp_ms", F.array(*(F.struct(F.lit(n).alias("instance"), _bad(F.col(f"s.{n}")).alias("bad"), _started(F.col(f"s.{n}")).alias("now")) for n in INSTANCES)).alias("each"),
        F.coalesce(F.col("s.monitor_gap_seconds"), F.lit(0.0)).alias("told_gap"), F.struct("s.docker.container_id", "s.docker.started_at").alias("c"), F.col("s.docker.restart_count").alias("restart_count"),
        sum(F.when(unhealthy(n), 1).otherwise(0) for n in INSTANCES).cast("long").alias("unhealthy"), rules.told(F.col("timestamp_ms"), F.col("v")).alias("told"),
        F.array(*(rules.market_states(jsontree.field(F.col("v"), n), F.lit(n)) for n in INSTANCES)).alias("markets"), *(F.greatest(primary[n], shadow[n]).alias(f"max_{n}") for n in primary),
    )


def gate(summary: DataFrame, g: Gate = Gate()) -> DataFrame:
    """The verdict: ordered reasons with their counts, pass iff there are none; without samples it fails for that alone."""
    c = F.col

    def told(text: str, *names: str, bad: Column | None = None) -> Column:
        some = bad if bad is not None else reduce(lambda a, b: a | b, (c(n) > 0 for n in names))
        return F.when(F.coalesce(some, F.lit(False)), F.format_string(text, *(c(n).cast("long") for n in names)))

    hours = F.format_string("duration %.2fh is below %.2fh", c("duration_seconds") / 3600, F.lit(float(g.hours)))
    share = F.format_string("sample coverage %.1f%% is below %.1f%%", c("coverage") * 100, F.lit(g.min_coverage * 100))
    reasons = [
        F.when(c("duration_seconds") < g.hours * 3600, hours),
        F.when(c("coverage") < g.min_coverage, share),
        told("%d duplicate timestamp sample(s)", "duplicates"),
        told("%d primary failure sample(s)", "primary_failures"),
        told("%d shadow failure sample(s)", "shadow_failures"),
        told("%d incomplete primary evidence sample(s)", "primary_evidence_failures"),
        told("%d incomplete shadow evidence sample(s)", "shadow_evidence_failures"),
        told("%d absent, unobserved, or unhealthy Docker sample(s)", "container_evidence_failures"),
        told("%d malformed monitor-gap sample(s)", "malformed_gaps"),
        told("%d monitoring gap(s)", "gaps"),
        told("drop counter reached %d feed / %d market queue", "max_feed_drops", "max_queue_drops"),
        told("future-event quarantine counter reached %d", "max_future_events"),
        told("clock adjustment counter reached %d", "max_clock_adjustments"),
        told("local alarm failure counter reached %d", "max_alarm_failures"),
        told("%d unhealthy checkpoint sample(s)", "checkpoint_unhealthy_samples"),
        told("%d detector-unready instance sample(s)", "unready_samples"),
        told("runtime restarts observed: primary %d, shadow %d, container counter %d, container identity %d", "primary_restarts", "shadow_restarts", "container_restart_count", "container_identity_restarts"),
        told("%d invalid JSONL row(s)", "invalid_rows"),
    ]
    why = F.when(c("samples") == 0, F.array(F.lit("no valid soak samples"))).otherwise(F.array_compact(F.array(*reasons)))
    out = summary.withColumn("reasons", why).withColumn("passed", F.size("reasons") == 0)
    return out.withColumns({"coverage": F.round("coverage", 6), "duration_seconds": F.round("duration_seconds", 3), "largest_gap_seconds": F.round("largest_gap_seconds", 3), "min_ready_ratio": F.round("min_ready_ratio", 6)})
