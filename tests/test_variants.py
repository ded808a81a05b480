import json

import pyarrow as pa
from pyspark.sql import functions as F

from tapewatch.functions import jsontree, variants
from tapewatch.operators import evidence as G

NUMBERS = ["0", "-0", "1", "-129", "32768", "-2147483649", "9223372036854775807", "9223372036854775808", "-123456789012345678901234567890", "1" * 38, "1" * 45,
           "1.0", "100.0", "-0.0", "0.1", "1e3", "1.5e-7", "1e400", "NaN", "-Infinity", "12345678901234567890.0", "-1234567890123456789.00", "123456789012345678.0", "0.12345678901234567890123"]
OTHERS = [None, True, False, "", "é" * 40, "😀", [], {}, [[None]], list(range(300)), {"b": 1, "a": {"": [True]}, "é": 2, "￿": 3, "\U0001f600": 4}, {f"k{i}": "x" * i for i in range(400)}]


def test_values_are_read_as_columns_read_them(spark):
    def shown(x):
        """Whether it counts as int, and the value; repr() keeps not-a-number and the order of keys."""
        return f"{type(x).__name__} {x!r}"

    read = F.arrow_udf(lambda v: pa.array([shown(x) for x in variants.values(v)], pa.string()), "string")
    rows = list(enumerate([*NUMBERS, *map(json.dumps, OTHERS), "{", None, '{"a": 1, "a": 2}']))
    v = spark.createDataFrame(rows, "i int, t string").select("i", jsontree.parsed(F.col("t")).alias("v"))
    got = v.select("i", read("v").alias("x"), jsontree.kind(F.col("v")).alias("kind"), jsontree.number(F.col("v")).alias("n")).orderBy("i").collect()
    for (_, text), r in zip(rows[: len(NUMBERS)], got, strict=False):
        name, value = r.x.split()
        assert name == r.kind, text
        assert value == repr(r.n) or float(value) == r.n, text
        assert name == "float" or int(value) == int(text.split(".")[0]), text
    keys = lambda x: sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass")) if isinstance(x, dict) else x
    ordered = lambda x: {k: ordered(x[k]) for k in keys(x)} if isinstance(x, dict) else [ordered(y) for y in x] if isinstance(x, list) else x
    assert [r.x for r in got[len(NUMBERS) :]] == [shown(ordered(json.loads(json.dumps(x)))) for x in OTHERS] + [shown(None)] * 3


def test_rules_read_a_value_once(spark):
    """Not by a pass over it for each of some hundred tests, nor by a typed reading that no rule needs."""
    samples = G.parsed(spark.createDataFrame([(1, "{}")], "timestamp_ms long, body string"))
    plan = G.instance_evidence_errors(samples)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "heartbeat_age_seconds" not in plan and len(plan) < 5000


def test_the_summary_parses_a_sample_once(spark, monkeypatch):
    read, seen = G.parsed, spark.sparkContext.accumulator(0)

    def same(body):
        seen.add(len(body))
        return body

    counted = F.arrow_udf(same, "string").asNondeterministic()
    monkeypatch.setattr(G, "parsed", lambda rows: read(rows.withColumn("body", counted("body"))))
    bodies = [{"primary": {"ok": i % 3 > 0, "queue_size": i - 1}, "docker": {"restart_count": i}} for i in range(20)]
    rows = spark.createDataFrame([(1000 * i, json.dumps(b)) for i, b in enumerate(bodies)], "timestamp_ms long, body string")
    got = G.summarize(rows).first()
    assert (got.samples, got.primary_failures, got.shadow_failures, got.longest_failure_run, got.container_restart_count, got.malformed_gaps) == (20, 7, 20, 20, 19, 20)
    kept = read(rows)
    assert got.evidence_issues == sorted(r.issue for r in G.evidence_issues(kept).collect()) and "primary: queue_size is missing or invalid" in got.evidence_issues
    assert seen.value == 20
