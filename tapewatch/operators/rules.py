"""Detection rules over window metrics, liquidations and venue prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.functions.stats import finite, severity_rank
from tapewatch.params import Rules, Threshold

TICK = ["timestamp_ms", "symbol"]


def passes(t: Threshold, min_quote_volume: float = 0.0) -> Column:
    """A metric row passes: ready, enough volume, return and its score large enough, and volume or aligned flow behind it."""
    flow = (F.abs("taker_imbalance") >= t.min_abs_imbalance) & (F.col("return_bps") * F.col("taker_imbalance") > 0)
    moved = (F.abs("return_bps") >= t.min_abs_return_bps) & (F.abs("return_z") >= t.min_abs_return_z)
    return F.coalesce(F.col("ready") & (F.col("quote_volume") >= min_quote_volume) & moved & ((F.col("volume_z") >= t.min_volume_z) | flow), F.lit(False))


def candidates(metrics: DataFrame, rules: Rules) -> DataFrame:
    """Fresh rows that pass, with level (critical, warning) and direction; a return of exactly zero counts as down.

    A row still warming up is an emergency warning if it moved 1.75 times the critical return on enough volume.
    """
    level = F.lit(None).cast("string")
    emergency = F.lit(False)
    for w in rules.windows:
        own = F.col("window_seconds") == w.seconds
        sudden = (F.col("readiness_reason") == "baseline_warmup") & (F.abs("return_bps") >= w.critical.min_abs_return_bps * rules.emergency_factor) & (F.col("quote_volume") >= rules.min_quote_volume)
        level = F.when(own & passes(w.critical, rules.min_quote_volume), "critical").when(own & passes(w.warning, rules.min_quote_volume), "warning").when(own & sudden, "warning").otherwise(level)
        emergency = F.when(own, sudden).otherwise(emergency)
    fresh = F.col("data_age_seconds").between(0, rules.freshness_seconds)
    found = metrics.where(fresh).withColumns({"level": level, "emergency": F.coalesce(emergency, F.lit(False)), "direction": F.when(F.col("return_bps") > 0, "up").otherwise("down")})
    return found.where("level is not null")


def confirm(found: DataFrame, rules: Rules) -> DataFrame:
    """Per tick, symbol and window the direction with more candidates (tie: up) and its severity by confirming venues.

    Critical needs enough venues and a critical candidate, or every return at the critical size; warning its own count.
    """
    key = [*TICK, "window_seconds"]
    big, need_c, need_w = F.lit(None).cast("double"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for w in rules.windows:
        own = F.col("window_seconds") == w.seconds
        big = F.when(own, F.lit(float(w.critical.min_abs_return_bps))).otherwise(big)
        need_c, need_w = F.when(own, w.critical.min_confirmations).otherwise(need_c), F.when(own, w.warning.min_confirmations).otherwise(need_w)
    sides = found.groupBy(*key, "direction").agg(
        F.count("*").alias("n"), F.countDistinct("exchange").alias("confirmations"), F.max(F.col("level") == "critical").alias("any_critical"),
        F.min(F.abs("return_bps")).alias("least_return"), F.median("return_bps").alias("median_return_bps"), F.max(F.abs("return_z")).alias("max_abs_return_z"),
        F.max("volume_z").alias("max_volume_z"), F.median("taker_imbalance").alias("median_imbalance"), F.array_sort(F.collect_set("exchange")).alias("exchanges"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("exchange", F.struct("return_bps", "return_z", "volume_z", "taker_imbalance"))))).alias("venues"),
    )
    order = Window.partitionBy(*key).orderBy(F.desc("n"), F.when(F.col("direction") == "up", 0).otherwise(1))
    best = sides.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")
    critical = (F.col("confirmations") >= need_c) & (F.col("any_critical") | (F.col("least_return") >= big))
    return best.withColumn("severity", F.when(critical, "critical").when(F.col("confirmations") >= need_w, "warning")).where("severity is not null")


def price_alerts(confirmed: DataFrame) -> DataFrame:
    """Price alerts with key, title, message and metrics."""
    title = F.format_string("%s %s %s", F.upper("symbol"), F.when(F.col("direction") == "up", "rising").otherwise("falling"), F.concat(F.col("window_seconds"), F.lit(" s")))
    message = F.format_string("median return %+.2f bps, strongest score %.2f, confirmed by %s", "median_return_bps", F.coalesce("max_abs_return_z", F.lit(0.0)), F.array_join("exchanges", ", "))
    return confirmed.select(*TICK, "window_seconds", "severity", F.lit("price").alias("category"), "direction", "exchanges", F.concat_ws(":", F.lit("market"), "symbol", "direction", "window_seconds").alias("dedup_key"), title.alias("title"), message.alias("message"), "median_return_bps", "max_abs_return_z", "max_volume_z", "median_imbalance", "confirmations", "venues")


def liquidation_alerts(windows: DataFrame, rules: Rules) -> DataFrame:
    """Alerts for liquidated value: warning from the warning sum, critical from the critical sum or enough venues."""
    loud = windows.where(F.col("total_usd") >= rules.liquidation_warning_usd)
    names = F.map_keys("exchanges")
    critical = (F.col("total_usd") >= rules.liquidation_critical_usd) | (F.size(names) >= rules.liquidation_min_exchanges)
    message = F.format_string("%s liquidated: %,.0f long, %,.0f short in %d events", F.format_number("total_usd", 0), "long_usd", "short_usd", F.col("events"))
    return loud.select(F.col("t_ms").alias("timestamp_ms"), "symbol", F.when(critical, "critical").otherwise("warning").alias("severity"), F.lit("liquidation").alias("category"), "direction", F.array_sort(names).alias("exchanges"), F.concat_ws(":", F.lit("liquidation"), "symbol", "direction").alias("dedup_key"), F.concat(F.upper("symbol"), F.lit(" liquidations")).alias("title"), message.alias("message"), "total_usd", "long_usd", "short_usd", "events")


def spread_alerts(metrics: DataFrame, rules: Rules) -> DataFrame:
    """Price divergence between fresh venues that are ready on the shortest window."""
    use = metrics.where((F.col("window_seconds") == rules.shortest) & F.col("ready") & F.col("data_age_seconds").between(0, rules.freshness_seconds) & F.col("price").isNotNull())
    per = use.groupBy(*TICK).agg(F.median("price").alias("median_price"), F.min("price").alias("low"), F.max("price").alias("high"), F.min_by("exchange", F.struct("price", "exchange")).alias("low_venue"), F.max_by("exchange", F.struct("price", "exchange")).alias("high_venue"), F.countDistinct("exchange").alias("venues"), F.array_sort(F.collect_set("exchange")).alias("exchanges"))
    per = per.where((F.col("venues") >= rules.spread_min_venues) & (F.col("median_price") > 0)).withColumn("spread_bps", (F.col("high") - F.col("low")) / F.col("median_price") * 10_000)
    loud = per.where(F.col("spread_bps") >= rules.spread_warning_bps)
    message = F.format_string("%.1f bps between %s and %s", "spread_bps", "low_venue", "high_venue")
    return loud.select(*TICK, F.when(F.col("spread_bps") >= rules.spread_critical_bps, "critical").otherwise("warning").alias("severity"), F.lit("spread").alias("category"), F.lit("mixed").alias("direction"), "exchanges", F.concat_ws(":", F.lit("spread"), "symbol").alias("dedup_key"), F.concat(F.upper("symbol"), F.lit(" venues diverge")).alias("title"), message.alias("message"), "spread_bps", "low_venue", "high_venue", "median_price")


def strongest_window(alerts: DataFrame) -> DataFrame:
    """One price alert per tick and symbol: most severe, then largest score, then shortest window."""
    order = Window.partitionBy(*TICK).orderBy(F.desc(severity_rank(F.col("severity"))), F.desc_nulls_last("max_abs_return_z"), "window_seconds")
    return alerts.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


COMMON = [*TICK, "severity", "category", "direction", "exchanges", "dedup_key", "title", "message", "metrics_json"]


def _number(name: str) -> Column:
    return F.when(finite(F.col(name)), F.col(name)).alias(name)


def _as_alert(df: DataFrame, numbers: list[str]) -> DataFrame:
    return df.withColumn("metrics_json", F.to_json(F.struct(*(_number(n) for n in numbers)))).select(*COMMON)


PRICE_NUMBERS = ["median_return_bps", "max_abs_return_z", "max_volume_z", "median_imbalance"]
LIQ_NUMBERS = ["total_usd", "long_usd", "short_usd"]


def merge_shock(price: DataFrame, liq: DataFrame) -> DataFrame:
    """Price and liquidation alerts of one tick and symbol that agree in direction become a market shock.

    A warning turns critical, venues are united, messages joined, liquidation metrics nested; the price key stays and
    the liquidation alert is used up. Other alerts pass unchanged.
    """
    l = liq.select(*TICK, *(F.col(c).alias(f"l_{c}") for c in ("direction", "exchanges", "message", *LIQ_NUMBERS)))
    both = price.join(l, TICK, "left").withColumn("__shock", F.coalesce((F.col("direction") == F.col("l_direction")) & (F.col("direction") != "mixed"), F.lit(False)))
    own = F.struct(*(_number(n) for n in PRICE_NUMBERS))
    nested = F.struct(*(_number(n) for n in PRICE_NUMBERS), F.struct(*(F.when(finite(F.col(f"l_{n}")), F.col(f"l_{n}")).alias(n) for n in LIQ_NUMBERS)).alias("liquidation"))
    shocked = both.select(
        *TICK, F.when(F.col("__shock") & (F.col("severity") == "warning"), "critical").otherwise(F.col("severity")).alias("severity"),
        F.when(F.col("__shock"), "market_shock").otherwise(F.col("category")).alias("category"), "direction",
        F.when(F.col("__shock"), F.array_sort(F.array_union("exchanges", "l_exchanges"))).otherwise(F.col("exchanges")).alias("exchanges"), "dedup_key", "title",
        F.when(F.col("__shock"), F.concat_ws("; ", "message", "l_message")).otherwise(F.col("message")).alias("message"),
        F.when(F.col("__shock"), F.to_json(nested)).otherwise(F.to_json(own)).alias("metrics_json"),
    )
    used = price.select(*TICK, F.col("direction").alias("p_direction"))
    left = liq.join(used, (liq["timestamp_ms"] == used["timestamp_ms"]) & (liq["symbol"] == used["symbol"]) & (liq["direction"] == used["p_direction"]) & (liq["direction"] != "mixed"), "left_anti")
    return shocked.unionByName(_as_alert(left, LIQ_NUMBERS))


def evaluate(metrics: DataFrame, liq_windows: DataFrame, rules: Rules) -> DataFrame:
    """All alerts of all ticks: price or shock, liquidation, spread, with an id that a rerun gives again."""
    price = strongest_window(price_alerts(confirm(candidates(metrics, rules), rules)))
    merged = merge_shock(price, liquidation_alerts(liq_windows, rules))
    out = merged.unionByName(_as_alert(spread_alerts(metrics, rules), ["spread_bps", "median_price"]))
    place = F.when(F.col("category").isin("price", "market_shock"), 0).when(F.col("category") == "liquidation", 1).otherwise(2)
    return out.select(F.sha2(F.concat_ws("|", "dedup_key", "timestamp_ms"), 256).alias("id"), *COMMON, F.lit("detector").alias("source"), place.alias("position"))
