"""Normalisation of venue frames into trades and liquidations, and validity at the entrance.

Every parser is a projection over `from_json` plus a join with the small symbol map; numbers in frames are text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions import jsontree
from tapewatch.functions.stats import finite

STAMPS = ["received_wall_ms", "received_monotonic_s", "continuity_generation", "arrival_seq"]
#: A symbol map above this many rows is joined by shuffle.
MAP_ROWS = 100_000


def canonicalize(df: DataFrame, symbol_map: DataFrame, exchange: str, venue_col: str = "venue_symbol") -> DataFrame:
    """Venue symbols become canonical ones; rows without an entry for this venue are dropped."""
    own = symbol_map.where(F.col("exchange") == exchange).select(F.upper("venue_symbol").alias("__venue"), F.col("canonical").alias("symbol"))
    side = F.broadcast(own) if own.limit(MAP_ROWS + 1).count() <= MAP_ROWS else own
    return df.join(side, F.upper(F.col(venue_col)) == F.col("__venue")).drop("__venue", venue_col).withColumn("exchange", F.lit(exchange))


def _num(path: str) -> Column:
    return F.col(path).try_cast("double")


def _present(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in cols))


def _finish(df: DataFrame, side: str) -> DataFrame:
    return df.select("exchange", "symbol", F.col("timestamp_ms").cast("long").alias("timestamp_ms"), "price", "quantity", side, "event_id", *STAMPS)


def _object(text: Column) -> Column:
    """A JSON object as a map of raw values; keys keep their case, which structs would not."""
    return F.from_json(text, "map<string,string>")


def _payload(frames: DataFrame) -> DataFrame:
    """Stamps and the payload `p`, which may be wrapped in `data`."""
    outer = frames.select(*STAMPS, "frame", _object(F.col("frame")).alias("o"))
    return outer.select(*STAMPS, "frame", F.when(F.col("o")["data"].isNotNull(), _object(F.col("o")["data"])).otherwise(F.col("o")).alias("p"))


def normalize_agg_trades(frames: DataFrame, symbol_map: DataFrame, exchange: str = "binance") -> DataFrame:
    """Aggregate trades; the payload may be wrapped in `data`. The buyer being the maker means a sell; a flag that is no boolean drops the row."""
    v = F.try_parse_json("frame")
    flag = F.coalesce(F.try_variant_get(v, "$.data.m", "variant"), F.try_variant_get(v, "$.m", "variant"))
    x = F.col("p")
    p = _payload(frames).where((x["e"] == "aggTrade") & (F.schema_of_variant(flag) == "BOOLEAN"))
    symbol = F.upper(_present(x["s"], _object(x["o"])["s"]))
    rows = p.select(*STAMPS, symbol.alias("venue_symbol"), _present(x["T"], x["E"]).try_cast("long").alias("timestamp_ms"), x["p"].try_cast("double").alias("price"), x["q"].try_cast("double").alias("quantity"), F.when(x["m"] == "true", "sell").otherwise("buy").alias("taker_side"), x["a"].alias("a"))
    named = canonicalize(rows, symbol_map, exchange)
    return _finish(named.withColumn("event_id", F.concat_ws(":", F.lit(exchange), F.lit("trade"), "symbol", F.coalesce("a", F.col("timestamp_ms").cast("string")))), "taker_side")


def normalize_force_orders(frames: DataFrame, symbol_map: DataFrame, exchange: str = "binance") -> DataFrame:
    """Forced orders: average price if positive else price; last fill, else filled, else original quantity, the first positive one.

    A sold order means longs were liquidated, anything else shorts. The id uses the first fields that are present.
    """
    x = F.col("p")
    p = _payload(frames).where(x["e"] == "forceOrder").select(*STAMPS, x["E"].alias("event_ms"), _object(x["o"]).alias("o"))
    o = F.col("o")
    plus = lambda *names: F.coalesce(*(F.when(o[n].try_cast("double") > 0, o[n].try_cast("double")) for n in names))
    first = lambda *names: _present(*(o[n] for n in names))
    rows = p.select(
        *STAMPS, F.upper(o["s"]).alias("venue_symbol"), _present(o["T"], F.col("event_ms")).try_cast("long").alias("timestamp_ms"), plus("ap", "p").alias("price"), plus("l", "z", "q").alias("quantity"),
        F.when(F.upper(o["S"]) == "SELL", "long").otherwise("short").alias("liquidated_side"), F.upper(o["S"]).alias("order_side"), first("l", "z", "q").alias("qid"), first("ap", "p").alias("pid"),
    ).where("price > 0 and quantity > 0")
    named = canonicalize(rows, symbol_map, exchange)
    return _finish(named.withColumn("event_id", F.concat_ws(":", F.lit(exchange), F.lit("liquidation"), "symbol", F.col("timestamp_ms").cast("string"), "order_side", "qid", "pid")), "liquidated_side")


def _topic(frames: DataFrame, prefix: str) -> DataFrame:
    """Elements d of the data lists of topics with this prefix, and their place k."""
    j = frames.select(*STAMPS, F.from_json("frame", "struct<topic:string,data:array<map<string,string>>>").alias("j")).where(F.col("j.topic").startswith(prefix))
    return j.select(*STAMPS, F.posexplode("j.data").alias("k", "d")).where(F.lower(F.col("d")["S"]).isin("buy", "sell"))


def normalize_public_trades(frames: DataFrame, symbol_map: DataFrame, exchange: str = "bybit") -> DataFrame:
    """Trade lists under topics publicTrade.*: one row per element; a side that is neither buy nor sell drops it."""
    d = F.col("d")
    tail = _present(d["i"], d["seq"], F.concat_ws(":", d["T"], d["p"], d["v"]))
    rows = _topic(frames, "publicTrade.").select(*STAMPS, F.upper(d["s"]).alias("venue_symbol"), d["T"].try_cast("long").alias("timestamp_ms"), d["p"].try_cast("double").alias("price"), d["v"].try_cast("double").alias("quantity"), F.lower(d["S"]).alias("taker_side"), tail.alias("tail"))
    named = canonicalize(rows, symbol_map, exchange)
    return _finish(named.withColumn("event_id", F.concat_ws(":", F.lit(exchange), F.lit("trade"), "symbol", "tail")), "taker_side")


def normalize_liquidations(frames: DataFrame, symbol_map: DataFrame, exchange: str = "bybit") -> DataFrame:
    """Liquidation lists under topics allLiquidation.*; the side is that of the position: Buy means longs were liquidated."""
    d = F.col("d")
    tail = F.concat_ws(":", d["T"], d["S"], d["p"], d["v"], F.col("k").cast("string"))
    rows = _topic(frames, "allLiquidation.").select(*STAMPS, F.upper(d["s"]).alias("venue_symbol"), d["T"].try_cast("long").alias("timestamp_ms"), d["p"].try_cast("double").alias("price"), d["v"].try_cast("double").alias("quantity"), F.when(F.lower(d["S"]) == "buy", "long").otherwise("short").alias("liquidated_side"), tail.alias("tail"))
    named = canonicalize(rows, symbol_map, exchange)
    return _finish(named.withColumn("event_id", F.concat_ws(":", F.lit(exchange), F.lit("liquidation"), "symbol", "tail")), "liquidated_side")


def contract_values(meta: DataFrame) -> DataFrame:
    """Value of one contract by instrument: (ctVal or 1) * (ctMult or 1); missing or not positive means 1."""
    value = F.coalesce(F.col("ctVal").try_cast("double"), F.lit(1.0)) * F.coalesce(F.col("ctMult").try_cast("double"), F.lit(1.0))
    return meta.select(F.upper("instId").alias("inst"), F.when(value > 0, value).otherwise(1.0).alias("contract_value"))


def normalize_swap_trades(frames: DataFrame, symbol_map: DataFrame, values: DataFrame, exchange: str = "okx") -> DataFrame:
    """Swap trades on channel `trades`: quantity is size times contract value; unknown instruments count 1."""
    item = "array<struct<ts:string,px:string,sz:string,side:string,tradeId:string>>"
    j = frames.select(*STAMPS, F.from_json("frame", f"struct<arg:struct<channel:string,instId:string>,data:{item}>").alias("j")).where("j.arg.channel = 'trades'")
    d = j.select(*STAMPS, F.upper("j.arg.instId").alias("venue_symbol"), F.explode("j.data").alias("d")).where(F.lower("d.side").isin("buy", "sell"))
    sized = d.join(values, F.col("venue_symbol") == F.col("inst"), "left").withColumn("size", _num("d.sz") * F.coalesce("contract_value", F.lit(1.0)))
    rows = sized.select(*STAMPS, "venue_symbol", F.col("d.ts").try_cast("long").alias("timestamp_ms"), _num("d.px").alias("price"), F.col("size").alias("quantity"), F.lower("d.side").alias("taker_side"), _present(F.col("d.tradeId"), F.concat_ws(":", "d.ts", "d.px", "d.sz")).alias("tail"))
    named = canonicalize(rows, symbol_map, exchange)
    return _finish(named.withColumn("event_id", F.concat_ws(":", F.lit(exchange), F.lit("trade"), "symbol", "tail")), "taker_side")


def valid_events(df: DataFrame, side_col: str = "taker_side", sides: tuple[str, ...] = ("buy", "sell"), symbols: list[str] | None = None, exchange: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): positive time, finite positive price and quantity, an allowed side, a known symbol and the feed's exchange."""
    ok = (F.col("timestamp_ms") > 0) & F.col(side_col).isin(*sides)
    for c in ("price", "quantity"):
        ok = ok & finite(F.col(c)) & (F.col(c) > 0)
    ok = ok & (F.col("symbol").isin(symbols) if symbols is not None else F.col("symbol").isNotNull())
    if exchange is not None:
        ok = ok & (F.col("exchange") == exchange)
    ok = F.coalesce(ok, F.lit(False))
    return df.where(ok), df.where(~ok)


def quarantine_future(df: DataFrame, max_skew_seconds: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): events later than their receipt plus the skew are set aside; smaller leads are clamped to the receipt.

    Kept rows carry `clock_normalized`, true where the time was clamped.
    """
    lead = F.col("timestamp_ms") - F.col("received_wall_ms")
    far = F.coalesce(lead > max_skew_seconds * 1000, F.lit(False))
    kept = df.where(~far).withColumn("clock_normalized", F.coalesce(lead > 0, F.lit(False))).withColumn("timestamp_ms", F.least("timestamp_ms", F.coalesce("received_wall_ms", "timestamp_ms")))
    return kept, df.where(far)


def clock_counters(kept: DataFrame, quarantined: DataFrame, event_type: str = "trade") -> DataFrame:
    """One row: quarantined and normalised totals, counts by exchange:symbol:type (sorted), last quarantine time."""
    name = F.concat_ws(":", "exchange", "symbol", F.lit(event_type))
    by = quarantined.groupBy(name.alias("k")).agg(F.count("*").alias("n"), F.max("received_wall_ms").alias("at"))
    q = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("quarantined_total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("by_feed"), F.max("at").alias("last_quarantine_ms"))
    n = kept.agg(F.coalesce(F.count_if("clock_normalized"), F.lit(0)).alias("normalized_total"))
    return q.crossJoin(n)  # one row each


def normalize_external_alerts(payloads: DataFrame) -> DataFrame:
    """Alerts posted by others (columns payload, now_ms): defaults, cases, lengths, allowed values, time within [now - 300 s, now].

    The source stands for the exchange. The key is the caller's or source:symbol:category:direction, always below
    `external:`. Missing and null fields take defaults. Metrics are there as flat text and, with all their nesting, as a
    bounded JSON text (jsontree.bounded); where the time was moved, both tell so.
    """
    fields = (
        "struct<severity:string,source:string,category:string,symbol:string,title:string,message:string,direction:string,"
        "dedup_key:string,timestamp_ms:string,metrics:map<string,string>>"
    )
    j = payloads.select("now_ms", F.from_json("payload", fields).alias("j"), "payload")
    told = j.select(
        "now_ms", F.lower(F.coalesce("j.severity", F.lit("warning"))).alias("sev"), F.substring(F.coalesce("j.source", F.lit("external")), 1, 80).alias("source"),
        F.substring(F.upper(F.coalesce("j.symbol", F.lit("MARKET"))), 1, 40).alias("symbol"), F.lower(F.coalesce("j.direction", F.lit("mixed"))).alias("side"),
        F.substring(F.coalesce("j.category", F.lit("external")), 1, 80).alias("category"), "j.title", F.substring(F.coalesce("j.message", F.lit("External alert received.")), 1, 4000).alias("message"),
        F.coalesce(F.nullif(F.col("j.timestamp_ms").try_cast("long"), F.lit(0)), F.col("now_ms")).alias("told_ms"), _present(F.col("j.dedup_key")).alias("key"),
        F.coalesce("j.metrics", F.create_map().cast("map<string,string>")).alias("metrics"), "payload",
    )
    at = F.greatest(F.col("now_ms") - 300_000, F.least("told_ms", "now_ms"))
    moved = at != F.col("told_ms")
    mark = F.create_map(F.lit("_timestamp_normalized"), F.lit("true"))
    rest = F.map_filter("metrics", lambda k, _: k != "_timestamp_normalized")
    out = told.select(
        F.when(F.col("sev").isin("info", "warning", "critical"), F.col("sev")).otherwise("warning").alias("severity"), "category", "symbol",
        F.substring(F.coalesce("title", F.concat(F.lit("External alert: "), "symbol")), 1, 200).alias("title"), "message",
        F.when(F.col("side").isin("up", "down", "mixed"), F.col("side")).otherwise("mixed").alias("direction"), at.alias("timestamp_ms"), moved.alias("timestamp_normalized"),
        F.array("source").alias("exchanges"), F.when(moved, F.map_concat(rest, mark)).otherwise(F.col("metrics")).alias("metrics"), "source", "key",
        jsontree.bounded_map(F.col("payload"), "metrics", "_timestamp_normalized", moved).alias("metrics_json"),
    )
    key = F.coalesce("key", F.concat_ws(":", "source", "symbol", "category", "direction"))
    return out.withColumn("dedup_key", F.substring(F.concat(F.lit("external:"), key), 1, 300)).drop("key")


def sanitize_json(col: Column) -> Column:
    """JSON text of any shape made safe to keep: bounded keys, lists and depth, no number that is not finite."""
    return jsontree.bounded(col)


def sanitize_numbers(col: Column) -> Column:
    """A map of numbers with non-finite values set to null."""
    return F.transform_values(col, lambda _, v: F.when(finite(v), v))
