"""Continuity: known data gaps as intervals per series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.series import by_time, previous, scanned

SERIES = ["exchange", "symbol"]
FOREVER = (1 << 63) - 1
#: Log kinds that open a break on every symbol of a feed.
LOSS_KINDS = ["process_start", "feed_disconnect", "queue_drop", "runtime_pause"]


def _reasons(col: Column) -> Column:
    """Comma-joined sorted set of the parts of collected reasons."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(col, lambda r: F.split(r, ","))), lambda x: x != ""))), ",")


def pair_breaks(log: DataFrame) -> DataFrame:
    """Breaks from start and end events: starts up to an end are one break, from the earliest of them (at least 1) to
    that end, not before start + 1; an end without a start is ignored; a break without an end stays open."""
    start, end = F.col("phase") == "start", F.col("phase") == "end"
    order = ["timestamp_ms", F.when(start, 0).otherwise(1)]
    rows = scanned(log.where(start | end), SERIES, order, by_time(), F.when(end, 1).otherwise(0), "__ended", own=False)
    rows = rows.withColumn("__episode", F.coalesce("__ended", F.lit(0)))
    paired = rows.groupBy(*SERIES, "__episode").agg(
        F.min(F.when(start, F.greatest("timestamp_ms", F.lit(1)))).alias("start_ms"),
        F.min(F.when(end, F.col("timestamp_ms"))).alias("__end"),
        _reasons(F.collect_set(F.when(start, F.substring("reason", 1, 120)))).alias("reason"),
    )
    found = paired.where(F.col("start_ms").isNotNull())
    return found.select(*SERIES, "start_ms", F.when(F.col("__end").isNotNull(), F.greatest("__end", F.col("start_ms") + 1)).alias("end_ms"), "reason")


def merge_breaks(breaks: DataFrame) -> DataFrame:
    """Unions breaks that overlap or touch; an open one takes in everything after it. Reasons are joined as a sorted set."""
    until, day = F.coalesce("end_ms", F.lit(FOREVER)), by_time("start_ms")
    reached = scanned(breaks, SERIES, ["start_ms", until], day, until, "__reach", how="max", own=False)
    marked = reached.withColumn("__new", F.when(F.col("__reach").isNull() | (F.col("start_ms") > F.col("__reach")), 1).otherwise(0))
    # equal breaks: the one that opens an island comes first
    marked = scanned(marked, SERIES, ["start_ms", until, F.desc("__new")], day, F.col("__new"), "__island")
    merged = marked.groupBy(*SERIES, "__island").agg(F.min("start_ms").alias("start_ms"), F.max(F.coalesce("end_ms", F.lit(FOREVER))).alias("__end"), _reasons(F.collect_set("reason")).alias("reason"))
    return merged.select(*SERIES, "start_ms", F.when(F.col("__end") < FOREVER, F.col("__end")).alias("end_ms"), "reason")


def _touches(start: str, end: str) -> Column:
    return (F.col("b.start_ms") <= F.col(f"a.{end}")) & (F.col("b.end_ms").isNull() | (F.col("b.end_ms") >= F.col(f"a.{start}")))


def _binned(breaks: DataFrame, width_ms: int, end: DataFrame) -> DataFrame:
    """A row for each bin of time that a break covers, up to the newest time of the rows it is to meet (end: one row, `top`)."""
    until = F.greatest("start_ms", F.least(F.coalesce("end_ms", F.lit(FOREVER)), F.col("top")))
    bins = F.sequence(F.floor(F.col("start_ms") / width_ms), F.floor(until / width_ms))
    return breaks.crossJoin(F.broadcast(end)).where("start_ms <= top").withColumn("bin", F.explode(bins)).drop("top")


def overlaps_break(df: DataFrame, breaks: DataFrame, start: str = "start_ms", end: str = "end_ms", keep: bool = True, width_ms: int = 3_600_000) -> DataFrame:
    """Rows whose [start, end] touches a break of their series (inclusive), or with keep=False those without one.

    A row no longer than `width_ms` lies in at most two bins of time, those of its ends, and meets the breaks there;
    longer rows, and those without a start or end, meet all breaks of their series.
    """
    b = _binned(breaks, width_ms, df.agg(F.max(end).alias("top")))
    same = (F.col("a.exchange") == F.col("b.exchange")) & (F.col("a.symbol") == F.col("b.symbol"))
    short = F.coalesce(F.col(end) - F.col(start) < width_ms, F.lit(False))

    def meet(rows: DataFrame, at: str, how: str) -> DataFrame:
        there = F.col("b.bin") == F.floor(F.col(f"a.{at}") / width_ms)
        return rows.alias("a").join(b.alias("b"), same & there & _touches(start, end), how)

    apart = meet(df.where(short), start, "left_anti")
    long = df.where(~short).alias("a").join(breaks.alias("b"), same & _touches(start, end), "left_semi" if keep else "left_anti")
    if not keep:
        return meet(apart, end, "left_anti").unionByName(long)
    return meet(df.where(short), start, "left_semi").unionByName(meet(apart, end, "left_semi")).unionByName(long)


def close_on_first_trade(feed_breaks: DataFrame, trades: DataFrame) -> DataFrame:
    """Per symbol, a break of generation g ends at the receipt of the first accepted trade of that generation at or after its start.

    feed_breaks: exchange, symbol, start_ms, generation, reason. The end is at least start + 1; without such a trade it stays open.
    """
    t = trades.select("exchange", "symbol", F.col("continuity_generation").alias("generation"), "timestamp_ms", "received_wall_ms")
    met = feed_breaks.join(t, ["exchange", "symbol", "generation"], "left")
    first = F.min(F.when(F.col("timestamp_ms") >= F.col("start_ms"), F.col("received_wall_ms")))
    closed = met.groupBy("exchange", "symbol", "generation", "start_ms", "reason").agg(first.alias("__received"))
    return closed.select(*SERIES, "start_ms", F.when(F.col("__received").isNotNull(), F.greatest(F.col("start_ms") + 1, "__received")).alias("end_ms"), "reason", "generation")


def feed_break_ends(closed: DataFrame) -> DataFrame:
    """A feed's break ends when every symbol's has: (exchange, generation, start_ms, end_ms or null)."""
    open_left = F.max(F.col("end_ms").isNull())
    return closed.groupBy("exchange", "generation", "start_ms").agg(F.when(~open_left, F.max("end_ms")).alias("end_ms"))


def fan_out_breaks(log: DataFrame, symbol_map: DataFrame) -> DataFrame:
    """Feed-wide events (null symbol) become one event for each configured symbol of the feed."""
    wide = log.where("symbol is null").drop("symbol").join(symbol_map.select("exchange", F.col("canonical").alias("symbol")).distinct(), "exchange")
    return log.where("symbol is not null").unionByName(wide.select(*log.columns))


def loss_breaks(log: DataFrame) -> DataFrame:
    """Start events for each loss in a feed's log, with the generation that it begins (1 for the first)."""
    lost = scanned(log.where(F.col("kind").isin(LOSS_KINDS)), ["exchange"], ["timestamp_ms", "kind"], by_time(), F.lit(1), "__nth")
    return lost.select("exchange", F.lit("start").alias("phase"), "timestamp_ms", F.col("kind").alias("reason"), F.lit(None).cast("string").alias("symbol"), F.col("__nth").alias("generation"))


def runtime_pauses(ticks: DataFrame, interval_seconds: float = 5.0, max_gap_seconds: float = 15.0) -> DataFrame:
    """Pauses between evaluations: elapsed time (wall or monotonic, the larger) beyond the interval, where it exceeds the gap.

    ticks: source, wall_ms, monotonic_s. Returns source, start_ms, end_ms, interruption_seconds.
    """
    day = F.floor(F.col("monotonic_s") / 86_400)
    stepped = previous(ticks, ["source"], ["monotonic_s", "wall_ms"], day, F.struct("wall_ms", "monotonic_s"), "__before")
    elapsed = F.greatest((F.col("wall_ms") - F.col("__before.wall_ms")) / 1000.0, F.col("monotonic_s") - F.col("__before.monotonic_s"))
    late = stepped.withColumn("interruption_seconds", elapsed - interval_seconds).where(F.col("interruption_seconds") > max_gap_seconds)
    return late.select("source", F.greatest(F.col("wall_ms") - F.round(F.col("interruption_seconds") * 1000).cast("long"), F.lit(1)).alias("start_ms"), F.col("wall_ms").alias("end_ms"), "interruption_seconds")


def clock_jumps(receipts: DataFrame, max_skew_seconds: float = 5.0) -> DataFrame:
    """Wall clock against the time projected from an anchor by the monotonic clock, per source.

    A deviation ahead of more than the skew is a jump: the anchor moves and a break [projected, wall] is reported; one
    behind is reported once for each run of such receipts and the projection is used. Anchors follow from earlier
    anchors, so a source's receipts (source, wall_ms, monotonic_s) stream through one fold in order; none are gathered.
    Receipts with a null in them are left out.
    """
    skew = max_skew_seconds * 1000

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, anchor, behind = None, (0, 0.0), False
        for rows in batches:
            out = []
            for source, wall, mono in rows.itertuples(index=False):
                if source != now:
                    now, anchor, behind = source, (wall, mono), False
                    continue
                projected = anchor[0] + round((mono - anchor[1]) * 1000)
                if wall - projected > skew:
                    out.append((source, "forward", projected, wall))
                    anchor, behind = (wall, mono), False
                elif projected - wall > skew:
                    if not behind:
                        out.append((source, "backward", wall, projected))
                    behind = True
                else:
                    behind = False
            yield pd.DataFrame(out, columns=["source", "kind", "start_ms", "end_ms"])

    rows = receipts.select("source", "wall_ms", "monotonic_s").where("source is not null and wall_ms is not null and monotonic_s is not null")
    ordered = rows.repartition("source").sortWithinPartitions("source", "monotonic_s", "wall_ms")
    return ordered.mapInPandas(fold, "source string, kind string, start_ms long, end_ms long")


def downtime_breaks(pairs: DataFrame, saved_ms: int, now_ms: int, retention_seconds: int = 4500) -> DataFrame:
    """After a restart every allowed pair has an open break from the snapshot on, not before the retention's cutoff."""
    start = max(now_ms - retention_seconds * 1000, saved_ms)
    return pairs.select(*SERIES).distinct().select(*SERIES, F.lit(start).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), F.lit("checkpoint_downtime").alias("reason"))


def segment_continuity(segments: DataFrame, breaks: DataFrame, max_gap_seconds: float, min_coverage: float, now: bool = True, width_ms: int = 3_600_000) -> DataFrame:
    """Adds coverage_ratio, largest_gap_seconds, last_gap_end_ms and continuous to segments.

    segments: exchange, symbol, seg_id, t_ms (end), w_ms (length), price_start_ms (last trade of the start price).
    breaks: merged ones. A break counts if it ends after price_start_ms and starts before the segment's end (open:
    not after it). Its whole length decides largest_gap_seconds; coverage is what the breaks leave of the segment.
    With now=True a break that ends after t counts as still open at t; with now=False only breaks without an end do.
    Segments meet breaks in bins of `width_ms`; a pair counts in the first bin that both cover.
    """
    t, bs, be = F.col("t_ms"), F.col("bs"), F.col("be")
    b = _binned(breaks, width_ms, segments.agg(F.max("t_ms").alias("top"))).select(*SERIES, F.col("start_ms").alias("bs"), F.col("end_ms").alias("be"), "bin")
    low = F.least(F.coalesce(F.col("price_start_ms"), t - F.col("w_ms")), t)
    cut = segments.withColumn("bin", F.explode(F.sequence(F.floor(low / width_ms), F.floor(t / width_ms))))
    if now:
        is_open, end = be.isNull() | (be > t), F.when(be.isNull() | (be > t), t).otherwise(be)
    else:
        is_open, end = be.isNull(), F.coalesce(be, t)
    relevant = ((bs < t) | (is_open & (bs <= t))) & (is_open | (be > F.coalesce(F.col("price_start_ms"), t - F.col("w_ms"))))
    first = F.col("bin") == F.floor(F.greatest(bs, low) / width_ms)
    met = cut.join(b, [*SERIES, "bin"]).where(first & relevant).withColumn("__open", is_open).withColumn("__end", end)
    clipped = F.greatest(F.least(F.col("__end"), t) - F.greatest(bs, t - F.col("w_ms")), F.lit(0))
    per = met.groupBy("seg_id").agg(F.max("__open").alias("__open"), F.max(F.col("__end") - bs).alias("__gap"), F.sum(clipped).alias("__lost"), F.max("__end").alias("__last"))
    out = segments.join(per, "seg_id", "left")
    out = out.withColumn("coverage_ratio", 1 - F.least(F.coalesce("__lost", F.lit(0)), F.col("w_ms")) / F.col("w_ms"))
    out = out.withColumn("largest_gap_seconds", F.coalesce("__gap", F.lit(0)) / 1000.0)
    whole = ~F.coalesce("__open", F.lit(False)) & (F.col("largest_gap_seconds") <= max_gap_seconds) & (F.col("coverage_ratio") >= min_coverage)
    out = out.withColumn("continuous", whole).withColumn("last_gap_end_ms", F.when(~F.col("continuous"), F.col("__last")))
    return out.drop("__open", "__gap", "__lost", "__last")
