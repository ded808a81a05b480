"""Windows over long series, cut into chunks so that no task sorts a whole one.

What a chunk needs from earlier ones is either one row for each chunk (`carried`, `previous`, `scanned`) or a halo of
the rows just before it (`with_halo`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least rows of a chunk of a dense grid; longer halos make longer chunks.
ROWS = 4096
#: Length of a chunk of rows that lie in time.
DAY_MS = 86_400_000


def chunk_rows(halo: int) -> int:
    """Rows of a chunk, of which an eighth at most is read twice."""
    return max(ROWS, 8 * halo)


def by_time(column: str = "timestamp_ms", length_ms: int = DAY_MS) -> Column:
    return F.floor(F.col(column) / length_ms)


def _met(rows: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what their chunk has from earlier ones; a null key or chunk is a value like any other."""
    names = {k: f"__key{n}" for n, k in enumerate([*keys, "__chunk"])}
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return rows.join(per.withColumnsRenamed(names), same)


def scanned(df: DataFrame, keys: list[str], order: list[str | Column], chunk: Column, value: Column, out: str, how: str = "sum", own: bool = True) -> DataFrame:
    """Adds the sum (or with how="max" the maximum) of the values up to each row, with own=False of the rows before it.

    Null values count as nothing; where no value came yet the result is null. Chunks ascend with the order; ties in the
    order fall as they may. Counts, row numbers and numbers of islands are sums of ones.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    rows = df.withColumn("__chunk", chunk).withColumn("__value", value)
    per = rows.groupBy(*keys, "__chunk").agg(fold("__value").alias("__top"))
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "__chunk", fold("__top").over(earlier).alias("__before"))
    here = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    met = _met(rows.withColumn("__own", fold("__value").over(here)), per, keys)
    a, b = F.col("__own"), F.col("__before")
    return met.withColumn(out, F.greatest(a, b) if how == "max" else F.coalesce(a + b, a, b)).select(*df.columns, out)


def carried(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column, out: str) -> DataFrame:
    """Adds the last value that is not null at or before each row. Chunks ascend with the order; keys are not null."""
    rows = df.withColumn("__chunk", chunk).withColumn("__value", value)
    at = F.when(F.col("__value").isNotNull(), F.struct(*order))
    per = rows.groupBy(*keys, "__chunk").agg(F.max_by("__value", at).alias("__top"))
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "__chunk", F.last("__top", ignorenulls=True).over(earlier).alias("__before"))
    own = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("__own", F.last("__value", ignorenulls=True).over(own)).join(per, [*keys, "__chunk"])
    return met.withColumn(out, F.coalesce("__own", "__before")).select(*df.columns, out)


def previous(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column, out: str) -> DataFrame:
    """Adds the value of the row before, null for the first row of a series; ties in the order fall as they may. Keys may be null."""
    rows = df.withColumn("__chunk", chunk).withColumn("__value", F.struct(value.alias("v")))
    per = rows.groupBy(*keys, "__chunk").agg(F.max_by("__value", F.struct(*order)).alias("__top"))
    per = per.select(*keys, "__chunk", F.lag("__top").over(Window.partitionBy(*keys).orderBy("__chunk")).alias("__before"))
    own = F.lag("__value").over(Window.partitionBy(*keys, "__chunk").orderBy(*order))
    met = _met(rows.withColumn("__own", own), per, keys)
    return met.withColumn(out, F.coalesce("__own", "__before")["v"]).select(*df.columns, out)


def with_halo(df: DataFrame, length: int, halo: int, idx: str = "idx") -> DataFrame:
    """Copies of the rows of a dense grid as `__chunk`, each chunk with the `halo` rows before it (`__own` is false there)."""
    first, last = F.floor(F.col(idx) / length), F.floor((F.col(idx) + halo) / length)
    return df.withColumn("__chunk", F.explode(F.sequence(first, last))).withColumn("__own", F.col("__chunk") == first)
