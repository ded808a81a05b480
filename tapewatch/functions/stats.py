"""Robust statistics as column expressions over arrays; no user-defined functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scales the median absolute deviation to the standard deviation of a normal distribution.
MAD_SCALE = 0.6744897501960817
TINY = 1e-12
MIN_SAMPLE = 5


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def median_of_sorted(a: Column) -> Column:
    n = F.size(a)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(a, low) + F.get(a, high)) / 2)


def array_median(a: Column) -> Column:
    return median_of_sorted(F.array_sort(a))


def with_robust_zscore(df: DataFrame, value: str, sample: Column, out: str) -> DataFrame:
    """Adds the score of a value column against an array sample.

    Non-finite points are dropped; below five points the score is null. It is the scaled distance from the median in
    median absolute deviations; without spread there, in sample standard deviations; without any spread it is 0 where
    the value equals the median (to 1e-12, relative or absolute), else null. Each step is a column of its own, so that
    nothing is computed again for every element.
    """
    a, m, d, mean, sd = (f"__{out}_{k}" for k in ("a", "m", "d", "mean", "sd"))
    n = F.size(a).cast("double")
    x = F.col(value)
    df = df.withColumn(a, F.array_sort(F.filter(sample, finite)))
    df = df.withColumn(m, median_of_sorted(F.col(a))).withColumn(mean, F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), n))
    df = df.withColumn(d, F.array_sort(F.transform(a, lambda v: F.abs(v - F.col(m))))).withColumn(sd, F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - F.col(mean)) * (v - F.col(mean))), n - 1)))
    df = df.withColumn(d, median_of_sorted(F.col(d)))
    near = F.abs(x - F.col(m)) <= F.greatest(TINY * F.greatest(F.abs(x), F.abs(F.col(m))), F.lit(TINY))
    score = (
        F.when(~finite(x) | (F.size(a) < MIN_SAMPLE), F.lit(None).cast("double"))
        .when(F.col(d) > TINY, F.lit(MAD_SCALE) * (x - F.col(m)) / F.col(d))
        .when(F.col(sd) > TINY, (x - F.col(mean)) / F.col(sd))
        .when(near, F.lit(0.0))
    )
    return df.withColumn(out, score).drop(a, m, d, mean, sd)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 2).when(severity == "warning", 1).otherwise(0)
