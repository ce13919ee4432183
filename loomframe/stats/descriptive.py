"""Descriptive statistics of a column, each an aggregate column, and all of them together.

As aggregate columns, quantiles hold the distinct values of a group in one task;
``describe``, ``iqr_of`` and ``percentile_of`` count in bounded memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import double, require
from ..plans.quantiles import quantiles


def mean(c: Column) -> Column:
    return F.avg(c)


def median(c: Column) -> Column:
    return F.median(c)


def mode(c: Column) -> Column:
    """The most frequent value; of several the smallest."""
    return F.mode(c, True)


def mode_count(df: DataFrame, name: str) -> DataFrame:
    """``value`` and ``frequency`` of the most frequent value that is not null; of several the smallest."""
    require(df, name)
    counts = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("frequency"))
    return counts.orderBy(F.desc("frequency"), "value").limit(1)


def std(c: Column) -> Column:
    """Sample standard deviation; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def var(c: Column) -> Column:
    return F.coalesce(F.var_samp(c), F.lit(0.0))


def value_range(c: Column) -> Column:
    return F.max(c) - F.min(c)


def iqr_of(df: DataFrame, name: str) -> float | None:
    """The distance of the quartiles, for columns of any size."""
    low, high = quantiles(df, [name], [0.25, 0.75])[name]
    return None if low is None else high - low


def percentile_of(df: DataFrame, name: str, p: float) -> float | None:
    """:func:`percentile` for columns of any size."""
    return quantiles(df, [name], [min(1.0, max(0.0, p / 100))])[name][0]


def iqr(c: Column) -> Column:
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    return q[1] - q[0]


def skew(c: Column) -> Column:
    """Adjusted Fisher-Pearson skewness; 0 for fewer than three values or without spread."""
    n = F.count(c).cast("double")
    return F.when((n < 3) | (F.coalesce(F.stddev_samp(c), F.lit(0.0)) == 0), F.lit(0.0)).otherwise(F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurtosis(c: Column) -> Column:
    """Sample excess kurtosis; 0 for fewer than four values or without spread."""
    n = F.count(c).cast("double")
    value = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when((n < 4) | (F.coalesce(F.stddev_samp(c), F.lit(0.0)) == 0), F.lit(0.0)).otherwise(value)


def quantile(c: Column, q: float) -> Column:
    """Exact, with linear interpolation; ``q`` is held between 0 and 1."""
    return F.percentile(c, F.lit(min(1.0, max(0.0, q))))


def percentile(c: Column, p: float) -> Column:
    return quantile(c, p / 100)


def describe(df: DataFrame, name: str) -> DataFrame:
    """One row: count, mean, std, min, q25, median, q75, max, skewness, kurtosis."""
    require(df, name)
    x = double(name)
    q = [F.max(F.lit(v).cast("double")) for v in quantiles(df, [name], [0.25, 0.5, 0.75])[name]]
    return df.agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), q[0].alias("q25"),
        q[1].alias("median"), q[2].alias("q75"), F.max(x).alias("max"), skew(x).alias("skewness"), kurtosis(x).alias("kurtosis"),
    )
