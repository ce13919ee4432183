"""Hypothesis tests. Each is one aggregate in Spark and a p-value on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import col, double, require
from ..errors import InvalidArgument, InvalidShape
from ..functions.special import chi2_upper, f_upper, t_two_sided


@dataclass(frozen=True)
class TTestResult:
    statistic: float
    p_value: float
    df: float


@dataclass(frozen=True)
class ChiSquareResult:
    statistic: float
    p_value: float
    df: int


@dataclass(frozen=True)
class AnovaResult:
    f_statistic: float
    p_value: float
    df_between: int
    df_within: int


def _moments(df: DataFrame, c) -> tuple[int, float, float]:
    n, m, v = df.agg(F.count(c), F.avg(c), F.var_samp(c)).first()
    return n, m or 0.0, v or 0.0


def _t(difference: float, error: float, df: float) -> TTestResult:
    t = difference / error if error else (0.0 if difference == 0 else math.copysign(math.inf, difference))
    return TTestResult(t, t_two_sided(t, df), df)


def ttest(df: DataFrame, name: str, mu: float = 0.0) -> TTestResult:
    """One sample, two-sided; zeros for fewer than two values."""
    require(df, name)
    n, m, v = _moments(df, double(name))
    return TTestResult(0.0, 0.0, 0) if n < 2 else _t(m - mu, math.sqrt(v / n), n - 1)


def ttest_2sample(a: DataFrame, x: str, b: DataFrame, y: str, equal_var: bool = True) -> TTestResult:
    """Two samples: pooled variance, or Welch's with its degrees of freedom rounded down."""
    (n1, m1, v1), (n2, m2, v2) = _moments(a, double(x)), _moments(b, double(y))
    if n1 < 2 or n2 < 2:
        return TTestResult(0.0, 0.0, 0)
    if equal_var:
        pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
        return _t(m1 - m2, math.sqrt(pooled * (1 / n1 + 1 / n2)), n1 + n2 - 2)
    s1, s2 = v1 / n1, v2 / n2
    whole = s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)
    return _t(m1 - m2, math.sqrt(s1 + s2), max(1, int((s1 + s2) ** 2 / whole)) if whole else n1 + n2 - 2)


def ttest_paired(df: DataFrame, x: str, y: str) -> TTestResult:
    """One sample on the differences of rows where both have values."""
    require(df, x, y)
    n, m, v = _moments(df, double(x) - double(y))
    return TTestResult(0.0, 0.0, 0) if n < 2 else _t(m, math.sqrt(v / n), n - 1)


def chi_square(observed: Sequence[Sequence[float]], expected: Sequence[Sequence[float]]) -> ChiSquareResult:
    """Two tables of counts; cells that expect nothing are passed over."""
    if len(observed) != len(expected) or any(len(o) != len(e) for o, e in zip(observed, expected, strict=True)) or not observed:
        raise InvalidShape("observed and expected differ in shape")
    s = sum((o - e) ** 2 / e for os, es in zip(observed, expected, strict=True) for o, e in zip(os, es, strict=True) if e > 0)
    df = (len(observed) - 1) * (len(observed[0]) - 1)
    return ChiSquareResult(s, chi2_upper(s, df) if df else 1.0, df)


def chi_square_gof(observed: Sequence[float], expected: Sequence[float]) -> ChiSquareResult:
    if len(observed) != len(expected) or not observed:
        raise InvalidShape("observed and expected differ in length")
    s = sum((o - e) ** 2 / e for o, e in zip(observed, expected, strict=True) if e > 0)
    df = len(observed) - 1
    return ChiSquareResult(s, chi2_upper(s, df) if df else 1.0, df)


def chi_square_independence(df: DataFrame, rows: str, columns: str) -> ChiSquareResult:
    """Whether two columns are independent; rows with a null in either are left out."""
    require(df, rows, columns)
    counts = df.filter(col(rows).isNotNull() & col(columns).isNotNull()).groupBy(col(rows).alias("r"), col(columns).alias("c")).count()
    by_r, by_c = counts.groupBy("r").agg(F.sum("count").alias("nr")), counts.groupBy("c").agg(F.sum("count").alias("nc"))
    n, cells, k, m = counts.agg(F.sum("count"), F.sum(F.lit(0.0)), F.count_distinct("r"), F.count_distinct("c")).first()
    if not n:
        raise InvalidArgument("there are no rows with both values")
    e = F.col("nr") * F.col("nc") / F.lit(float(n))
    # Cells without rows add what they expect: sum (o - e)^2 / e = sum o^2 / e - n.
    s = counts.join(by_r, "r").join(by_c, "c").agg(F.sum(F.col("count") * F.col("count") / e)).first()[0] - n + cells
    degrees = (k - 1) * (m - 1)
    return ChiSquareResult(s, chi2_upper(s, degrees) if degrees else 1.0, degrees)


def one_way_anova(df: DataFrame, group: str, value: str) -> AnovaResult:
    """Whether groups share a mean. F is 0 where groups have no spread within."""
    require(df, group, value)
    x = double(value)
    groups = df.filter(x.isNotNull()).groupBy(col(group)).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("v"))
    k, n, mean = groups.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")).first()
    if k < 2 or n <= k:
        raise InvalidArgument("an analysis of variance needs two groups and more values than groups")
    between, within = groups.agg(F.sum(F.col("n") * F.pow(F.col("m") - F.lit(mean), F.lit(2.0))), F.sum((F.col("n") - 1) * F.col("v"))).first()
    f = (between / (k - 1)) / (within / (n - k)) if within else 0.0
    return AnovaResult(f, f_upper(f, k - 1, n - k), k - 1, n - k)


def anova(*samples: Sequence[float]) -> AnovaResult:
    """:func:`one_way_anova` of samples on the driver."""
    samples = [list(s) for s in samples if len(s)]
    k, n = len(samples), sum(map(len, samples))
    if k < 2 or n <= k:
        raise InvalidArgument("an analysis of variance needs two groups and more values than groups")
    mean = sum(map(sum, samples)) / n
    between = sum(len(s) * (sum(s) / len(s) - mean) ** 2 for s in samples)
    within = sum((x - sum(s) / len(s)) ** 2 for s in samples for x in s)
    f = (between / (k - 1)) / (within / (n - k)) if within else 0.0
    return AnovaResult(f, f_upper(f, k - 1, n - k), k - 1, n - k)
