"""Normal, uniform and binomial distributions: values on the driver, densities as columns, samples in Spark."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .special import beta_i


def _by_value(f: Callable[[float], float], c: Column) -> Column:
    """A function of a number for a column, in Arrow batches; nulls stay null."""

    @F.pandas_udf("double")
    def made(x: pd.Series) -> pd.Series:
        return x.map(f, na_action="ignore").astype(float)

    return made(c.cast("double"))


@dataclass(frozen=True)
class Normal:
    mu: float = 0.0
    sigma: float = 1.0

    def __post_init__(self) -> None:
        if self.sigma <= 0:
            object.__setattr__(self, "sigma", 1.0)

    def pdf(self, x: float) -> float:
        return NormalDist(self.mu, self.sigma).pdf(x)

    def cdf(self, x: float) -> float:
        return 0.5 * math.erfc((self.mu - x) / (self.sigma * math.sqrt(2)))

    def ppf(self, p: float) -> float:
        if p in (0, 1):
            return math.inf if p else -math.inf
        return NormalDist(self.mu, self.sigma).inv_cdf(p)

    def pdf_column(self, c: Column) -> Column:
        z = (c - self.mu) / self.sigma
        return F.exp(-z * z / 2) / (self.sigma * math.sqrt(2 * math.pi))

    def cdf_column(self, c: Column) -> Column:
        return _by_value(self.cdf, c)

    def ppf_column(self, c: Column) -> Column:
        return _by_value(self.ppf, c)

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        return spark.range(n).select((F.randn(seed) * self.sigma + self.mu).alias("value"))

    def mean(self) -> float:
        return self.mu

    def variance(self) -> float:
        return self.sigma**2


def standard_normal() -> Normal:
    return Normal()


@dataclass(frozen=True)
class Uniform:
    low: float = 0.0
    high: float = 1.0

    def __post_init__(self) -> None:
        if self.low >= self.high:
            object.__setattr__(self, "high", self.low + 1)

    def pdf(self, x: float) -> float:
        return 1 / (self.high - self.low) if self.low <= x <= self.high else 0.0

    def cdf(self, x: float) -> float:
        return min(1.0, max(0.0, (x - self.low) / (self.high - self.low)))

    def ppf(self, p: float) -> float:
        return self.low + p * (self.high - self.low)

    def pdf_column(self, c: Column) -> Column:
        return F.when(c.between(self.low, self.high), 1 / (self.high - self.low)).when(c.isNotNull(), 0.0)

    def cdf_column(self, c: Column) -> Column:
        return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c - self.low) / (self.high - self.low))))

    def ppf_column(self, c: Column) -> Column:
        return F.lit(self.low) + c * (self.high - self.low)

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        return spark.range(n).select((F.rand(seed) * (self.high - self.low) + self.low).alias("value"))

    def mean(self) -> float:
        return (self.low + self.high) / 2

    def variance(self) -> float:
        return (self.high - self.low) ** 2 / 12


@dataclass(frozen=True)
class Binomial:
    n: int = 1
    p: float = 0.5

    def __post_init__(self) -> None:
        object.__setattr__(self, "n", 1 if self.n < 0 else self.n)
        object.__setattr__(self, "p", min(1.0, max(0.0, self.p)))

    def pmf(self, k: int) -> float:
        if not 0 <= k <= self.n:
            return 0.0
        if self.p in (0.0, 1.0):
            return float(k == self.n * self.p)
        log = math.lgamma(self.n + 1) - math.lgamma(k + 1) - math.lgamma(self.n - k + 1)
        return math.exp(log + k * math.log(self.p) + (self.n - k) * math.log1p(-self.p))

    def cdf(self, k: int) -> float:
        if k < 0:
            return 0.0
        return 1.0 if k >= self.n else beta_i(self.n - k, k + 1, 1 - self.p)

    def pmf_column(self, c: Column) -> Column:
        return _by_value(lambda k: self.pmf(int(k)), c)

    def cdf_column(self, c: Column) -> Column:
        return _by_value(lambda k: self.cdf(int(k)), c)

    def sample(self, spark: SparkSession, size: int, seed: int = 0) -> DataFrame:
        """Sums of seeded trials. Every draw and trial has a hash of its own."""
        share = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), k), F.lit(1 << 53)) / float(1 << 53)
        hits = F.filter(F.sequence(F.lit(1), F.lit(self.n)), lambda k: share(k) < self.p)
        return spark.range(size).select((F.size(hits) if self.n else F.lit(0)).cast("long").alias("value"))

    def mean(self) -> float:
        return self.n * self.p

    def variance(self) -> float:
        return self.n * self.p * (1 - self.p)
