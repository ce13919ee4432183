"""Exact quantiles of whole columns in bounded memory.

Spark's exact percentile gathers the distinct values of a group in one task,
which is right for moderate frames and impossible for huge ones. Above a number
of rows, order statistics are found by counting: values are counted in bins, the
bin that holds the wanted rank is binned again, until few values or one are left.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import col, double
from ..rows import with_row_id
from ..session import written
from .halo import from_start

#: Frames of up to so many rows are left to Spark's percentile.
MODERATE = 5_000_000
BINS = 4096
#: Groups of what reads up to so many bytes, as the optimizer estimates them, are left to Spark's percentile.
MODERATE_BYTES = 4 << 30
#: So many values are gathered and sorted on the driver at the end.
FEW = 10_000


def quantiles(df: DataFrame, names: Sequence[str], qs: Sequence[float], moderate: int = MODERATE) -> dict[str, list[float | None]]:
    """For each column its quantiles with linear interpolation; None without values. Nulls are passed over, NaN is largest."""
    if not names:
        return {}
    x = df.select(*[double(n).alias(f"x{i}") for i, n in enumerate(names)])
    if x.limit(moderate + 1).count() <= moderate:
        row = x.agg(*[F.percentile(f"x{i}", F.array(*[F.lit(float(q)) for q in qs])) for i in range(len(names))]).first()
        return {n: list(v) if v is not None else [None] * len(qs) for n, v in zip(names, row, strict=True)}
    return {n: _by_counting(x.select(F.col(f"x{i}").alias("x")).filter("x IS NOT NULL"), qs) for i, n in enumerate(names)}


def _by_counting(x: DataFrame, qs: Sequence[float]) -> list[float | None]:
    known = x.filter(~F.isnan("x"))
    n, low, high = known.agg(F.count("x"), F.min("x"), F.max("x")).first()
    all_ = x.count()
    if not all_:
        return [None] * len(qs)
    found: dict[int, float] = {}

    def rank(k: int) -> float:
        if k >= n:
            return math.nan
        if k not in found:
            found[k] = _order_statistic(known, k, n, low, high)
        return found[k]

    out = []
    for q in qs:
        at = q * (all_ - 1)
        a, b = rank(math.floor(at)), rank(math.ceil(at))
        out.append(a if a == b else a + (at - math.floor(at)) * (b - a))
    return out


def _order_statistic(x: DataFrame, k: int, n: int, low: float, high: float) -> float:
    """The k-th smallest, from 0, of ``n`` values between ``low`` and ``high``."""
    while low < high:
        inside = x.filter((F.col("x") >= F.lit(low)) & (F.col("x") <= F.lit(high)))
        if n <= FEW:
            return sorted(r["x"] for r in inside.collect())[k]
        width = high / BINS - low / BINS
        if width <= 0 or math.isinf(width) or low / width == high / width:
            at = F.when(F.col("x") < F.lit(low / 2 + high / 2), 0).otherwise(1)
        else:
            at = F.least(F.floor(F.col("x") / F.lit(width) - F.lit(low / width)), F.lit(BINS))
        bins = inside.groupBy(at.alias("b")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("low").collect()
        if len(bins) == 1:  # neighbours that no width tells apart
            bins = inside.groupBy(F.col("x").alias("low")).agg(F.count("x").alias("n"), F.max("x").alias("high")).orderBy("low").collect()
        for r in bins:
            if k < r["n"]:
                n, low, high = r["n"], r["low"], r["high"]
                break
            k -= r["n"]
    return low


def is_large(df: DataFrame) -> bool:
    """What ``df`` reads is above MODERATE_BYTES by the optimizer's estimates (of its sources: those of joins are products). No job is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) > MODERATE_BYTES


def grouped_quantiles(df: DataFrame, keys: Sequence[str], name: str, qs: Sequence[float]) -> DataFrame:
    """The keys and ``q0``, ``q1``, ...: each group's quantiles, with no group in one task.

    Equal values are counted first; values are numbered over all executors, in
    the order of keys and value, so that a group that has most rows is shared.
    Null values are passed over; a null key is a group of its own.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    values = df.select(*[col(c).alias(a) for c, a in zip(keys, k, strict=True)], double(name).alias("_v")).filter("_v IS NOT NULL")
    counted = values.groupBy(*k, "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = with_row_id(counted, [*k, "_v"])
    ends = from_start(placed, "_row", {"_end": ("sum", F.col("_n"))})
    ends = written(ends, "ends")
    groups = written(ends.groupBy(*k).agg(F.min(F.col("_end") - F.col("_n")).alias("_base"), F.sum("_n").alias("_all")), "groups")
    same = F.lit(True)
    for a in k:
        same = same & F.col(f"e.{a}").eqNullSafe(F.col(f"g.{a}"))
    both = ends.alias("e").join(groups.alias("g"), same).select(*[F.col(f"e.{a}").alias(a) for a in k], "_v", "_n", "_all", (F.col("_end") - F.col("_base")).alias("_end"))
    found = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("_all") - 1)
        for part, rank in (("a", F.floor(at)), ("b", F.ceil(at))):
            found.append(F.max(F.when((F.col("_end") > rank) & (F.col("_end") - F.col("_n") <= rank), F.col("_v"))).alias(f"_{part}{i}"))
    merged = both.groupBy(*k).agg(F.max("_all").alias("_all"), *found)
    at = [F.lit(float(q)) * (F.col("_all") - 1) for q in qs]
    out = [(F.col(f"_a{i}") + (at[i] - F.floor(at[i])) * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(f"q{i}") for i in range(len(qs))]
    return merged.select(*[F.col(a).alias(c) for a, c in zip(k, keys, strict=True)], *out)
