"""Correlation and covariance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import correlation, double, numeric_or_given, require
from ..errors import InvalidArgument
from ..plans.gram import pairwise

#: Rows in a range of Kendall's count, and the most ranges of a column.
BUCKET, MAX_RANGES = 100_000, 1_000


def pearson(df: DataFrame, x: str, y: str) -> float:
    require(df, x, y)
    known = df.filter(double(x).isNotNull() & double(y).isNotNull())
    n, r = known.agg(F.count(F.lit(1)), correlation(double(x), double(y))).first()
    if n < 2 or r is None or r != r:
        raise InvalidArgument("a correlation needs two rows or more, and spread in both columns")
    return r


def ranks(df: DataFrame, x: str, name: str = "rank") -> DataFrame:
    """``df`` with average ranks from 1 in the column ``name``; nulls have none.

    Equal values are counted first, so what is ranked is one row a value. The
    number of smaller rows is a running sum, by range of values over all executors.
    """
    from ..plans import halo
    from ..rows import with_row_id

    counts = df.filter(double(x).isNotNull()).groupBy(double(x).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = halo.from_start(with_row_id(counts, "_v", "_at"), "_at", {"_to": ("sum", F.col("_n"))})
    mean = F.col("_to") - (F.col("_n") - 1) / 2.0
    return df.join(placed.select("_v", mean.alias(name)), double(x) == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> float:
    """Pearson's correlation of average ranks."""
    require(df, x, y)
    known = df.filter(double(x).isNotNull() & double(y).isNotNull()).select(double(x).alias("x"), double(y).alias("y"))
    return pearson(ranks(ranks(known, "x", "rx"), "y", "ry"), "rx", "ry")


def _score(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> int:
    """Concordant less discordant pairs of distinct (x, y) that occur c times.

    Two ranks of y differ first in one bit: for each bit, those that agree above
    it are ordered by x, and running sums count the pairs that it parts.
    """
    xr, yr = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    total, wide = 0, int(xr.max(initial=0)) + 1
    for bit in range(int(yr.max(initial=0)).bit_length()):
        group = yr >> (bit + 1)
        order = np.argsort(group * wide + xr, kind="stable")
        g, key, up = group[order], (group * wide + xr)[order], (yr[order] >> bit) & 1
        low = np.concatenate([[0], np.cumsum(np.where(up == 0, c[order], 0))])
        before = low[np.searchsorted(key, key)] - low[np.searchsorted(g, g)]
        after = low[np.searchsorted(g, g, "right")] - low[np.searchsorted(key, key, "right")]
        total += int((np.where(up == 1, c[order], 0) * (before - after)).sum())
    return total


def kendall(df: DataFrame, x: str, y: str, bucket: int = BUCKET) -> float:
    """Tau-a: concordant less discordant pairs over all pairs, exactly and without making pairs.

    Both columns are cut into ranges of about ``bucket`` rows. Pairs that differ
    in both ranges are counted from the ranges' rows; the others by one task for
    each range of x and of y, less those that agree in both, which are counted twice.
    """
    require(df, x, y)
    known = df.filter(double(x).isNotNull() & double(y).isNotNull()).select(double(x).alias("x"), double(y).alias("y"))
    n, odd = known.agg(F.count(F.lit(1)), F.count(F.when(F.isnan("x") | F.isnan("y"), 1))).first()
    if n < 2:
        raise InvalidArgument(f"Kendall's tau takes 2 rows or more, not {n}")
    if odd:
        return float("nan")
    parts = min(-(-n // bucket), MAX_RANGES)
    cuts = [np.unique(q) for q in known.approxQuantile(["x", "y"], [k / parts for k in range(1, parts)], 0.1 / parts)] if parts > 1 else [np.empty(0)] * 2

    def place(batches):
        for b in batches:
            for name, cut in zip("xy", cuts, strict=True):
                # A value that is a cut has a range of its own, however common it is.
                b[f"{name}b"] = (np.searchsorted(cut, b[name]) + np.searchsorted(cut, b[name], "right")).astype(np.int64)
            yield b

    counts = known.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    placed = counts.mapInPandas(place, "x double, y double, c long, xb long, yb long").persist()

    def score(rows):
        import pandas as pd

        return pd.DataFrame({"s": [_score(rows["x"].to_numpy(), rows["y"].to_numpy(), rows["c"].to_numpy())]})

    def within(*keys: str) -> int:
        # Ranges of one value, and so without pairs that count, are left out.
        rows = placed
        for k in keys:
            rows = rows.filter(F.pmod(k, F.lit(2)) == 0)
        return rows.groupBy(*keys).applyInPandas(score, "s long").agg(F.sum("s")).first()[0] or 0

    try:
        cells = placed.groupBy("xb", "yb").agg(F.sum("c").alias("c")).toPandas()
        s = _score(cells["xb"].to_numpy(), cells["yb"].to_numpy(), cells["c"].to_numpy())
        s += within("xb") + within("yb") - within("xb", "yb")
    finally:
        placed.unpersist()
    return s / (n * (n - 1) / 2)


def covariance(df: DataFrame, x: str, y: str) -> float:
    """Sample covariance; 0 for fewer than two rows."""
    require(df, x, y)
    return pairwise(df, [x, y], F.covar_samp)[x, y] or 0.0


def _matrix(df: DataFrame, names: list[str], values: dict) -> DataFrame:
    schema = "`column` string, " + ", ".join(f"`{n}` double" for n in names)
    rows = [(a, *[None if values[a, b] is None or values[a, b] != values[a, b] else float(values[a, b]) for b in names]) for a in names]
    return df.sparkSession.createDataFrame(rows, schema)


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """A row for each numeric column: ``column`` and its correlation with each, over rows where both have values.

    The diagonal is 1; without spread a correlation is null.
    """
    names = numeric_or_given(df, columns)
    if method == "pearson":
        values = pairwise(df, names, correlation)
    elif method in ("spearman", "kendall"):
        one = spearman if method == "spearman" else kendall
        values = {}
        for i, a in enumerate(names):
            for b in names[i:]:
                try:
                    values[a, b] = values[b, a] = one(df, a, b)
                except InvalidArgument:
                    values[a, b] = values[b, a] = None
    else:
        raise InvalidArgument(f"method is pearson, spearman or kendall, not {method!r}")
    return _matrix(df, names, values | {(n, n): 1.0 for n in names})


def cov_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = numeric_or_given(df, columns)
    return _matrix(df, names, pairwise(df, names, F.covar_samp))
