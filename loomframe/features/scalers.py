"""Scalers. Nulls stay null; a column without spread stays as it is."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import col, double, numeric_or_given, require
from ..plans.quantiles import quantiles
from .base import Transformer


def _learn(df: DataFrame, names: Sequence[str], stats: Callable[[Column], dict[str, Column]]) -> dict[str, dict[str, float | None]]:
    """Statistics of all columns in one pass: statistic -> column -> value."""
    made = {(s, n): c for n in names for s, c in stats(double(n)).items()}
    row = df.agg(*[c.alias(f"v{i}") for i, c in enumerate(made.values())]).first() if made else ()
    out: dict[str, dict[str, float | None]] = {}
    for (s, n), v in zip(made, row, strict=True):
        out.setdefault(s, {})[n] = v
    return out


class _Scaler(Transformer):
    columns: Sequence[str] | None

    def _stats(self, c: Column) -> dict[str, Column]:
        raise NotImplementedError

    def _scaled(self, c: Column, name: str) -> Column:
        raise NotImplementedError

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        names = [n for n in numeric_or_given(df, self.columns) if self.columns or n != target]
        return {"columns": names, **_learn(df, names, self._stats)}

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.state["columns"]
        require(df, *names)
        return df.select(*[(self._scaled(double(c), c) if c in names else col(c)).alias(c) for c in df.columns])

    def _of(self, stat: str, name: str) -> float | None:
        return self.state[stat][name]


class StandardScaler(_Scaler):
    """(x - mean) / sample standard deviation."""

    def __init__(self, columns: Sequence[str] | None = None, with_mean: bool = True, with_std: bool = True) -> None:
        self.columns, self.with_mean, self.with_std = columns, with_mean, with_std

    def _stats(self, c: Column) -> dict[str, Column]:
        return {"mean": F.avg(c), "std": F.stddev_samp(c)}

    def _scaled(self, c: Column, name: str) -> Column:
        mean, std = self._of("mean", name), self._of("std", name)
        if not std:
            return c
        c = c - F.lit(mean) if self.with_mean else c
        return c / F.lit(std) if self.with_std else c

    @property
    def means(self) -> dict[str, float]:
        return dict(self.state["mean"])

    @property
    def stds(self) -> dict[str, float]:
        """0 where a column has no spread, or fewer than two values."""
        return {n: v or 0.0 for n, v in self.state["std"].items()}


class MinMaxScaler(_Scaler):
    """To between ``feature_min`` and ``feature_max``."""

    def __init__(self, columns: Sequence[str] | None = None, feature_min: float = 0.0, feature_max: float = 1.0) -> None:
        self.columns, self.feature_min, self.feature_max = columns, feature_min, feature_max

    def _stats(self, c: Column) -> dict[str, Column]:
        return {"min": F.min(c), "max": F.max(c)}

    def _scaled(self, c: Column, name: str) -> Column:
        low, high = self._of("min", name), self._of("max", name)
        if low is None or high == low:
            return c
        return (c - F.lit(low)) / F.lit(high - low) * F.lit(float(self.feature_max - self.feature_min)) + F.lit(float(self.feature_min))

    @property
    def mins(self) -> dict[str, float]:
        return dict(self.state["min"])

    @property
    def maxs(self) -> dict[str, float]:
        return dict(self.state["max"])


class RobustScaler(_Scaler):
    """(x - median) / difference of two exact quantiles."""

    def __init__(
        self, columns: Sequence[str] | None = None, with_centering: bool = True, with_scaling: bool = True, quantile_range: Sequence[float] = (0.25, 0.75)
    ) -> None:
        self.columns, self.with_centering, self.with_scaling, self.quantile_range = columns, with_centering, with_scaling, list(quantile_range)

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        names = [n for n in numeric_or_given(df, self.columns) if self.columns or n != target]
        found = quantiles(df, names, [0.5, *self.quantile_range])
        return {
            "columns": names,
            "median": {n: v[0] for n, v in found.items()},
            "iqr": {n: None if v[0] is None else v[2] - v[1] for n, v in found.items()},
        }

    def _scaled(self, c: Column, name: str) -> Column:
        median, iqr = self._of("median", name), self._of("iqr", name)
        if not iqr:
            return c
        c = c - F.lit(median) if self.with_centering else c
        return c / F.lit(iqr) if self.with_scaling else c

    @property
    def medians(self) -> dict[str, float]:
        return dict(self.state["median"])

    @property
    def iqrs(self) -> dict[str, float]:
        return dict(self.state["iqr"])


class MaxAbsScaler(_Scaler):
    """x / largest absolute value."""

    def __init__(self, columns: Sequence[str] | None = None) -> None:
        self.columns = columns

    def _stats(self, c: Column) -> dict[str, Column]:
        return {"max_abs": F.max(F.abs(c))}

    def _scaled(self, c: Column, name: str) -> Column:
        most = self._of("max_abs", name)
        return c / F.lit(most) if most else c

    @property
    def max_abs(self) -> dict[str, float]:
        return dict(self.state["max_abs"])
