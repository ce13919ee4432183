"""Feature selectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import col, correlation, double, numeric_columns, require
from ..errors import InvalidArgument
from ..plans.gram import pairwise
from .base import Transformer


class _Selector(Transformer):
    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.state["selected"]
        require(df, *names)
        return df.select(*[col(n) for n in names])

    @property
    def selected(self) -> list[str]:
        return list(self.state["selected"])

    @property
    def scores(self) -> dict[str, float]:
        return dict(self.state["scores"])


class VarianceThreshold(_Selector):
    """Numeric columns whose sample variance is above the threshold."""

    def __init__(self, threshold: float = 0.0) -> None:
        self.threshold = threshold

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        names = numeric_columns(df)
        row = df.agg(*[F.var_samp(double(n)) for n in names]).first() if names else ()
        scores = {n: v or 0.0 for n, v in zip(names, row, strict=True)}
        return {"scores": scores, "selected": [n for n in names if scores[n] > self.threshold]}


def _correlations(df: DataFrame, target: str | None) -> dict[str, float]:
    """Signed correlations with the target; 0 without spread."""
    if target is None:
        raise InvalidArgument("the selector needs a target")
    require(df, target)
    names = numeric_columns(df, [target])
    y = double(target)
    row = df.agg(*[correlation(double(n), y) for n in names]).first() if names else ()
    return {n: 0.0 if r is None or r != r else r for n, r in zip(names, row, strict=True)}


class SelectKBest(_Selector):
    """The k numeric columns that correlate most with the target, largest first; ties in column order."""

    def __init__(self, k: int = 10) -> None:
        self.k = k

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        scores = _correlations(df, target)
        return {"scores": scores, "selected": sorted(scores, key=lambda n: -scores[n])[: self.k]}


class SelectPercentile(_Selector):
    """The best ``percentile`` percent of numeric columns, the target counted among them, at least one."""

    def __init__(self, percentile: float = 10) -> None:
        self.percentile = percentile

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        k = max(1, int(len(numeric_columns(df)) * self.percentile / 100))
        return SelectKBest(k)._fit(df, target)


class RFE(_Selector):
    """Features go one by one, or ``step`` at a time, until ``n`` are left.

    A feature's score is its absolute correlation with the target (its variance
    without a target) less 0.3 times its mean absolute correlation with the
    other features left. All correlations come from one pass.
    """

    def __init__(self, n: int = 5, step: int = 1, columns: Sequence[str] | None = None) -> None:
        if n < 1 or step < 1:
            raise InvalidArgument("n and step are at least 1")
        self.n, self.step, self.columns = n, step, columns

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        names = list(self.columns or numeric_columns(df, [target] if target else []))
        require(df, *names, *([target] if target else []))
        r = pairwise(df, [*names, *([target] if target else [])], correlation)
        strength = lambda a, b: abs(r[a, b]) if r[a, b] is not None and r[a, b] == r[a, b] else 0.0
        if target:
            own = {n: strength(n, target) for n in names}
        else:
            row = df.agg(*[F.var_samp(double(n)) for n in names]).first()
            own = {n: v or 0.0 for n, v in zip(names, row, strict=True)}
        left, scores = list(names), {}
        while True:
            scores = {n: own[n] - 0.3 * sum(strength(n, o) for o in left if o != n) / max(1, len(left) - 1) for n in left}
            if len(left) <= self.n:
                return {"scores": scores, "selected": left}
            out = sorted(left, key=lambda n: scores[n])[: min(self.step, len(left) - self.n)]
            left = [n for n in left if n not in out]
