"""Features made from features."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import col, double, numeric_or_given, require
from ..errors import InvalidArgument
from ..plans.quantiles import quantiles
from .base import Transformer


class PolynomialFeatures(Transformer):
    """All columns, and powers and products of the numeric ones.

    Names: ``bias`` (1.0), ``a^2``, ``a*b``; at degree 3 ``a^3``, ``a*b*c``,
    and ``a^2*b`` for each ordered pair; above that pure powers. Products alone
    if ``interaction_only``; then a^2*b is left out as well.
    """

    def __init__(self, degree: int = 2, include_bias: bool = False, interaction_only: bool = False, columns: Sequence[str] | None = None) -> None:
        if degree < 1:
            raise InvalidArgument("the degree is at least 1")
        self.degree, self.include_bias, self.interaction_only, self.columns = degree, include_bias, interaction_only, columns

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        return {"columns": [n for n in numeric_or_given(df, self.columns) if self.columns or n != target]}

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.state["columns"]
        require(df, *names)
        new: dict[str, Column] = {"bias": F.lit(1.0)} if self.include_bias else {}
        x = {n: double(n) for n in names}
        if self.degree >= 2:
            if not self.interaction_only:
                new |= {f"{a}^2": x[a] * x[a] for a in names}
            new |= {f"{a}*{b}": x[a] * x[b] for a, b in combinations(names, 2)}
        if self.degree >= 3:
            if not self.interaction_only:
                new |= {f"{a}^3": x[a] * x[a] * x[a] for a in names}
                new |= {f"{a}^2*{b}": x[a] * x[a] * x[b] for a in names for b in names if a != b}
            new |= {f"{a}*{b}*{c}": x[a] * x[b] * x[c] for a, b, c in combinations(names, 3)}
        if not self.interaction_only:
            new |= {f"{a}^{d}": F.pow(x[a], F.lit(float(d))) for d in range(4, self.degree + 1) for a in names}
        return df.select("*", *[v.alias(n) for n, v in new.items()])


class InteractionFeatures(Transformer):
    """All columns, and the product of each pair of those named."""

    def __init__(self, columns: Sequence[str]) -> None:
        if len(columns) < 2:
            raise InvalidArgument("an interaction needs two columns")
        self.columns = list(columns)

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        return {"columns": numeric_or_given(df, self.columns)}

    def _transform(self, df: DataFrame) -> DataFrame:
        require(df, *self.columns)
        return df.select("*", *[(double(a) * double(b)).alias(f"{a}*{b}") for a, b in combinations(self.columns, 2)])


class BinDiscretizer(Transformer):
    """Bins of equal width (uniform) or equal count (quantile; kmeans is the same).

    A value below the first edge is in the first bin, one from the last edge on
    in the last. ordinal: the bin's number in place of the value, null if null;
    onehot: 0/1 columns ``{column}_bin{i}`` in place of the column.
    """

    def __init__(self, columns: Sequence[str], n_bins: int = 5, strategy: str = "uniform", encode: str = "ordinal") -> None:
        if n_bins < 2 or strategy not in ("uniform", "quantile", "kmeans") or encode not in ("ordinal", "onehot"):
            raise InvalidArgument("needs two bins; strategy uniform, quantile or kmeans; encode ordinal or onehot")
        self.columns, self.n_bins, self.strategy, self.encode = list(columns), n_bins, strategy, encode

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        names = numeric_or_given(df, self.columns)
        if self.strategy == "uniform":
            row = df.agg(*[F.array(F.min(double(n)), F.max(double(n))).alias(f"v{i}") for i, n in enumerate(names)]).first()
        else:
            row = quantiles(df, names, [i / self.n_bins for i in range(self.n_bins + 1)]).values()
        edges = {}
        for n, v in zip(names, row, strict=True):
            if v is None or v[0] is None:
                edges[n] = [0.0] * (self.n_bins + 1)
            elif self.strategy == "uniform":
                width = (v[-1] - v[0]) / self.n_bins
                edges[n] = [v[0] + i * width for i in range(self.n_bins)] + [v[-1]]
            else:
                edges[n] = list(v)
        return {"edges": edges}

    def _bin(self, name: str) -> Column:
        x, made = double(name), None
        for i, e in enumerate(self.state["edges"][name][1:-1]):
            made = F.when(x < F.lit(e), F.lit(i)) if made is None else made.when(x < F.lit(e), F.lit(i))
        return F.when(x.isNotNull(), made.otherwise(F.lit(self.n_bins - 1))).cast("long")

    def _transform(self, df: DataFrame) -> DataFrame:
        require(df, *self.columns)
        if self.encode == "ordinal":
            return df.select(*[(self._bin(c) if c in self.columns else col(c)).alias(c) for c in df.columns])
        hot = [F.coalesce((self._bin(c) == i).cast("long"), F.lit(0).cast("long")).alias(f"{c}_bin{i}") for c in self.columns for i in range(self.n_bins)]
        return df.select(*[col(c) for c in df.columns if c not in self.columns], *hot)

    @property
    def bins(self) -> dict[str, list[float]]:
        return dict(self.state["edges"])
