"""Principal components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import require
from ..errors import InvalidArgument
from ..plans.gram import gram
from .base import Model, feature


class PCA(Model):
    """Eigenvectors of the covariance (by 1/n) of centred features, largest first. A component's largest loading is positive."""

    def __init__(self, n: int = 2, features: Sequence[str] | None = None) -> None:
        super().__init__(features)
        if n < 1:
            raise InvalidArgument("there is at least one component")
        self.n = n

    def fit(self, df: DataFrame, target: None = None):
        names = self._choose(df, None)
        if self.n > len(names):
            raise InvalidArgument(f"{self.n} components of {len(names)} features")
        g = gram(df, {n: feature(n) for n in names})
        if not g.n:
            raise InvalidArgument("there are no rows to fit")
        values, vectors = np.linalg.eigh(g.products / g.n)
        order = np.argsort(-values, kind="stable")
        values, vectors = np.maximum(values[order], 0), vectors[:, order].T
        signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
        self.means_ = g.means
        self.components = (vectors * signs[:, None])[: self.n]
        self.explained_variance = values[: self.n]
        self.explained_variance_ratio = values[: self.n] / values.sum() if values.sum() else np.zeros(self.n)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """The columns PC1, PC2, ... beside those of ``df``."""
        names = self._fitted()
        require(df, *names)
        made = {}
        for k, c in enumerate(self.components):
            value = F.lit(0.0)
            for n, m, w in zip(names, self.means_, c, strict=True):
                value = value + (feature(n) - F.lit(float(m))) * F.lit(float(w))
            made[f"PC{k + 1}"] = value
        return df.withColumns(made)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)
