"""Linear models. Least squares, ridge and lasso need the data once, as sums of products; the rest is small algebra."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import col, double, require
from ..errors import InvalidArgument
from ..plans.gram import Gram, gram
from .base import PREDICTION, Model, assembled, feature
from .metrics import r2_score


class _Linear(Model):
    fit_intercept: bool

    def fit(self, df: DataFrame, target: str):
        names = self._choose(df, target)
        g = gram(df, {**{n: feature(n) for n in names}, "\0target": double(target)})
        if g.n == 0:
            raise InvalidArgument("there are no rows to fit")
        xx, xy, means = g.products[:-1, :-1], g.products[:-1, -1], g.means
        if not self.fit_intercept:
            xx, xy = xx + g.n * np.outer(means[:-1], means[:-1]), xy + g.n * means[:-1] * means[-1]
        self.coef_ = self._solve(xx, xy, g)
        self.intercept_ = float(means[-1] - means[:-1] @ self.coef_) if self.fit_intercept else 0.0
        return self

    def _solve(self, xx: np.ndarray, xy: np.ndarray, g: Gram) -> np.ndarray:
        raise NotImplementedError

    def _value(self) -> Column:
        value = F.lit(self.intercept_)
        for n, b in zip(self._fitted(), self.coef_, strict=True):
            value = value + F.lit(float(b)) * feature(n)
        return value

    def predict(self, df: DataFrame) -> DataFrame:
        require(df, *self._fitted())
        return df.withColumn(PREDICTION, self._value())

    @property
    def coef(self) -> dict[str, float]:
        return {n: float(b) for n, b in zip(self._fitted(), self.coef_, strict=True)}

    @property
    def intercept(self) -> float:
        self._fitted()
        return self.intercept_

    def score(self, df: DataFrame, target: str) -> float:
        """The coefficient of determination."""
        return r2_score(self.predict(df), target, PREDICTION)


class LinearRegression(_Linear):
    """Least squares; singular features are an error."""

    def __init__(self, fit_intercept: bool = True, features: Sequence[str] | None = None) -> None:
        super().__init__(features)
        self.fit_intercept = fit_intercept

    def _solve(self, xx: np.ndarray, xy: np.ndarray, g: Gram) -> np.ndarray:
        scale = np.sqrt(np.diag(xx))
        if (scale == 0).any() or np.linalg.matrix_rank(xx / np.outer(scale, scale), tol=1e-10) < len(xx):
            raise InvalidArgument("the features are linearly dependent")
        return np.linalg.solve(xx, xy)


class Ridge(_Linear):
    """Least squares with ``alpha`` times the squared coefficients added; the intercept is free."""

    def __init__(self, alpha: float = 1.0, fit_intercept: bool = True, features: Sequence[str] | None = None) -> None:
        super().__init__(features)
        if alpha < 0:
            raise InvalidArgument("alpha is not negative")
        self.alpha, self.fit_intercept = alpha, fit_intercept

    def _solve(self, xx: np.ndarray, xy: np.ndarray, g: Gram) -> np.ndarray:
        try:
            return np.linalg.solve(xx + self.alpha * np.eye(len(xx)), xy)
        except np.linalg.LinAlgError as e:
            raise InvalidArgument("the features are linearly dependent") from e


class Lasso(_Linear):
    """Least squares with absolute coefficients, on features scaled by their population deviation; lambda is alpha / n.

    Coordinate descent runs on the sums of products alone.
    """

    def __init__(self, alpha: float = 1.0, max_iter: int = 1000, fit_intercept: bool = True, tol: float = 1e-4, features: Sequence[str] | None = None) -> None:
        super().__init__(features)
        self.alpha, self.max_iter, self.fit_intercept, self.tol = alpha, max_iter, fit_intercept, tol
        self.n_iter = 0

    def _solve(self, xx: np.ndarray, xy: np.ndarray, g: Gram) -> np.ndarray:
        scale = np.sqrt(np.diag(xx) / g.n)
        use = scale > 0
        s = np.where(use, scale, 1.0)
        a, c = xx / np.outer(s, s), xy / s
        b = np.zeros(len(c))
        for self.n_iter in range(1, self.max_iter + 1):
            most = 0.0
            for j in np.flatnonzero(use):
                rho = c[j] - a[j] @ b + a[j, j] * b[j]
                new = np.sign(rho) * max(abs(rho) - self.alpha, 0.0) / a[j, j]
                most, b[j] = max(most, abs(new - b[j])), new
            if most < self.tol:
                break
        return b / s


class LogisticRegression(Model):
    """Two classes, sorted; the larger is the positive one. Converged by Spark's own solver.

    penalty l2, l1 or none; ``C`` is the inverse of its strength.
    """

    def __init__(self, penalty: str = "l2", C: float = 1.0, max_iter: int = 100, features: Sequence[str] | None = None) -> None:
        super().__init__(features)
        if penalty not in ("l1", "l2", "none") or C <= 0:
            raise InvalidArgument("penalty is l1, l2 or none, and C is positive")
        self.penalty, self.C, self.max_iter = penalty, C, max_iter

    def fit(self, df: DataFrame, target: str):
        from pyspark.ml.classification import LogisticRegression as Solver

        names = self._choose(df, target)
        found = [r[0] for r in df.select(col(target)).distinct().limit(3).collect()]
        if len(found) != 2:
            raise InvalidArgument(f"the target has {len(found) if len(found) < 3 else 'more than two'} classes, not two")
        self.classes_ = sorted(found)
        n = df.count()
        labelled = assembled(df, names).select("_features", (col(target) == F.lit(self.classes_[1])).cast("double").alias("_label"))
        strength = 0.0 if self.penalty == "none" else 1 / (self.C * n)
        solver = Solver(featuresCol="_features", labelCol="_label", maxIter=self.max_iter, regParam=strength, elasticNetParam=float(self.penalty == "l1"), standardization=False)
        labelled.persist()
        try:
            model = solver.fit(labelled)
        finally:
            labelled.unpersist()
        self.coef_, self.intercept_ = model.coefficients.toArray(), float(model.intercept)
        self.n_iter = model.summary.totalIterations
        return self

    def _probability(self) -> Column:
        z = F.lit(self.intercept_)
        for n, b in zip(self._fitted(), self.coef_, strict=True):
            z = z + F.lit(float(b)) * feature(n)
        return 1 / (1 + F.exp(-z))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Adds ``probability_0`` and ``probability_1``, of the smaller and the larger class."""
        p = self._probability()
        return df.withColumns({"probability_0": 1 - p, "probability_1": p})

    def predict(self, df: DataFrame) -> DataFrame:
        require(df, *self._fitted())
        low, high = (F.lit(c) for c in self.classes_)
        return df.withColumn(PREDICTION, F.when(self._probability() >= 0.5, high).otherwise(low))

    @property
    def classes(self) -> list:
        return list(self.classes_)

    @property
    def coef(self) -> dict[str, float]:
        return {n: float(b) for n, b in zip(self._fitted(), self.coef_, strict=True)}

    @property
    def intercept(self) -> float:
        return self.intercept_
