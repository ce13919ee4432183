"""K-means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..errors import InvalidArgument
from .base import PREDICTION, Model, assembled


class KMeans(Model):
    """Lloyd's algorithm from k-means|| (k-means++ over all executors) or random centres."""

    def __init__(self, k: int = 3, max_iter: int = 300, init: str = "k-means++", seed: int = 0, tol: float = 1e-4, features: Sequence[str] | None = None) -> None:
        super().__init__(features)
        if k < 1 or init not in ("k-means++", "random"):
            raise InvalidArgument("k is at least 1, and init is k-means++ or random")
        self.k, self.max_iter, self.init, self.seed, self.tol = k, max_iter, init, seed, tol

    def fit(self, df: DataFrame, target: None = None):
        from pyspark.ml.clustering import KMeans as Learner

        names = self._choose(df, None)
        if len(df.limit(self.k).collect()) < self.k:
            raise InvalidArgument(f"there are fewer rows than {self.k} clusters")
        x = assembled(df, names).select("_features").persist()
        learner = Learner(featuresCol="_features", k=max(2, self.k), maxIter=self.max_iter, seed=self.seed, tol=self.tol, initMode="random" if self.init == "random" else "k-means||")
        try:
            if self.k == 1:
                from pyspark.sql import functions as F

                from ..plans.gram import gram
                from .base import feature

                g = gram(df, {n: feature(n) for n in names})
                self.centers_, self.inertia, self.n_iter = [g.means], float(g.products.trace()), 1
            else:
                model = learner.fit(x)
                self.centers_, self.inertia, self.n_iter = model.clusterCenters(), float(model.summary.trainingCost), model.summary.numIter
        finally:
            x.unpersist()
        return self

    @property
    def centers(self) -> list[dict[str, float]]:
        return [dict(zip(self._fitted(), map(float, c), strict=True)) for c in self.centers_]

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``, the number of the nearest centre; of two as near the smaller. An expression, no join."""
        from pyspark.sql import functions as F

        from .base import feature

        names = self._fitted()
        distances = []
        for i, c in enumerate(self.centers_):
            d = F.lit(0.0)
            for n, v in zip(names, c, strict=True):
                d = d + (feature(n) - F.lit(float(v))) * (feature(n) - F.lit(float(v)))
            distances.append(F.struct(d.alias("d"), F.lit(i).alias("i")))
        return df.withColumn(PREDICTION, F.array_min(F.array(*distances))["i"])

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).predict(df)
