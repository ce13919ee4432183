"""Decision trees, grown by Spark's own learner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import col, double, require
from ..errors import InvalidArgument
from ..session import scratch_path, written
from .base import PREDICTION, Model, assembled

#: Features with more distinct values than this are not searched exactly, unless a number of bins is given.
MOST_EXACT = 1_000_000
MAX_CLASSES = 1000


class _Tree(Model):
    """bins: None looks at the threshold between any two neighbouring values of a feature; a number looks at so many quantiles.

    A node of fewer than ``min_samples`` rows is not split, however few rows the
    parts of a larger one have. Splits of a node don't depend on that rule, so the
    tree is grown without it and cut back.
    """

    def __init__(self, max_depth: int = 10, min_samples: int = 2, criterion: str = "gini", bins: int | None = None, features: Sequence[str] | None = None) -> None:
        super().__init__(features)
        if not 0 < max_depth <= 30:
            raise InvalidArgument("the depth is between 1 and 30")
        self.max_depth, self.min_samples, self.criterion, self.bins = max_depth, min_samples, criterion, bins

    def _bins(self, df: DataFrame, names: list[str]) -> int:
        if self.bins is not None:
            return self.bins
        most = max(df.agg(*[F.count_distinct(double(n)) for n in names]).first(), default=0)
        if most > MOST_EXACT:
            raise InvalidArgument(f"a feature has {most} distinct values; above {MOST_EXACT} give bins, the number of thresholds to look at")
        return max(2, most + 1)

    def _grow(self, learner, labelled: DataFrame, bins: int):
        path = scratch_path(labelled.sparkSession, "tree")
        labelled = written(labelled, "labelled")
        grown = learner.setParams(featuresCol="_features", labelCol="_label", maxDepth=self.max_depth, minInstancesPerNode=1, maxBins=bins, impurity=self.criterion, seed=0).fit(labelled)
        grown.save(path)
        nodes = labelled.sparkSession.read.parquet(f"{path}/data").collect()  # 2^31 at most by depth, and two for each row
        self._nodes = {r["id"]: r for r in nodes}
        return grown

    def _is_leaf(self, node) -> bool:
        return node["leftChild"] < 0 or node["rawCount"] < self.min_samples

    def _reached(self):
        """The nodes that are left when the tree is cut back, from the root on."""
        out, todo = [], [0]
        while todo:
            node = self._nodes[todo.pop()]
            out.append(node)
            if not self._is_leaf(node):
                todo += [node["rightChild"], node["leftChild"]]
        return out

    @property
    def feature_importances(self) -> dict[str, float]:
        """Shares of the impurity taken away; they sum to 1."""
        names = self._fitted()
        gained = dict.fromkeys(names, 0.0)
        for node in self._reached():
            if not self._is_leaf(node):
                gained[names[node["split"]["featureIndex"]]] += node["gain"] * node["rawCount"]
        whole = sum(gained.values())
        return {n: g / whole if whole else 0.0 for n, g in gained.items()}

    def _raw(self, df: DataFrame) -> Column:
        """What the leaf that a row falls in predicts."""
        names = self._fitted()
        require(df, *names)
        nodes = self._reached()
        place = {n["id"]: k for k, n in enumerate(nodes)}
        if len(nodes) == 1:
            return F.lit(float(nodes[0]["prediction"]))
        inner = [not self._is_leaf(n) for n in nodes]
        tables = {
            "feature": F.array(*[F.lit(n["split"]["featureIndex"] if i else -1) for n, i in zip(nodes, inner, strict=True)]),
            "most": F.array(*[F.lit(float(n["split"]["leftCategoriesOrThreshold"][0]) if i else 0.0) for n, i in zip(nodes, inner, strict=True)]),
            "left": F.array(*[F.lit(place[n["leftChild"]] if i else -1) for n, i in zip(nodes, inner, strict=True)]),
            "right": F.array(*[F.lit(place[n["rightChild"]] if i else -1) for n, i in zip(nodes, inner, strict=True)]),
        }
        x = F.array(*[double(n) for n in names])

        def down(at: Column, _: Column) -> Column:
            goes = F.when(F.get(x, F.get(tables["feature"], at)) <= F.get(tables["most"], at), F.get(tables["left"], at)).otherwise(F.get(tables["right"], at))
            return F.when(F.get(tables["left"], at) < 0, at).otherwise(goes)

        leaf = F.aggregate(F.sequence(F.lit(1), F.lit(self.max_depth)), F.lit(0), down)
        return F.get(F.array(*[F.lit(float(n["prediction"])) for n in nodes]), leaf)


class DecisionTreeClassifier(_Tree):
    """Classes are sorted; criterion is gini or entropy."""

    def fit(self, df: DataFrame, target: str):
        from pyspark.ml.classification import DecisionTreeClassifier as Learner

        names = self._choose(df, target)
        found = [r[0] for r in df.select(col(target)).distinct().limit(MAX_CLASSES + 1).collect()]
        if not found or len(found) > MAX_CLASSES:
            raise InvalidArgument(f"the target has no rows or more than {MAX_CLASSES} classes")
        self.classes_ = sorted(found)
        code = F.element_at(F.create_map(*[x for i, c in enumerate(self.classes_) for x in (F.lit(c), F.lit(float(i)))]), col(target))
        self.model_ = self._grow(Learner(), assembled(df, names).select("_features", code.alias("_label")), self._bins(df, names))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        label = F.element_at(F.array(*[F.lit(c) for c in self.classes_]), self._raw(df).cast("int") + 1)
        return df.withColumn(PREDICTION, label)


class DecisionTreeRegressor(_Tree):
    """Leaves are means; the criterion is the mean squared error."""

    def __init__(self, max_depth: int = 10, min_samples: int = 2, bins: int | None = None, features: Sequence[str] | None = None) -> None:
        super().__init__(max_depth, min_samples, "variance", bins, features)

    def fit(self, df: DataFrame, target: str):
        from pyspark.ml.regression import DecisionTreeRegressor as Learner

        names = self._choose(df, target)
        self.model_ = self._grow(Learner(), assembled(df, names).select("_features", double(target).alias("_label")), self._bins(df, names))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PREDICTION, self._raw(df))
