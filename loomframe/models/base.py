"""What models share: features, checks, predictions as a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import col, double, numeric_columns, require
from ..errors import InvalidArgument, NotFitted

PREDICTION = "prediction"


class Model:
    """``fit(df, target)`` learns from the numeric columns, or those named; ``predict(df)`` adds ``prediction``.

    A null feature is 0; a null target is an error.
    """

    def __init__(self, features: Sequence[str] | None = None) -> None:
        self.features = features
        self.names: list[str] | None = None

    def _choose(self, df: DataFrame, target: str | None) -> list[str]:
        names = list(self.features or numeric_columns(df, [target] if target else []))
        require(df, *names, *([target] if target else []))
        if not names:
            raise InvalidArgument("there are no numeric features")
        if target and not df.filter(col(target).isNull()).isEmpty():
            raise InvalidArgument(f"the target {target!r} has nulls")
        self.names = names
        return names

    def _fitted(self) -> list[str]:
        if self.names is None:
            raise NotFitted(f"{type(self).__name__} is not fitted")
        return self.names


def feature(name: str) -> Column:
    return F.coalesce(double(name), F.lit(0.0))


def assembled(df: DataFrame, names: Sequence[str], out: str = "_features") -> DataFrame:
    """A vector column for Spark's own learners."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(out, array_to_vector(F.array(*[feature(n) for n in names])))
