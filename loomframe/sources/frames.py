"""Frames from Python values, and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import InvalidArgument, InvalidShape


def _kind(values: Sequence) -> T.DataType:
    known = [v for v in values if v is not None]
    if not known:
        return T.StringType()
    if all(isinstance(v, bool) for v in known):
        return T.BooleanType()
    if any(isinstance(v, bool) for v in known):
        return T.StringType()
    if all(isinstance(v, int) for v in known):
        return T.LongType()
    if all(isinstance(v, int | float) for v in known):
        return T.DoubleType()
    import datetime

    if all(isinstance(v, datetime.datetime) for v in known):
        return T.TimestampType()
    return T.StringType()


def _fit(v, kind: T.DataType):
    if v is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(v)
    return str(v) if isinstance(kind, T.StringType) and not isinstance(v, str) else v


def from_columns(spark: SparkSession, data: dict[str, Sequence]) -> DataFrame:
    """A frame from values by column, all of one length; None is null."""
    lengths = {len(v) for v in data.values()}
    if len(lengths) > 1:
        raise InvalidShape(f"columns have lengths {sorted(lengths)}")
    if not data:
        raise InvalidArgument("a frame has at least one column")
    kinds = {n: _kind(v) for n, v in data.items()}
    schema = T.StructType([T.StructField(n, k) for n, k in kinds.items()])
    rows = list(zip(*[[_fit(v, kinds[n]) for v in vs] for n, vs in data.items()], strict=True))
    return spark.createDataFrame(rows, schema)


def from_records(spark: SparkSession, records: Sequence[dict]) -> DataFrame:
    """A frame from rows; keys are united in the order they first appear, and what is missing is null."""
    names = list(dict.fromkeys(k for r in records for k in r))
    return from_columns(spark, {n: [r.get(n) for r in records] for n in names})


def series(spark: SparkSession, name: str, values: Sequence, nulls: Sequence[bool] | None = None) -> DataFrame:
    """A frame of one column; where ``nulls`` is true the value is null."""
    if nulls is not None and len(nulls) != len(values):
        raise InvalidShape(f"{len(values)} values and {len(nulls)} null marks")
    marks = nulls or [False] * len(values)
    return from_columns(spark, {name: [None if n else v for v, n in zip(values, marks, strict=True)]})


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
