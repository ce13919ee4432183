"""Column names: lookup, checks, and choice of columns by type."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ColumnNotFound


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, *names: str) -> None:
    for n in names:
        if n not in df.columns:
            raise ColumnNotFound(f"no column {n!r}; there are {df.columns}")


def fresh(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column is named so, case ignored."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def numeric_columns(df: DataFrame, but: Iterable[str] = ()) -> list[str]:
    skip = set(but)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def numeric_or_given(df: DataFrame, names: Sequence[str] | None) -> list[str]:
    """The columns named, which must be there and numeric, or else all numeric ones."""
    from .errors import InvalidArgument

    if not names:
        return numeric_columns(df)
    require(df, *names)
    for n in names:
        if not isinstance(df.schema[n].dataType, T.NumericType):
            raise InvalidArgument(f"column {n!r} is not numeric")
    return list(names)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation over rows where both have values; null without spread, where Spark's own fails in ANSI mode."""
    there = a.isNotNull() & b.isNotNull()
    a, b = F.when(there, a), F.when(there, b)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def double(name: str) -> Column:
    return col(name).cast("double")
