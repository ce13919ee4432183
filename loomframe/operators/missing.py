"""Missing values: dropping, filling, interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import col, fresh, numeric_columns, require
from ..errors import InvalidArgument
from ..plans import halo
from ..rows import ROW, order_columns, with_row_id


def dropna(df: DataFrame, how: str = "any", thresh: int | None = None, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without nulls (any), or not null throughout (all), or with at least ``thresh`` values. NaN is a value."""
    if how not in ("any", "all"):
        raise InvalidArgument(f"how is any or all, not {how!r}")
    names = list(subset or df.columns)
    require(df, *names)
    if thresh is None and how == "any":
        kept = [col(n).isNotNull() for n in names]
        out = df
        for k in kept:
            out = out.filter(k)  # one filter each, so that all reach the scan
        return out
    values = sum((col(n).isNotNull().cast("int") for n in names), F.lit(0))
    return df.filter(values >= (1 if thresh is None else thresh))


def _fits(kind: T.DataType, value) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, int | float):
        return isinstance(kind, T.NumericType)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return True


def _filled(df: DataFrame, name: str, value) -> Column:
    kind = df.schema[name].dataType
    if isinstance(value, float) and not value.is_integer() and isinstance(kind, T.IntegralType):
        return F.coalesce(col(name).cast("double"), F.lit(value))
    return F.coalesce(col(name), F.lit(value).cast(kind))


def fillna(df: DataFrame, value) -> DataFrame:
    """Nulls replaced in every column whose type the value fits."""
    return fillna_dict(df, {f.name: value for f in df.schema.fields if _fits(f.dataType, value)})


def fillna_column(df: DataFrame, name: str, value) -> DataFrame:
    require(df, name)
    return fillna_dict(df, {name: value})


def fillna_dict(df: DataFrame, values: dict) -> DataFrame:
    """Nulls replaced column by column; unknown columns are ignored."""
    return df.select(*[(_filled(df, c, values[c]) if c in values else col(c)).alias(c) for c in df.columns])


def isna(df: DataFrame) -> DataFrame:
    return df.select(*[col(c).isNull().alias(c) for c in df.columns])


def notna(df: DataFrame) -> DataFrame:
    return df.select(*[col(c).isNotNull().alias(c) for c in df.columns])


def null_count(df: DataFrame) -> DataFrame:
    """One row: the nulls in each column."""
    return df.agg(*[F.count(F.when(col(c).isNull(), 1)).alias(c) for c in df.columns])


def interpolate(
    df: DataFrame, method: str = "linear", limit: int | None = None, columns: Sequence[str] | None = None, order_by=None, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Nulls filled from the values before and after, in row order.

    linear: by position between the two; gaps at either end stay, and so do gaps
    longer than ``limit``. ffill and bfill: the value before or after, at most
    ``limit`` rows far. Columns default to all numeric ones (linear) or all.
    """
    if method not in ("linear", "ffill", "bfill"):
        raise InvalidArgument(f"method is linear, ffill or bfill, not {method!r}")
    names = list(columns) if columns else (numeric_columns(df, [ROW]) if method == "linear" else [c for c in df.columns if c != ROW])
    require(df, *names, *partition_by)
    if partition_by:
        place = fresh(df, "_place")
        order = W.partitionBy(*[col(p) for p in partition_by]).orderBy(*order_columns(df, order_by))
        rows = df.withColumn(place, F.row_number().over(order).cast("long"))
        within = W.partitionBy(*[col(p) for p in partition_by]).orderBy(place)
        back, ahead = within.rowsBetween(W.unboundedPreceding, 0), within.rowsBetween(0, W.unboundedFollowing)
        made = rows
        for i, n in enumerate(names):
            known = F.when(col(n).isNotNull(), F.struct(col(place).alias("p"), col(n).alias("v")))
            made = made.withColumns({f"_a{i}": F.last(known, True).over(back), f"_b{i}": F.first(known, True).over(ahead)})
        added = True
    else:
        place = ROW
        added = order_by is not None or ROW not in df.columns
        made = with_row_id(df, order_by)
        known = {i: F.when(col(n).isNotNull(), F.struct(col(ROW).alias("p"), col(n).alias("v"))) for i, n in enumerate(names)}
        if method != "bfill":
            made = halo.from_start(made, ROW, {f"_a{i}": ("last", k) for i, k in known.items()})
        if method != "ffill":
            made = halo.from_start(made, ROW, {f"_b{i}": ("last", k) for i, k in known.items()}, descending=True)
    filled = {}
    for i, n in enumerate(names):
        a, b, p = F.col(f"_a{i}"), F.col(f"_b{i}"), col(place)
        if method == "ffill":
            value = a["v"] if limit is None else F.when(p - a["p"] <= limit, a["v"])
        elif method == "bfill":
            value = b["v"] if limit is None else F.when(b["p"] - p <= limit, b["v"])
        else:
            part = (p - a["p"]).cast("double") / F.nullif(b["p"] - a["p"], F.lit(0))
            value = a["v"].cast("double") + part * (b["v"].cast("double") - a["v"].cast("double"))
            if limit is not None:
                value = F.when(b["p"] - a["p"] - 1 <= limit, value)
        filled[n] = F.coalesce(col(n).cast("double") if method == "linear" else col(n), value)
    out = made.select(*[filled.get(c, col(c)).alias(c) for c in df.columns if c != ROW], *([] if added else [col(ROW)]))
    return out
