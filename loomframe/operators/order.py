"""Sorting, with nulls last unless told otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import col, require
from ..errors import InvalidArgument
from ..rows import ROW, with_row_id


def _keys(df: DataFrame, names: Sequence[str], ascending: Sequence[bool], nulls_first: bool) -> list[Column]:
    require(df, *names)
    if len(names) != len(ascending) or not names:
        raise InvalidArgument("give one direction for each column, and at least one column")
    made = []
    for n, up in zip(names, ascending, strict=True):
        c = col(n)
        if nulls_first:
            made.append(c.asc_nulls_first() if up else c.desc_nulls_first())
        else:
            made.append(c.asc_nulls_last() if up else c.desc_nulls_last())
    return made


def sort(df: DataFrame, name: str, ascending: bool = True, nulls_first: bool = False) -> DataFrame:
    return sort_multi(df, [name], [ascending], nulls_first)


def sort_multi(df: DataFrame, names: Sequence[str], ascending: Sequence[bool], nulls_first: bool = False) -> DataFrame:
    """Sorted by several columns. Rows that tie keep their order if the frame has a ``_row`` column."""
    stable = [col(ROW).asc()] if ROW in df.columns else []
    return df.orderBy(*_keys(df, names, ascending, nulls_first), *stable)


def top_k(df: DataFrame, k: int, names: Sequence[str], ascending: Sequence[bool], nulls_first: bool = False) -> DataFrame:
    """The first ``k`` rows of a sort; each task keeps ``k`` rows and no more."""
    return sort_multi(df, names, ascending, nulls_first).limit(k)


def sort_index(df: DataFrame, label_col: str, ascending: bool = True) -> DataFrame:
    return sort(df, label_col, ascending)


def argsort(df: DataFrame, name: str, ascending: bool = True, order_by=None) -> DataFrame:
    """``rank`` and ``position``: where the row of each rank stands in the order given; rows that tie keep their order."""
    rows = with_row_id(df, order_by).select(col(name).alias("_v"), col(ROW).alias("position"))
    key = F.col("_v").asc_nulls_last() if ascending else F.col("_v").desc_nulls_last()
    return with_row_id(rows, [key, F.col("position")], "rank").select("rank", "position")
