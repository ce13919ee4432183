"""Joins on equal keys, with suffixes for clashing names and an indicator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import require
from ..errors import DuplicateColumn, InvalidArgument

TYPES = ("inner", "left", "right", "outer", "cross")


def join(left: DataFrame, right: DataFrame, how: str, on: str, **options) -> DataFrame:
    """:func:`merge` on one key that both sides have."""
    return merge(left, right, how, [on], [on], **options)


def merge(
    left: DataFrame, right: DataFrame, how: str, left_on: Sequence[str] = (), right_on: Sequence[str] = (),
    suffixes: tuple[str, str] = ("_left", "_right"), indicator: str | None = None,
) -> DataFrame:
    """All left columns, then the right ones but keys of the same name.

    Other names that both sides have get the suffixes. Null keys match nothing.
    A key of the same name on both sides has its value from whichever side has
    the row. ``indicator`` names a column of both, left_only or right_only.
    Which side is broadcast or shuffled is left to Spark.
    """
    if how not in TYPES:
        raise InvalidArgument(f"no join {how!r}; there are {TYPES}")
    left_on, right_on = list(left_on), list(right_on)
    if how != "cross" and (not left_on or len(left_on) != len(right_on)):
        raise InvalidArgument("a join needs as many left keys as right keys, and at least one")
    require(left, *left_on)
    require(right, *right_on)
    same = {a for a, b in zip(left_on, right_on, strict=True) if a == b} if how != "cross" else set()
    both = (set(left.columns) & set(right.columns)) - same
    lefts = [f"_l{i}" for i in range(len(left.columns))]
    rights = [f"_r{i}" for i in range(len(right.columns))]
    a, b = left.toDF(*lefts), right.toDF(*rights)
    if indicator:
        a, b = a.withColumn("_in_l", F.lit(True)), b.withColumn("_in_r", F.lit(True))
    at_l, at_r = dict(zip(left.columns, lefts, strict=True)), dict(zip(right.columns, rights, strict=True))
    if how == "cross":
        joined = a.crossJoin(b)
    else:
        on = [F.col(at_l[x]) == F.col(at_r[y]) for x, y in zip(left_on, right_on, strict=True)]
        joined = a.join(b, on, {"outer": "full"}.get(how, how))
    out: list[tuple[str, Column]] = []
    for c in left.columns:
        value = F.coalesce(F.col(at_l[c]), F.col(at_r[c])) if c in same and how in ("right", "outer") else F.col(at_l[c])
        out.append((c + suffixes[0] if c in both else c, value))
    out += [(c + suffixes[1] if c in both else c, F.col(at_r[c])) for c in right.columns if c not in same]
    if indicator:
        mark = F.when(F.col("_in_l").isNull(), "right_only").when(F.col("_in_r").isNull(), "left_only").otherwise("both")
        out.append((indicator, mark))
    names = [n for n, _ in out]
    if len(set(names)) < len(names):
        raise DuplicateColumn(f"the join would give {names}; choose other suffixes")
    return joined.select(*[v.alias(n) for n, v in out])


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """The left rows that have a match."""
    return left.join(right.select(*on), list(on), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """The left rows that have no match."""
    return left.join(right.select(*on), list(on), "left_anti")
