"""Windows over a whole frame, without one task seeing all of it.

A window without partitions would be one task. Here rows are cut into buckets of
consecutive positions. For frames of bounded width, each bucket borrows the few
rows beside it (its halo). For frames from the beginning, each bucket starts
from a summary of those before it; summaries are one row a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..columns import col, fresh

BUCKET = 1 << 17


def bounded(df: DataFrame, row: str, before: int, after: int, outputs: dict[str, Callable[[object], Column]], bucket: int | None = None) -> DataFrame:
    """``df`` with new columns over the rows from ``before`` rows back to ``after`` rows ahead.

    outputs: name -> function of a window. ``row`` is dense from 0.
    """
    size = bucket or max(BUCKET, 4 * (before + after))
    size = max(size, before, after, 1)
    home = F.floor(col(row) / F.lit(size)).cast("long")
    place = F.pmod(col(row), F.lit(size))
    lent = [home]
    if before:
        lent.append(F.when(place >= size - before, home + 1))
    if after:
        lent.append(F.when(place < after, home - 1))
    name = fresh(df, "_bucket")
    dealt = df.withColumn(name, F.explode(F.array_compact(F.array(*lent))))
    w = W.partitionBy(col(name)).orderBy(col(row)).rowsBetween(-before, after)
    out = dealt.select("*", *[f(w).alias(n) for n, f in outputs.items()])
    return out.filter(col(name) == home).drop(name)


#: kind -> (aggregate, how what came before and the value since then combine).
_KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


#: Buckets are carried over in groups of so many, and the groups over one another: no task sees one row for each bucket.
GROUP = 1 << 12


def from_start(df: DataFrame, row: str, outputs: dict[str, tuple[str, Column]], descending: bool = False, bucket: int = BUCKET, group: int = GROUP) -> DataFrame:
    """``df`` with new columns over all rows up to the current one (from it on, if ``descending``).

    outputs: name -> (kind, column). Kinds are sum, count, min, max and last,
    all over what is not null. Each bucket is summed up in one row; what came
    before it is that of the buckets before in its group of ``group`` buckets, and
    that of the groups before, of which there is one row each. ``row`` is dense from 0.
    """
    size = len(outputs)
    home_name, group_name = fresh(df, "_bucket"), fresh(df, "_group")
    x, v, s, c, g = ([fresh(df, f"_{letter}{k}") for k in range(size)] for letter in "xvscg")
    home = F.floor(col(row) / F.lit(bucket)).cast("long")
    key = (-col(row)) if descending else col(row)
    dealt = df.select("*", home.alias(home_name), *[e.alias(x[k]) for k, (_, e) in enumerate(outputs.values())])
    inner = W.partitionBy(col(home_name)).orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    place = -col(home_name) if descending else col(home_name)
    within = W.partitionBy(col(group_name)).orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    over = W.orderBy(-col(group_name) if descending else col(group_name)).rowsBetween(W.unboundedPreceding, -1)
    kinds = [kind for kind, _ in outputs.values()]
    again = [F.sum if kind == "count" else _KINDS[kind][0] for kind in kinds]
    values = [_KINDS[kind][0](col(x[k])).over(inner).alias(v[k]) for k, kind in enumerate(kinds)]

    def summed(kind: str, name: str, by: Column) -> Column:
        return F.max_by(col(name), F.when(col(name).isNotNull(), by)) if kind == "last" else (F.sum if kind == "count" and name in s else _KINDS[kind][0])(col(name))

    buckets = dealt.groupBy(col(home_name)).agg(*[summed(kind, x[k], key).alias(s[k]) for k, kind in enumerate(kinds)])
    buckets = buckets.withColumn(group_name, F.floor(col(home_name) / F.lit(group)).cast("long"))
    groups = buckets.groupBy(col(group_name)).agg(*[summed(kind, s[k], place).alias(g[k]) for k, kind in enumerate(kinds)])
    groups = groups.select(col(group_name), *[again[k](col(g[k])).over(over).alias(g[k]) for k in range(size)])
    carried = buckets.select(col(home_name), col(group_name), *[again[k](col(s[k])).over(within).alias(c[k]) for k in range(size)])
    before = carried.join(groups, group_name).select(col(home_name), *[_KINDS[kind][1](col(g[k]), col(c[k])).alias(c[k]) for k, kind in enumerate(kinds)])
    new = {name: _KINDS[kind][1](col(c[k]), col(v[k])) for k, (name, (kind, _)) in enumerate(outputs.items())}
    out = dealt.select("*", *values).join(before, home_name)
    return out.select(*[col(n) for n in df.columns if n not in new], *[e.alias(n) for n, e in new.items()])
