"""Aggregates of whole frames and of groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import col, double, numeric_or_given, require
from ..errors import InvalidArgument
from ..plans.quantiles import grouped_quantiles, is_large, quantiles
from ..rows import order_columns

# --- whole frames ---------------------------------------------------------


def _all(df: DataFrame, names: Sequence[str]) -> list[str]:
    require(df, *names)
    return list(names) or df.columns


def _one_row(df: DataFrame, names: Sequence[str], f: Callable[[str], Column], skipna: bool = True) -> DataFrame:
    def made(n: str) -> Column:
        whole = f(n) if skipna else F.when(F.count(F.when(col(n).isNull(), 1)) == 0, f(n))
        return whole.alias(n)

    return df.agg(*[made(n) for n in names])


def frame_sum(df: DataFrame, *names: str, skipna: bool = True) -> DataFrame:
    """Sums as doubles; 0 where there is no value."""
    return _one_row(df, numeric_or_given(df, names), lambda n: F.coalesce(F.sum(double(n)), F.lit(0.0)), skipna)


def frame_mean(df: DataFrame, *names: str, skipna: bool = True) -> DataFrame:
    return _one_row(df, numeric_or_given(df, names), lambda n: F.avg(col(n)), skipna)


def frame_median(df: DataFrame, *names: str, skipna: bool = True) -> DataFrame:
    found = quantiles(df, numeric_or_given(df, names), [0.5])
    return _one_row(df, list(found), lambda n: F.max(F.lit(found[n][0]).cast("double")), skipna)


def frame_std(df: DataFrame, *names: str, skipna: bool = True) -> DataFrame:
    return _one_row(df, numeric_or_given(df, names), lambda n: F.stddev_samp(col(n)), skipna)


def frame_var(df: DataFrame, *names: str, skipna: bool = True) -> DataFrame:
    return _one_row(df, numeric_or_given(df, names), lambda n: F.var_samp(col(n)), skipna)


def frame_min(df: DataFrame, *names: str, skipna: bool = True) -> DataFrame:
    return _one_row(df, _all(df, names), lambda n: F.min(col(n)), skipna)


def frame_max(df: DataFrame, *names: str, skipna: bool = True) -> DataFrame:
    return _one_row(df, _all(df, names), lambda n: F.max(col(n)), skipna)


def frame_count(df: DataFrame, *names: str) -> DataFrame:
    """Values that are not null."""
    return _one_row(df, _all(df, names), lambda n: F.count(col(n)))


def quantile(df: DataFrame, q: float, *names: str) -> DataFrame:
    """Exact quantiles with linear interpolation."""
    if not 0 <= q <= 1:
        raise InvalidArgument(f"a quantile is between 0 and 1, not {q}")
    found = quantiles(df, numeric_or_given(df, names), [q])
    return df.sparkSession.createDataFrame([tuple(v[0] for v in found.values())], ", ".join(f"`{n}` double" for n in found))


def describe(df: DataFrame, *names: str) -> DataFrame:
    """One row for each numeric column: column, count, mean, std, min, p25, p50, p75, max."""
    columns = numeric_or_given(df, names)
    if not columns:
        raise InvalidArgument("there is no numeric column to describe")

    found = quantiles(df, columns, [0.25, 0.5, 0.75])

    def stats(n: str) -> Column:
        x = double(n)
        q = [F.lit(v).cast("double") for v in found[n]]
        return F.struct(
            F.lit(n).alias("column"), F.count(x).cast("double").alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), F.max(x).alias("max"),
        )

    return df.agg(F.array(*[stats(n) for n in columns]).alias("rows")).select(F.inline("rows"))


# --- groups ---------------------------------------------------------------

#: name -> aggregate of a column; first and last also take the order.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.sum(c.cast("double")),
    "mean": F.avg,
    "median": F.median,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "size": lambda c: F.count(F.lit(1)),
}
ORDERED = {"first": F.min_by, "last": F.max_by}


def aggregate_names() -> list[str]:
    return [*AGGREGATES, *ORDERED]


class GroupBy:
    """Groups of rows that agree in the key columns; a null key is a group of its own."""

    def __init__(self, df: DataFrame, *keys: str) -> None:
        if not keys:
            raise InvalidArgument("group by at least one column")
        require(df, *keys)
        self.df, self.keys = df, list(keys)

    def _aggregate(self, name: str, f: str, order_by) -> Column:
        require(self.df, name)
        if f in AGGREGATES:
            return AGGREGATES[f](col(name))
        if f in ORDERED:
            order = order_columns(self.df, order_by)
            key = order[0] if len(order) == 1 else F.struct(*order)
            return ORDERED[f](col(name), F.when(col(name).isNotNull(), key))
        raise InvalidArgument(f"no aggregate {f!r}; there are {aggregate_names()}")

    def agg(self, functions: dict[str, str], order_by=None) -> DataFrame:
        """One aggregate for each column, under the column's name."""
        if set(functions) & set(self.keys):
            raise InvalidArgument("a key can't be aggregated under its own name: use agg_multiple")
        return self._made([(c, f, c) for c, f in functions.items()], order_by)

    def agg_multiple(self, functions: dict[str, Sequence[str]], order_by=None) -> DataFrame:
        """Several aggregates for each column, named ``column_aggregate``."""
        return self._made([(c, f, f"{c}_{f}") for c, fs in functions.items() for f in fs], order_by)

    def _made(self, wanted: list[tuple[str, str, str]], order_by) -> DataFrame:
        """(column, aggregate, name) for each aggregate. Spark's median holds a group's distinct values in one task, so those of large inputs are found by counting."""
        apart = [w for w in wanted if w[1] == "median"] if is_large(self.df) else []
        out = self._grouped().agg(*[self._aggregate(c, f, order_by).alias(n) for c, f, n in wanted if (c, f, n) not in apart] or [F.count(F.lit(1)).alias("_rows")])
        for c, f, n in apart:
            require(self.df, c)
            found = grouped_quantiles(self.df, self.keys, c, [0.5]).withColumnRenamed("q0", n)
            on = F.lit(True)
            for k in self.keys:
                on = on & out[f"`{k}`"].eqNullSafe(found[f"`{k}`"])
            out = out.join(found, on, "left").select(*[out[f"`{c}`"] for c in out.columns], found[f"`{n}`"])
        return out.select(*[col(k) for k in self.keys], *[col(n) for _, _, n in wanted])

    def apply(self, f: Callable | Column, kind: str = "double") -> DataFrame:
        """One value for each group, in the column ``result``.

        An aggregate expression stays in Spark. A function of the group's pandas
        frame is the slow path: it needs a whole group in one worker's memory.
        """
        if isinstance(f, Column):
            return self._grouped().agg(f.alias("result"))
        import pandas as pd
        from pyspark.sql import types as T

        fields = [self.df.schema[k] for k in self.keys]
        schema = T.StructType([*fields, T.StructField("result", T._parse_datatype_string(kind))])

        names = [*self.keys, "result"]  # not self, which a worker can't have

        def one(key, frame):
            return pd.DataFrame([[*key, f(frame)]], columns=names)

        return self._grouped().applyInPandas(one, schema)

    def size(self) -> DataFrame:
        """Rows in each group, in the column ``size``."""
        return self._grouped().agg(F.count(F.lit(1)).alias("size"))

    def count(self) -> DataFrame:
        """Values that are not null, for every column that is no key."""
        rest = [c for c in self.df.columns if c not in self.keys]
        return self._grouped().agg(*[F.count(col(c)).alias(c) for c in rest])

    def _grouped(self):
        return self.df.groupBy(*[col(k) for k in self.keys])


def group_by(df: DataFrame, *keys: str) -> GroupBy:
    return GroupBy(df, *keys)
