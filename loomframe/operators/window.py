"""Rolling, expanding and exponentially weighted windows in row order.

With ``partition_by`` a window runs within each partition. Without it, it runs
over the whole frame, cut into buckets so that no task sees all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..columns import col, double, require
from ..errors import InvalidArgument
from ..plans import halo
from ..rows import ROW, order_columns, with_row_id

_AGG: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "min": F.min, "max": F.max}
#: Weights below this share are beyond a double's precision.
_LEAST = 1e-17


class Window:
    """A window; its methods give the frame with a column ``{name}_{function}`` more."""

    def __init__(self, df: DataFrame, order_by, partition_by: Sequence[str], min_periods: int) -> None:
        require(df, *partition_by)
        self.df, self.order_by, self.partition_by, self.min_periods = df, order_by, list(partition_by), min_periods
        if not partition_by or order_by is None:
            order_columns(df, order_by)  # raises without any order

    def mean(self, name: str) -> DataFrame:
        return self._make(name, "mean")

    def sum(self, name: str) -> DataFrame:
        return self._make(name, "sum")

    def std(self, name: str) -> DataFrame:
        return self._make(name, "std")

    def min(self, name: str) -> DataFrame:
        return self._make(name, "min")

    def max(self, name: str) -> DataFrame:
        return self._make(name, "max")

    def _value(self, x: Column, f: str) -> Callable[[object], Column]:
        """The aggregate over a window where enough values are not null."""

        def made(w) -> Column:
            value = _AGG[f](x).over(w)
            if f == "sum" and self.min_periods == 0:
                value = F.coalesce(value, F.lit(0.0))
            return F.when(F.count(x).over(w) >= self.min_periods, value)

        return made

    def _make(self, name: str, f: str) -> DataFrame:
        raise NotImplementedError

    def _partitioned(self):
        return W.partitionBy(*[col(p) for p in self.partition_by]).orderBy(*order_columns(self.df, self.order_by))

    def _with_rows(self) -> tuple[DataFrame, bool]:
        """The frame with dense positions, and whether they were added."""
        added = self.order_by is not None or ROW not in self.df.columns
        return with_row_id(self.df, self.order_by), added


class Rolling(Window):
    """The last ``size`` rows up to the current one, or as many around it."""

    def __init__(self, df: DataFrame, size: int, min_periods: int | None, center: bool, order_by, partition_by: Sequence[str]) -> None:
        if size < 1:
            raise InvalidArgument("a window has at least one row")
        super().__init__(df, order_by, partition_by, size if min_periods is None else min_periods)
        self.before, self.after = (size // 2, size // 2) if center else (size - 1, 0)

    def _make(self, name: str, f: str) -> DataFrame:
        require(self.df, name)
        value, out = self._value(double(name), f), f"{name}_{f}"
        if self.partition_by:
            return self.df.withColumn(out, value(self._partitioned().rowsBetween(-self.before, self.after)))
        rows, added = self._with_rows()
        made = halo.bounded(rows, ROW, self.before, self.after, {out: value})
        return made.drop(ROW) if added else made


class Expanding(Window):
    """All rows from the first to the current one."""

    def _make(self, name: str, f: str) -> DataFrame:
        require(self.df, name)
        x, out = double(name), f"{name}_{f}"
        if self.partition_by:
            w = self._partitioned().rowsBetween(W.unboundedPreceding, 0)
            return self.df.withColumn(out, self._value(x, f)(w))
        rows, added = self._with_rows()
        parts: dict[str, tuple[str, Column]] = {"_n": ("count", x)}
        if f in ("min", "max"):
            parts["_v"] = (f, x)
        else:
            # Sums are taken about the mean, lest squares cancel.
            middle = rows.agg(F.avg(x)).first()[0] or 0.0 if f == "std" else 0.0
            y = x - F.lit(middle)
            parts["_v"] = ("sum", y)
            if f == "std":
                parts["_q"] = ("sum", y * y)
        made = halo.from_start(rows, ROW, parts)
        n, v = F.col("_n"), F.col("_v")
        if f == "mean":
            v = v / F.nullif(n, F.lit(0))
        elif f == "sum" and self.min_periods == 0:
            v = F.coalesce(v, F.lit(0.0))
        elif f == "std":
            v = F.when(n > 1, F.sqrt(F.greatest(F.col("_q") - v * v / n, F.lit(0.0)) / (n - 1)))
        made = made.withColumn(out, F.when(n >= self.min_periods, v)).drop(*parts)
        return made.drop(ROW) if added else made


class EWM(Window):
    """Weights that fall by 1 - alpha with each value before: y = alpha x + (1 - alpha) y, from the first value on.

    Nulls are passed over and take the value before. Mean is exponentially
    weighted; the other functions are plain and expanding.
    """

    def __init__(self, df: DataFrame, alpha: float, order_by, partition_by: Sequence[str]) -> None:
        super().__init__(df, order_by, partition_by, 1)
        self.alpha = alpha if 0 < alpha < 1 else 0.5

    def _fold(self, values: Column) -> Column:
        """The recursion over values in order, the first as its start."""
        a = F.lit(self.alpha)
        return F.aggregate(F.slice(values, F.lit(2), F.size(values)), F.get(values, F.lit(0)), lambda y, x: a * x + (1 - a) * y)

    def _make(self, name: str, f: str) -> DataFrame:
        require(self.df, name)
        if f != "mean":
            return Expanding(self.df, self.order_by, self.partition_by, 1)._make(name, f)
        reach = math.ceil(math.log(_LEAST) / math.log(1 - self.alpha))
        out, x = f"{name}_mean", double(name)
        if self.partition_by:
            # Positions among the values that are not null; a window by range of those reaches back far enough.
            order = self._partitioned()
            counted = self.df.withColumn("_c", F.count(x).over(order.rowsBetween(W.unboundedPreceding, 0)))
            back = W.partitionBy(*[col(p) for p in self.partition_by]).orderBy("_c").rangeBetween(-reach, 0)
            listed = counted.withColumn("_l", F.collect_list(x).over(back))  # in order, nulls left out; named, so that it is made once
            return listed.withColumn(out, F.when(F.col("_c") > 0, self._fold(F.col("_l")))).drop("_c", "_l")
        rows, added = self._with_rows()
        known = with_row_id(rows.filter(x.isNotNull()).select(col(ROW).alias("_at"), x.alias("_x")), "_at", "_c")
        listed = halo.bounded(known, "_c", reach, 0, {"_l": lambda w: F.collect_list("_x").over(w)})
        made = rows.join(listed.select(F.col("_at").alias(ROW), self._fold(F.col("_l")).alias("_y")), ROW, "left")
        made = halo.from_start(made, ROW, {out: ("last", F.col("_y"))}).drop("_y")
        made = made.select(*[col(c) for c in rows.columns], col(out))
        return made.drop(ROW) if added else made


def rolling(df: DataFrame, size: int, min_periods: int | None = None, center: bool = False, order_by=None, partition_by: Sequence[str] = ()) -> Rolling:
    """A window of ``size`` rows. A centred one has ``size // 2`` rows on either side."""
    return Rolling(df, size, min_periods, center, order_by, partition_by)


def expanding(df: DataFrame, min_periods: int = 1, order_by=None, partition_by: Sequence[str] = ()) -> Expanding:
    return Expanding(df, order_by, partition_by, min_periods)


def ewm(df: DataFrame, alpha: float, order_by=None, partition_by: Sequence[str] = ()) -> EWM:
    return EWM(df, alpha, order_by, partition_by)
