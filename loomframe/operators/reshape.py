"""Pivot, melt, stack, unstack, transpose."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import col, require
from ..errors import DuplicateColumn, InvalidArgument
from ..rows import ROW, order_columns, with_row_id

#: More columns than this are surely a mistake.
MAX_COLUMNS = 10_000
#: Rows that a transpose takes at most, as each becomes a column.
MAX_ROWS = 10_000


def pivot(df: DataFrame, index: str, columns: str, values: str, labels: Sequence | None = None, order_by=None) -> DataFrame:
    """One row for each ``index``, one column for each label in ``columns``: the last value that is not null, in row order.

    Rows with a null index or label are left out. Labels are looked up if not
    given, sorted; given ones make the schema stable and save a pass.
    """
    require(df, index, columns, values)
    order = order_columns(df, order_by)
    key = order[0] if len(order) == 1 else F.struct(*order)
    known = df.filter(col(index).isNotNull() & col(columns).isNotNull())
    if labels is None:
        found = known.select(col(columns)).distinct().limit(MAX_COLUMNS + 1).collect()
        if len(found) > MAX_COLUMNS:
            raise InvalidArgument(f"{columns!r} has more than {MAX_COLUMNS} labels")
        labels = sorted(r[0] for r in found)
    if index in [str(x) for x in labels]:
        raise DuplicateColumn(f"a label is named like the index {index!r}")
    made = [F.max_by(F.when(col(columns) == F.lit(x), col(values)), F.when((col(columns) == F.lit(x)) & col(values).isNotNull(), key)).alias(str(x)) for x in labels]
    return known.groupBy(col(index)).agg(*made) if made else known.select(col(index)).distinct()


def unstack(df: DataFrame, row: str, column: str, value: str, labels: Sequence | None = None, order_by=None) -> DataFrame:
    return pivot(df, row, column, value, labels, order_by)


def melt(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str] = (), var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """One row for each row and value column. Columns without a common type are written as text."""
    values = list(value_vars) or [c for c in df.columns if c not in id_vars]
    require(df, *id_vars, *values)
    kinds = {type(df.schema[v].dataType) for v in values}
    number = all(isinstance(df.schema[v].dataType, T.NumericType) for v in values)
    made = df if len(kinds) == 1 or number else df.withColumns({v: col(v).cast("string") for v in values})
    return made.unpivot([col(i) for i in id_vars], [col(v) for v in values], var_name, value_name)


def stack(df: DataFrame, order_by=None) -> DataFrame:
    """``row``, ``column``, ``value`` of every cell; positions are dense from 0."""
    rows = with_row_id(df, order_by)
    cells = [c for c in df.columns if c != ROW]
    return melt(rows, [ROW], cells, "column", "value").withColumnRenamed(ROW, "row")


def transpose(df: DataFrame, order_by=None) -> DataFrame:
    """A row for each column, ``column`` and then one column for each row: ``0``, ``1``, ... For small frames."""
    cells = [c for c in df.columns if c != ROW]
    rows = with_row_id(df, order_by)
    n = rows.count()
    if n > MAX_ROWS:
        raise InvalidArgument(f"{n} rows would become columns; the most is {MAX_ROWS}")
    long = stack(rows)
    made = [F.max_by("value", F.when(F.col("row") == i, F.lit(0))).alias(str(i)) for i in range(n)]
    order = F.element_at(F.create_map(*[x for i, c in enumerate(cells) for x in (F.lit(c), F.lit(i))]), F.col("column"))
    return long.groupBy("column").agg(*made).orderBy(order) if n else df.sparkSession.createDataFrame([(c,) for c in cells], "column string")
