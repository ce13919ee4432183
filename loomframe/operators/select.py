"""Projection, selection by label and position, and derived columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import col, fresh, require
from ..errors import IndexOutOfBounds, InvalidArgument, InvalidShape, KeyNotFound
from ..rows import ROW, with_row_id


def select(df: DataFrame, *names: str) -> DataFrame:
    """The columns named, in that order; unknown names are left out."""
    return df.select(*[col(n) for n in names if n in df.columns])


def drop(df: DataFrame, *names: str) -> DataFrame:
    """All columns but those named; unknown names are ignored."""
    return df.select(*[col(c) for c in df.columns if c not in names])


def filter_rows(df: DataFrame, predicate: Column | str | Callable) -> DataFrame:
    """The rows for which the predicate is true.

    A Column or SQL text is pushed to the scan. A Python function of a pandas
    frame, giving a boolean series, is the slow path.
    """
    if isinstance(predicate, Column | str):
        return df.filter(predicate)

    def keep(frames):
        for frame in frames:
            yield frame[predicate(frame).fillna(False).astype(bool)]

    return df.mapInPandas(keep, df.schema)


def loc(df: DataFrame, labels: Sequence, label_col: str) -> DataFrame:
    """The rows with the labels given, in the order of the labels, repeats included.

    The labels are a driver's list and are broadcast; a label that no row has is KeyNotFound.
    """
    require(df, label_col)
    order = fresh(df, "_order")
    kind = df.schema[label_col].dataType
    if not labels:
        return df.limit(0)
    wanted = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(labels)], T.StructType([T.StructField(order, T.LongType()), T.StructField("_label", kind)]))
    found = df.join(F.broadcast(wanted), col(label_col) == F.col("_label"))
    have = {r[0] for r in df.filter(col(label_col).isin(list(set(labels)))).select(col(label_col)).distinct().collect()}
    missing = [v for v in labels if v not in have]
    if missing:
        raise KeyNotFound(f"no row is labelled {missing[:5]!r}")
    return found.orderBy(order).select(*[col(c) for c in df.columns])


def iloc(df: DataFrame, positions: Sequence[int], order_by=None) -> DataFrame:
    """The rows at the positions given, in that order, repeats included; a position outside is IndexOutOfBounds."""
    columns = [c for c in df.columns if c != ROW]
    rows = with_row_id(df, order_by)
    if not positions:
        return rows.select(*[col(c) for c in columns]).limit(0)
    if min(positions) < 0 or rows.filter(col(ROW) == max(positions)).isEmpty():
        raise IndexOutOfBounds(f"positions {min(positions)}..{max(positions)} are not all in the frame")
    wanted = df.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(positions)], "_order long, _position long")
    found = rows.join(F.broadcast(wanted), col(ROW) == F.col("_position"))
    return found.orderBy("_order").select(*[col(c) for c in columns])


def slice_rows(df: DataFrame, start: int, end: int, order_by=None) -> DataFrame:
    """The rows from position ``start`` up to, not including, ``end``; bounds are clamped.

    Without a ``_row`` column the first ``end`` rows are sorted out by
    top-k, and no more of the frame is sorted.
    """
    start, end = max(0, start), max(0, end)
    if end <= start:
        return df.limit(0)
    if order_by is None:
        rows = with_row_id(df)
        return rows.filter((col(ROW) >= start) & (col(ROW) < end))
    from ..rows import order_columns

    return df.orderBy(*order_columns(df, order_by)).limit(end).offset(start)


def head(df: DataFrame, n: int = 10, order_by=None) -> DataFrame:
    return slice_rows(df, 0, n, order_by)


def tail(df: DataFrame, n: int = 10, order_by=None) -> DataFrame:
    """The last ``n`` rows, in order."""
    from ..rows import order_columns

    keys = [f"_k{i}" for i in range(len(order_columns(df, order_by)))]
    marked = df.select("*", *[c.alias(k) for c, k in zip(order_columns(df, order_by), keys, strict=True)])
    last = marked.orderBy(*[F.col(k).desc_nulls_last() for k in keys]).limit(max(0, n))
    return last.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).drop(*keys)


def show_text(df: DataFrame, n: int = 10, order_by=None) -> str:
    """The first rows as a table of text; nulls are written ``<null>``."""
    rows = (head(df, n, order_by) if order_by is not None or ROW in df.columns else df.limit(n)).collect()
    lines = ["\t".join(df.columns)]
    lines += ["\t".join("<null>" if v is None else str(v) for v in r) for r in rows]
    return "\n".join(lines)


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def column(df: DataFrame, name: str) -> DataFrame:
    """One column as a frame."""
    require(df, name)
    return df.select(col(name))


def series_filter(df: DataFrame, name: str, predicate: Column) -> DataFrame:
    """The values of one column that are not null and satisfy the predicate."""
    require(df, name)
    return df.filter(col(name).isNotNull() & predicate).select(col(name))


def set_value(df: DataFrame, name: str, position: int, value, order_by=None) -> DataFrame:
    """The column with its value at one position replaced."""
    require(df, name)
    rows = with_row_id(df, order_by)
    out = rows.withColumn(name, F.when(col(ROW) == position, F.lit(value)).otherwise(col(name)))
    return out if ROW in df.columns else out.drop(ROW)


def set_index(df: DataFrame, labels: Sequence, name: str = "_label", order_by=None) -> DataFrame:
    """A column of labels, one for each row in order; InvalidShape unless there are as many."""
    rows = with_row_id(df, order_by)
    if rows.count() != len(labels):
        raise InvalidShape(f"{len(labels)} labels for {rows.count()} rows")
    held = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(labels)] or [], f"{ROW} long, {name} {_ddl(labels)}")
    return rows.drop(name).join(held, ROW)


def _ddl(values: Sequence) -> str:
    first = next((v for v in values if v is not None), "")
    for kind, ddl in ((bool, "boolean"), (int, "long"), (float, "double")):
        if isinstance(first, kind):
            return ddl
    return "string" if isinstance(first, str) else "timestamp"


def range_index(df: DataFrame, start: int = 0, step: int = 1, name: str = "_label", order_by=None) -> DataFrame:
    """Labels start, start + step, ... in row order."""
    rows = with_row_id(df, order_by)
    return rows.withColumn(name, F.lit(start) + col(ROW) * F.lit(step))


# --- derived columns ------------------------------------------------------


def _expression(f: Callable | Column, *args: Column, kind: str | None) -> Column:
    """``f`` as a column: a Column as it is, a function of columns called, a pandas function wrapped."""
    if isinstance(f, Column):
        return f
    if kind is not None:
        return F.pandas_udf(f, kind)(*args)
    made = f(*args)
    if not isinstance(made, Column):
        raise InvalidArgument("the function must give a Column; for one of pandas series give its return type")
    return made


def apply(df: DataFrame, f: Column | Callable, result: str, inputs: Sequence[str] = (), kind: str | None = None) -> DataFrame:
    """A new column, or one in place of ``result``: an expression, or with ``kind`` a function of pandas series of ``inputs``."""
    require(df, *inputs)
    return df.withColumn(result, _expression(f, *[col(c) for c in inputs], kind=kind))


def apply_column(df: DataFrame, name: str, f: Callable, kind: str | None = None) -> DataFrame:
    """One column's values that are not null put through ``f``; nulls stay."""
    require(df, name)
    return df.withColumn(name, F.when(col(name).isNotNull(), _expression(f, col(name), kind=kind)))


def apply_element(df: DataFrame, f: Callable[..., dict[str, Column]], names: Sequence[str]) -> DataFrame:
    """Several columns from several: ``f`` takes their columns and gives new ones by name."""
    require(df, *names)
    return df.withColumns(f(*[col(n) for n in names]))


def map_columns(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """``f`` on the values of all columns that are not null."""
    return df.select(*[F.when(col(c).isNotNull(), f(col(c))).alias(c) for c in df.columns])


def with_column(df: DataFrame, name: str, values: Column | Sequence, order_by=None) -> DataFrame:
    """A column added or replaced: an expression, or values in row order, InvalidShape unless one for each row."""
    if isinstance(values, Column):
        return df.withColumn(name, values)
    out = set_index(df, list(values), name, order_by)
    keep = df.columns if name in df.columns else [*df.columns, name]
    return out.select(*[col(c) for c in keep])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed; unknown names are ignored. Two columns of one name are DuplicateColumn."""
    from ..errors import DuplicateColumn

    new = [names.get(c, c) for c in df.columns]
    if len(set(new)) < len(new):
        raise DuplicateColumn(f"renaming would give {new}")
    return df.select(*[col(c).alias(n) for c, n in zip(df.columns, new, strict=True)])
