"""Row order. Spark's frames have none, so positional operators are given one.

``order_by`` is a list of columns that puts the rows in a total order; where it
is left out, the frame's ``_row`` column of dense positions serves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col, fresh
from .errors import InvalidArgument
from .session import written

ROW = "_row"


def order_columns(df: DataFrame, order_by: str | Column | Sequence[str | Column] | None) -> list[Column]:
    if order_by is None:
        if ROW in df.columns:
            return [col(ROW)]
        raise InvalidArgument("this operator depends on row order: give order_by, or add a _row column by with_row_id")
    given = [order_by] if isinstance(order_by, str | Column) else list(order_by)
    return [col(c) if isinstance(c, str) else c for c in given]


def with_row_id(df: DataFrame, order_by: str | Column | Sequence[str | Column] | None = None, name: str = ROW) -> DataFrame:
    """``df`` with a dense position from 0 in the given order.

    The rows are sorted by range over all executors and written to the shared
    folder, so that positions stay as they are though rows tie or an executor is
    lost; each partition then adds the number of rows before it, of which there is
    one for each partition. No task sees more than its share. Positions that are
    there already (``_row``, and no other order asked for) are used as they are.
    """
    if order_by is None and name in df.columns:
        return df
    at = fresh(df, "_sorted_at")
    placed = df.orderBy(*order_columns(df, order_by)).withColumn(at, F.monotonically_increasing_id())
    placed = written(placed, "sorted")
    part = F.shiftright(at, 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(counts):
        offsets += [F.lit(p), F.lit(before)]
        before += counts[p]
    offset = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    within = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, (within + offset).cast("long")).drop(at)
