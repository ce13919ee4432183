"""Splits into train and test, and folds, of exact sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import col, fresh, require
from ..errors import InvalidArgument
from ..rows import ROW, order_columns, with_row_id


def _order(df: DataFrame, order_by, shuffle: bool, seed: int) -> list[Column]:
    order = order_columns(df, order_by)
    return [F.xxhash64(F.lit(seed), *order), *order] if shuffle else order


def _within(df: DataFrame, label: str, order: list[Column]) -> tuple[DataFrame, str, str]:
    """``df`` with the position within the row's class and the rows of the class, and these columns' names.

    Rows are numbered over the whole frame, by class, so that a class that has
    most rows is still shared among tasks; a class begins at its smallest number.
    """
    at, n, of, first = (fresh(df, c) for c in ("_at", "_n", "_label", "_first"))
    placed = with_row_id(df, [col(label), *order], at)
    begins = placed.groupBy(col(label).alias(of)).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    both = placed.join(begins, col(label).eqNullSafe(F.col(of)))
    return both.withColumn(at, F.col(at) - F.col(first)).drop(of, first), at, n


def train_test_split(
    df: DataFrame, test_size: float = 0.25, shuffle: bool = True, stratify: str | None = None, seed: int = 0, order_by=None
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly int(n * test_size) test rows, for each class if stratified (rows without a class are left out).

    Shuffling is by a seeded hash of the order columns, so a split is the same
    in every run. Without it the last rows are the test.
    """
    if not 0 < test_size < 1:
        raise InvalidArgument("the test's share is between 0 and 1")
    keep = df.columns
    if stratify is not None:
        require(df, stratify)
        marked, at, n = _within(df.filter(col(stratify).isNotNull()), stratify, _order(df, order_by, shuffle, seed))
        test = F.col(at) >= F.col(n) - F.floor(F.col(n) * F.lit(test_size))
    else:
        at = fresh(df, "_at")
        marked = with_row_id(df, _order(df, order_by, shuffle, seed), at)
        rows = marked.count()
        test = F.col(at) >= rows - int(rows * test_size)
    kept = [col(c) for c in keep]
    return marked.filter(~test).select(*kept), marked.filter(test).select(*kept)


def kfold_assign(df: DataFrame, n: int = 5, shuffle: bool = False, seed: int = 0, order_by=None, name: str = "fold") -> DataFrame:
    """``df`` with its fold, 0 to n - 1. Folds are consecutive; the first (rows mod n) have a row more."""
    n = n if n >= 2 else 5
    place = fresh(df, "_at")
    marked = with_row_id(df, _order(df, order_by, shuffle, seed), place)
    rows = marked.count()
    size, more = divmod(rows, n)
    at, edge = F.col(place), more * (size + 1)
    fold = F.when(at < edge, F.floor(at / F.lit(size + 1)))
    fold = fold.otherwise(more + F.floor((at - edge) / F.lit(max(size, 1))))
    return marked.withColumn(name, fold.cast("long")).drop(place, *([] if ROW in df.columns else [ROW]))


def stratified_kfold_assign(df: DataFrame, label: str, n: int = 5, shuffle: bool = False, seed: int = 0, order_by=None, name: str = "fold") -> DataFrame:
    """``df`` with its fold: rows of each class are dealt out in turn."""
    require(df, label)
    n = n if n >= 2 else 5
    marked, at, rows = _within(df, label, _order(df, order_by, shuffle, seed))
    return marked.withColumn(name, (F.col(at) % n).cast("long")).drop(at, rows, *([] if ROW in df.columns else [ROW]))


def folds(df: DataFrame, n: int, fold: str = "fold") -> Iterator[tuple[DataFrame, DataFrame]]:
    """(train, test) for each fold of a frame that has them."""
    for k in range(n):
        yield df.filter(col(fold) != k).drop(fold), df.filter(col(fold) == k).drop(fold)


def cross_val_score(
    make: Callable[[], object], df: DataFrame, target: str, scoring: Callable[[DataFrame, str, str], float], n: int = 5,
    shuffle: bool = False, seed: int = 0, stratified: bool = False, order_by=None,
) -> list[float]:
    """The score of a new model on each fold, fitted on the others. The assigned frame is kept for all fits."""
    from .base import PREDICTION

    n = n if n >= 2 else 5
    assigned = (stratified_kfold_assign(df, target, n, shuffle, seed, order_by) if stratified else kfold_assign(df, n, shuffle, seed, order_by)).persist()
    try:
        return [scoring(make().fit(train, target).predict(test), target, PREDICTION) for train, test in folds(assigned, n)]
    finally:
        assigned.unpersist()
