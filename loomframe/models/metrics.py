"""Metrics. Rows where either value is null are left out. Counts by pair of labels are what the driver gets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import col, double, require
from ..errors import InvalidArgument

AVERAGES = ("binary", "micro", "macro", "weighted")
MAX_PAIRS = 1_000_000


def _pairs(df: DataFrame, true: str, pred: str) -> DataFrame:
    require(df, true, pred)
    return df.filter(col(true).isNotNull() & col(pred).isNotNull())


def accuracy(df: DataFrame, true: str, pred: str) -> float:
    return _pairs(df, true, pred).agg(F.avg((col(true) == col(pred)).cast("double"))).first()[0] or 0.0


def _counts(df: DataFrame, true: str, pred: str) -> dict[tuple, int]:
    rows = _pairs(df, true, pred).groupBy(col(true).alias("t"), col(pred).alias("p")).count().limit(MAX_PAIRS + 1).collect()
    if len(rows) > MAX_PAIRS:
        raise InvalidArgument("these are no labels: there are too many of them")
    return {(r["t"], r["p"]): r["count"] for r in rows}


def _by_label(counts: dict[tuple, int]) -> dict[object, tuple[int, int, int]]:
    """For each true label: right, predicted, and true rows."""
    out = {}
    for k in sorted({t for t, _ in counts}):
        out[k] = (counts.get((k, k), 0), sum(n for (_, p), n in counts.items() if p == k), sum(n for (t, _), n in counts.items() if t == k))
    return out


def _averaged(counts: dict[tuple, int], average: str, pos_label, below: int) -> float:
    """right / predicted (below 1) or right / true (below 2)."""
    if average not in AVERAGES:
        raise InvalidArgument(f"average is one of {AVERAGES}, not {average!r}")
    labels = _by_label(counts)
    total = sum(counts.values())
    if not total:
        return 0.0
    share = lambda x: x[0] / x[below] if x[below] else 0.0
    if average == "micro":
        return sum(x[0] for x in labels.values()) / total
    if average == "binary":
        known = {k for pair in counts for k in pair}
        pos = max(known) if pos_label is None else pos_label
        right = counts.get((pos, pos), 0)
        whole = sum(n for pair, n in counts.items() if pair[1 if below == 1 else 0] == pos)
        return right / whole if whole else 0.0
    if average == "macro":
        return sum(map(share, labels.values())) / len(labels)
    return sum(share(x) * x[2] for x in labels.values()) / total


def precision(df: DataFrame, true: str, pred: str, average: str = "macro", pos_label=None) -> float:
    """Macro and weighted go over the true labels; binary takes ``pos_label``, by default the largest label."""
    return _averaged(_counts(df, true, pred), average, pos_label, 1)


def recall(df: DataFrame, true: str, pred: str, average: str = "macro", pos_label=None) -> float:
    return _averaged(_counts(df, true, pred), average, pos_label, 2)


def f1_score(df: DataFrame, true: str, pred: str, average: str = "macro", pos_label=None) -> float:
    """The harmonic mean of the averaged precision and recall."""
    counts = _counts(df, true, pred)
    p, r = _averaged(counts, average, pos_label, 1), _averaged(counts, average, pos_label, 2)
    return 2 * p * r / (p + r) if p + r else 0.0


def confusion_matrix(df: DataFrame, true: str, pred: str) -> DataFrame:
    """A row for each label: ``label`` and counts of each predicted label, sorted."""
    counts = _counts(df, true, pred)
    labels = sorted({k for pair in counts for k in pair})
    schema = "label string, " + ", ".join(f"`{k}` long" for k in labels)
    return df.sparkSession.createDataFrame([(str(t), *[counts.get((t, p), 0) for p in labels]) for t in labels], schema if labels else "label string")


def classification_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """``label``, ``precision``, ``recall``, ``f1``, ``support`` for each label."""
    counts = _counts(df, true, pred)
    rows = []
    for k in sorted({x for pair in counts for x in pair}):
        right, said, real = counts.get((k, k), 0), sum(n for (_, p), n in counts.items() if p == k), sum(n for (t, _), n in counts.items() if t == k)
        p, r = right / said if said else 0.0, right / real if real else 0.0
        rows.append((str(k), p, r, 2 * p * r / (p + r) if p + r else 0.0, real))
    return df.sparkSession.createDataFrame(rows, "label string, precision double, recall double, f1 double, support long")


def regression_metrics(df: DataFrame, true: str, pred: str) -> DataFrame:
    """One row in one pass: mse, rmse, mae."""
    e = double(true) - double(pred)
    return _pairs(df, true, pred).agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def _nan(v) -> float:
    return float("nan") if v is None else v


def mse(df: DataFrame, true: str, pred: str) -> float:
    return _nan(regression_metrics(df, true, pred).first()["mse"])


def rmse(df: DataFrame, true: str, pred: str) -> float:
    return _nan(regression_metrics(df, true, pred).first()["rmse"])


def mae(df: DataFrame, true: str, pred: str) -> float:
    return _nan(regression_metrics(df, true, pred).first()["mae"])


def r2_score(df: DataFrame, true: str, pred: str) -> float:
    """1 - residual / total sum of squares, about the mean of all true values; NaN without spread."""
    require(df, true, pred)
    mean = df.agg(F.avg(double(true))).first()[0]
    if mean is None:
        return float("nan")
    rest, total = _pairs(df, true, pred).agg(F.sum(F.pow(double(true) - double(pred), 2)), F.sum(F.pow(double(true) - F.lit(mean), 2))).first()
    return 1 - rest / total if total else float("nan")


def adjusted_r2(df: DataFrame, true: str, pred: str, p: int) -> float:
    """Adjusted for ``p`` features; NaN if there are not more rows than p + 1."""
    n = df.count()
    return 1 - (1 - r2_score(df, true, pred)) * (n - 1) / (n - p - 1) if n - p - 1 > 0 else float("nan")
