"""Sums of products of columns in one pass: what linear models, PCA and correlations need."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gram:
    """Counts, means and centred products of the columns: ``products[i][j] = sum((x_i - mean_i) (x_j - mean_j))``."""

    names: list[str]
    n: int
    means: np.ndarray
    products: np.ndarray


def gram(df: DataFrame, columns: dict[str, Column]) -> Gram:
    """The Gram matrix of the columns, which must hold no nulls, centred.

    Two aggregates, means first: products about the mean don't cancel. The
    driver gets p means and p (p + 1) / 2 sums, whatever the number of rows.
    """
    names = list(columns)
    p = len(names)
    x = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns.values())])
    first = x.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)]).first()
    n = first["n"]
    means = np.array([first[f"m{i}"] or 0.0 for i in range(p)])
    products = np.zeros((p, p))
    if n:
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        centred = x.select(*[(F.col(f"x{i}") - F.lit(float(m))).alias(f"x{i}") for i, m in enumerate(means)])
        for at in range(0, len(pairs), 2000):  # plans of many thousand sums would not compile
            part = pairs[at : at + 2000]
            sums = centred.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in part]).first()
            for (i, j), s in zip(part, sums, strict=True):
                products[i, j] = products[j, i] = s
    return Gram(names, n, means, products)


def pairwise(df: DataFrame, names: Sequence[str], f) -> dict[tuple[str, str], float | None]:
    """``f`` (corr, covar_samp) of every pair of columns over the rows where both have values, in one pass."""
    from ..columns import double

    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    out: dict[tuple[str, str], float | None] = {}
    for at in range(0, len(pairs), 1000):
        part = pairs[at : at + 1000]
        found = df.agg(*[f(*_both(double(a), double(b))) for a, b in part]).first()
        for (a, b), v in zip(part, found, strict=True):
            out[a, b] = out[b, a] = v
    return out


def _both(a: Column, b: Column) -> tuple[Column, Column]:
    there = a.isNotNull() & b.isNotNull()
    return F.when(there, a), F.when(there, b)
