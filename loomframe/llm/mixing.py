"""Mixing sources to target weights by iterative proportional fitting (raking).

Tokens are summed in cells, one for each combination of the dimensions (source,
language, topic). Cell weights are scaled to each dimension's target marginals
in turn until all hold; marginals that no weights can meet are an error, or are
reported with what is left of them. Documents are then sampled with their cell's
calibrated probability.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, keep_rows, materialise, row_keys, text_of

#: Up to so many cells are raked on the driver and broadcast; more are raked by joins.
MAX_CELLS = 50_000
#: Raking ends when no marginal is off by more than TOLERANCE of its target. If that takes more rounds than ROUNDS
#: and a marginal is off by more than UNMET, the targets contradict one another (or the cells that there are).
ROUNDS, TOLERANCE, UNMET = 1000, 1e-6, 1e-3
SEED = 42
TOPICS = 8
#: Targets of the pipeline: shares by value, or a power to which each value's own share is raised (1: as it is); and the share of tokens to keep.
TARGETS = {"source": 0.8, "lang": {"en": 0.52, "fr": 0.16, "de": 0.16, "es": 0.11}, "topic": 0.9}
BUDGET = 0.8


def topic_of(text: Column, topics: int = TOPICS) -> Column:
    """A stand-in where documents carry no topic: of the whole text's long words the bucket that has most, of several the smallest; null without one."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{6,}"), F.lit(0))
    buckets = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(topics)))
    # An array of one, so that the buckets are named and made once.
    counts = F.transform(F.array(buckets), lambda b: F.transform(F.sequence(F.lit(0), F.lit(topics - 1)), lambda k: F.struct(F.size(F.filter(b, lambda x: x == k)).alias("n"), (-k).alias("k"))))
    best = F.array_max(counts[0])
    return F.when(best["n"] > 0, F.concat(F.lit("t"), (-best["k"]).cast("string")))


def tokens_of(text: Column) -> Column:
    """Words: runs of what is not white space."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def _shares(tokens: dict, target) -> dict:
    """The target share of each value. target: a power for tempering, or shares by value.

    Values without a share divide what the others leave in proportion to tokens;
    shares of values that have no tokens are divided among the rest.
    """
    total = sum(tokens.values())
    if not total:
        return dict.fromkeys(tokens, 0.0)
    if not isinstance(target, dict):
        raw = {v: (t / total) ** target if t else 0.0 for v, t in tokens.items()}
    else:
        rest = sum(t for v, t in tokens.items() if v not in target)
        left = max(0.0, 1.0 - sum(target.values()))
        raw = {v: (target[v] if v in target else left * t / rest) if t else 0.0 for v, t in tokens.items()}
    whole = sum(raw.values())
    return {v: r / whole if whole else 0.0 for v, r in raw.items()}


def rake(cells: list[tuple], targets: list, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[list[float], float]:
    """Weights for ``cells`` of (values..., tokens) so that weighted tokens meet the targets, and by what share of it a target is missed at most."""
    tokens = np.array([c[-1] for c in cells], float)
    dims = []
    for d, target in enumerate(targets):
        values = sorted({c[d] for c in cells}, key=lambda v: (v is None, str(v)))
        place = {v: k for k, v in enumerate(values)}
        at = np.array([place[c[d]] for c in cells], int)
        by = np.bincount(at, tokens, len(values))
        shares = _shares(dict(zip(values, by.tolist(), strict=True)), target)
        dims.append((at, np.array([shares[v] for v in values]) * tokens.sum()))
    weights, off = np.ones(len(cells)), 0.0
    for _ in range(rounds):
        for at, goal in dims:
            now = np.bincount(at, weights * tokens, len(goal))
            weights = weights * np.divide(goal, now, out=np.ones(len(goal)), where=now > 0)[at]
        off = max((_missed(np.bincount(at, weights * tokens, len(goal)), goal) for at, goal in dims), default=0.0)
        if off < tolerance:
            break
    return weights.tolist(), off


def _missed(now: np.ndarray, goal: np.ndarray) -> float:
    asked = goal > 0
    return float(np.abs(now[asked] / goal[asked] - 1).max(initial=0.0))


def _rake_joined(cells: DataFrame, dims: list[str], targets: list, rounds: int, tolerance: float) -> tuple[DataFrame, float]:
    """:func:`rake` where cells are too many for the driver: ``cells`` with ``weight``."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    fitted = cells.withColumn("weight", F.lit(1.0))
    goals = []
    for d, target in zip(dims, targets, strict=True):
        by = cells.groupBy(d).agg(F.sum("tokens").alias("m"))
        share = F.col("m") / F.lit(max(total, 1))
        if isinstance(target, dict):
            named = cells.sparkSession.createDataFrame([(v, float(s)) for v, s in target.items()], "v string, s double")
            by = by.join(F.broadcast(named), F.col(d).eqNullSafe(F.col("v")), "left")
            rest = by.filter("s IS NULL").agg(F.sum("m")).first()[0] or 1
            left = max(0.0, 1.0 - sum(target.values()))
            share = F.coalesce(F.col("s"), F.lit(left / rest) * F.col("m"))
        else:
            share = F.pow(share, F.lit(float(target)))
        by = materialise(by.select(F.col(d).alias("v"), F.when(F.col("m") > 0, share).otherwise(0.0).alias("s")), "goals")
        whole = by.agg(F.sum("s")).first()[0] or 1.0
        goals.append(by.select("v", (F.col("s") * F.lit(total / whole)).alias("goal")))

    def factors(d: str, goal: DataFrame) -> DataFrame:
        now = fitted.groupBy(F.col(d).alias("v")).agg(F.sum(F.col("weight") * F.col("tokens")).alias("n"))
        both = now.alias("x").join(goal.alias("y"), F.col("x.v").eqNullSafe(F.col("y.v")))
        factor = F.when(F.col("n") > 0, F.col("goal") / F.col("n")).otherwise(1.0)
        missed = F.when(F.col("goal") > 0, F.abs(F.col("n") / F.col("goal") - 1)).otherwise(0.0)
        return both.select(F.col("x.v").alias("v"), factor.alias("f"), missed.alias("off"))

    off = 0.0
    for _ in range(rounds):
        for d, goal in zip(dims, goals, strict=True):
            moved = fitted.join(materialise(factors(d, goal), "factors"), F.col(d).eqNullSafe(F.col("v")))
            fitted = materialise(moved.select(*dims, "tokens", (F.col("weight") * F.col("f")).alias("weight")), "cells")
        # The dimension scaled last holds; if all before it still do, all hold.
        off = max([factors(d, goal).agg(F.max("off")).first()[0] or 0.0 for d, goal in list(zip(dims, goals, strict=True))[:-1]], default=0.0)
        if off < tolerance:
            break
    return fitted, off


def _scale(weights: DataFrame, goal: float) -> float:
    """The factor by which weights, capped at 1, sum to ``goal`` tokens; each step caps more cells than the one before, or is the last."""
    factor = 0.0
    while True:
        capped = F.col("weight") * F.lit(factor) >= 1
        full, open_ = weights.agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)), F.sum(F.when(~capped, F.col("weight") * F.col("tokens")).otherwise(0))).first()
        if not open_:
            return factor or 1.0
        new = max((goal - full) / open_, 0.0)
        if new <= factor * (1 + 1e-12):
            return max(factor, new)
        factor = new


def mix(
    docs: DataFrame, dims: dict[str, Column], targets: dict[str, float | dict], budget: float = BUDGET,
    tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, max_cells: int = MAX_CELLS, unmet: str = "raise",
) -> DataFrame:
    """Each row of ``docs`` with its cell, ``tokens``, ``weight``, ``probability``, ``kept``, ``residual`` and the row keys.

    dims: the dimensions' columns by name; targets: for each a power by which its
    shares are tempered, or shares by value. ``budget`` is the share of all
    tokens to keep in expectation. A document is kept at most once: cells whose
    probability would be above 1 are kept whole, and the others make up for it.
    ``residual``, the same in all rows, is the share of its target that the raked
    weights miss a marginal by at most. Targets that can't be met raise ValueError,
    or with ``unmet="report"`` a warning.

    A null value of a dimension is a value of its own. Null text has no tokens;
    documents without tokens follow their cell. Whether a document is kept
    depends on its id and text alone, so repeated rows share their fate. An empty
    table gives an empty table. Other columns are ignored whatever their names.
    """
    names = [f"d{i}" for i in range(len(dims))]
    count = tokens_of(text_of(text_col)) if tokens is None else tokens
    rows = materialise(
        docs.select(col(id_col).alias("id"), *row_keys(id_col, text_col), *[c.cast("string").alias(n) for n, c in zip(names, dims.values(), strict=True)], count.alias("tokens")),
        "mixrows",
    )
    cells = materialise(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "cells")
    goals = [targets[d] for d in dims]
    few = cells.count() <= max_cells
    if few:
        table = [tuple(r) for r in cells.collect()]
        weights, off = rake(table, goals)
        schema = ", ".join(f"{n} string" for n in names) + ", tokens long, weight double"
        fitted = docs.sparkSession.createDataFrame([(*c, w) for c, w in zip(table, weights, strict=True)], schema)
    else:
        fitted, off = _rake_joined(cells, names, goals, ROUNDS, TOLERANCE)
    if off > UNMET:
        told = f"no weights meet these targets: a marginal is off by {off:.3g} of its target"
        if unmet == "raise":
            raise ValueError(told)
        warnings.warn(told, stacklevel=2)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    factor = _scale(fitted, budget * total)
    calibrated = fitted.select(*[F.col(n).alias(f"c_{n}") for n in names], "weight", F.least(F.lit(1.0), F.col("weight") * F.lit(factor)).alias("probability"))
    on = [F.col(n).eqNullSafe(F.col(f"c_{n}")) for n in names]
    joined = rows.join(F.broadcast(calibrated) if few else calibrated, on)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("mix"), "_k1", "_k2"), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return joined.select(
        F.col("id").alias(id_col),
        *[F.col(n).alias(d) for n, d in zip(names, dims, strict=True)],
        "tokens", "weight", "probability", (uniform < F.col("probability")).alias("kept"), F.lit(off).alias("residual"), "_k1", "_k2",
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """:func:`mix` by source, language and topic with the pipeline's targets; the topic is :func:`topic_of` the text unless one is given. Targets that can't be met are reported."""
    dims = {"source": col("source"), "lang": col("lang"), "topic": topic_of(text_of(text_col)) if topic is None else topic}
    return mix(docs, dims, TARGETS, id_col=id_col, text_col=text_col, unmet="report")


def sample_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`mix_documents` samples, all columns kept.

    A null text has no tokens and follows its cell, null dimensions are values of
    their own, repeated rows share their fate, an empty table gives an empty
    table, and other columns are kept whatever their names.
    """
    keep = mix_documents(docs, id_col, text_col).filter("kept")
    return keep_rows(docs, keep, id_col, text_col, once=False)
