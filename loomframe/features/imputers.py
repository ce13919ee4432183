"""Imputers of missing values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import col, double, fresh, numeric_columns, require
from ..errors import InvalidArgument
from ..plans.quantiles import quantiles
from ..session import scratch_path, written
from .base import Transformer


def _most_frequent(df: DataFrame, name: str):
    """Counted by all executors; only the winner comes back."""
    counts = df.filter(col(name).isNotNull()).groupBy(col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    first = counts.orderBy(F.desc("n"), "v").first()
    return None if first is None else first["v"]


class SimpleImputer(Transformer):
    """mean, median, most_frequent (of several the smallest) or constant, for columns that have nulls when fitted."""

    def __init__(self, columns: Sequence[str] | None = None, strategy: str = "mean", fill_value=None) -> None:
        self.columns, self.strategy, self.fill_value = columns, strategy, fill_value

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        names = list(self.columns or (df.columns if self.strategy in ("most_frequent", "constant") else numeric_columns(df)))
        require(df, *names)
        counts = df.agg(*[F.count(F.when(col(n).isNull(), 1)).alias(f"n{i}") for i, n in enumerate(names)]).first()
        names = [n for i, n in enumerate(names) if counts[f"n{i}"]]
        if not names:
            return {"values": {}}
        if self.strategy not in ("mean", "median", "most_frequent", "constant"):
            raise InvalidArgument(f"no strategy {self.strategy!r}")
        if self.strategy == "constant":
            return {"values": dict.fromkeys(names, self.fill_value)}
        if self.strategy == "median":
            return {"values": {n: v[0] or 0.0 for n, v in quantiles(df, names, [0.5]).items()}}
        if self.strategy == "most_frequent":
            return {"values": {n: _most_frequent(df, n) for n in names}}
        row = df.agg(*[F.coalesce(F.avg(double(n)), F.lit(0.0)).alias(f"v{i}") for i, n in enumerate(names)]).first()
        return {"values": dict(zip(names, row, strict=True))}

    def _transform(self, df: DataFrame) -> DataFrame:
        values = self.state["values"]
        require(df, *values)
        return df.select(*[(self._filled(df, c, values[c]) if values.get(c) is not None else col(c)).alias(c) for c in df.columns])

    def _filled(self, df: DataFrame, name: str, value) -> Column:
        kind = df.schema[name].dataType
        if isinstance(value, float) and isinstance(kind, T.IntegralType) and not value.is_integer():
            return F.coalesce(double(name), F.lit(value))
        return F.coalesce(col(name), F.lit(value).cast(kind))

    @property
    def stats(self) -> dict:
        return dict(self.state["values"])


#: Distinct fitted rows kept with the imputer's state at most; more are kept as a written table, and searched as exactly.
IN_STATE = 10_000
#: Rows of a block of the searched table and of the rows that search it; lists of nearest rows that are merged at a time.
BLOCK, ASKING, MERGED = 20_000, 2_000, 64


def _nearest(x: np.ndarray, ref: np.ndarray, count: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, float, int]]]]:
    """For each gap of ``x`` its place and the (distance, value, copies) of the nearest rows of ``ref``, of several as near the smallest values first: as many as hold k copies."""
    d = ref - x
    seen = ~np.isnan(d)
    distance = np.where(seen.any(axis=1), np.sqrt(np.where(seen, d * d, 0).sum(axis=1)), np.inf)
    for j in np.flatnonzero(np.isnan(x)).tolist():
        able = np.flatnonzero(~np.isnan(ref[:, j]) & np.isfinite(distance))
        if len(able) > k:  # k rows are k copies at least
            able = able[distance[able] <= np.partition(distance[able], k - 1)[k - 1]]
        able = able[np.lexsort((ref[able, j], distance[able]))]
        last = int(np.searchsorted(np.cumsum(count[able]), k)) + 1
        yield j, [(float(distance[i]), float(ref[i, j]), int(count[i])) for i in able[:last]]


class KNNImputer(Transformer):
    """The mean of the nearest rows of the fitted frame, by Euclidean distance over columns where both rows have values.

    weights: uniform, or distance (1/d; a row at distance 0 weighs 1). Rows
    without a value in the column are no neighbours; of several as near, those
    with the smallest values are taken. Without neighbours a null stays.

    Every fitted row is searched. Equal ones are kept once, with their number: up
    to IN_STATE of them with the imputer's state, more as a table in the shared
    folder. Rows with gaps search that table block by block, equal ones once, and
    no pair of rows is ever written out but the k nearest of each block.
    """

    def __init__(self, k: int = 5, columns: Sequence[str] | None = None, weights: str = "uniform") -> None:
        if k < 1 or weights not in ("uniform", "distance"):
            raise InvalidArgument("k is at least 1, and weights are uniform or distance")
        self.k, self.columns, self.weights = k, columns, weights

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        names = list(self.columns or numeric_columns(df, [target] if target else []))
        require(df, *names)
        if not names:
            return {"columns": [], "rows": [], "counts": [], "table": None}
        path = scratch_path(df.sparkSession, "knn")
        x = df.select(F.array(*[double(n) for n in names]).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        x.write.parquet(path)
        known = df.sparkSession.read.parquet(path)
        if known.count() > IN_STATE:
            return {"columns": names, "rows": [], "counts": [], "table": path}
        rows = [(list(r["x"]), r["n"]) for r in known.collect()]
        return {"columns": names, "rows": [x for x, _ in rows], "counts": [n for _, n in rows], "table": None}

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.state["columns"]
        require(df, *names)
        if not names or not (self.state["rows"] or self.state["table"]):
            return df
        gap, name = F.lit(False), fresh(df, "_knn")
        for n in names:
            gap = gap | col(n).isNull()
        asked = F.array(*[double(n) for n in names])
        asking = df.filter(gap).select(asked.alias("x")).distinct()
        found = self._searched(asking) if self.state["table"] else self._compared(asking)
        found = written(found, "knn").select(F.col("x").alias(name + "x"), F.col("filled").alias(name))
        made = df.join(found, gap & (asked == F.col(name + "x")), "left")
        return made.select(*[(F.coalesce(double(c), F.col(name)[names.index(c)]) if c in names else col(c)).alias(c) for c in df.columns])

    def _value(self, near: Column) -> Column:
        """The mean of the first k copies in a list of (distance, value, copies)."""
        weight = F.lit(1.0) if self.weights == "uniform" else None
        start = F.struct(F.lit(self.k).cast("long").alias("left"), F.lit(0.0).alias("w"), F.lit(0.0).alias("s"))

        def add(acc: Column, r: Column) -> Column:
            used = F.least(acc["left"], r["n"])
            w = used * (weight if weight is not None else F.when(r["d"] > 0, F.lit(1.0) / r["d"]).otherwise(1.0))
            return F.struct((acc["left"] - used).alias("left"), (acc["w"] + w).alias("w"), (acc["s"] + w * r["v"]).alias("s"))

        return F.aggregate(near, start, add, lambda acc: F.when(acc["w"] > 0, acc["s"] / acc["w"]))

    def _filled(self, lists: DataFrame) -> DataFrame:
        """``x`` and ``filled`` from ``x``, ``j`` and ``near``: the gaps' values by their places."""
        values = lists.select("x", "j", self._value(F.col("near")).alias("v")).groupBy("x").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))
        return values.select("x", F.transform("x", lambda v, j: F.coalesce(v, F.try_element_at("m", j))).alias("filled"))

    _LISTS = "x array<double>, j int, near array<struct<d:double,v:double,n:long>>"

    def _compared(self, asking: DataFrame) -> DataFrame:
        held = np.array([[np.nan if v is None else v for v in r] for r in self.state["rows"]], float), np.array(self.state["counts"], np.int64)
        shared, k = asking.sparkSession.sparkContext.broadcast(held), self.k  # IN_STATE rows at most

        def run(frames):
            for frame in frames:
                yield _lists(frame["x"], *shared.value, k)

        return self._filled(asking.mapInPandas(run, self._LISTS))

    def _searched(self, asking: DataFrame) -> DataFrame:
        spark, k = asking.sparkSession, self.k
        known = spark.read.parquet(self.state["table"])
        asking = written(asking, "asking")
        blocks, asks = -(-known.count() // BLOCK), max(1, -(-asking.count() // ASKING))
        place = lambda n: F.pmod(F.xxhash64("x"), F.lit(n))
        packed = known.groupBy(place(blocks).alias("b")).agg(F.collect_list(F.struct("x", "n")).alias("known"))
        groups = asking.groupBy(place(asks).alias("a")).agg(F.collect_list("x").alias("xs"))
        each = groups.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(packed, "b").select("b", "xs", "known")

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for b, xs, rows in zip(*[batch.column(i) for i in range(3)], strict=True):
                    rows = rows.as_py()
                    ref = np.array([[np.nan if v is None else v for v in r["x"]] for r in rows], float)
                    made = _lists(xs.as_py(), ref, np.array([r["n"] for r in rows], np.int64), k)
                    made.insert(0, "b", b.as_py())
                    near = pa.array([[{"d": d, "v": v, "n": n} for d, v, n in x] for x in made["near"]], pa.list_(pa.struct([("d", pa.float64()), ("v", pa.float64()), ("n", pa.int64())])))
                    yield pa.RecordBatch.from_arrays([pa.array(made["b"], pa.int64()), pa.array(made["x"].tolist(), pa.list_(pa.float64())), pa.array(made["j"], pa.int32()), near], names=["b", "x", "j", "near"])

        near = each.mapInArrow(run, "b long, " + self._LISTS)
        while True:
            blocks = -(-blocks // MERGED)
            merged = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)  # k lists of copies hold k copies at least
            near = near.groupBy("x", "j", F.floor(F.col("b") / MERGED).cast("long").alias("b")).agg(merged.alias("near"))
            if blocks <= 1:
                return self._filled(near)


def _lists(asking, ref: np.ndarray, count: np.ndarray, k: int):
    import pandas as pd

    out = []
    for r in asking:
        r = [None if v is None or v != v else float(v) for v in r]
        x = np.array([np.nan if v is None else v for v in r], float)
        out += [(r, j, near) for j, near in _nearest(x, ref, count, k)]
    return pd.DataFrame(out, columns=["x", "j", "near"])


class IterativeImputer(Transformer):
    """Each column with nulls regressed on the others in turn, with the others' nulls filled, until the fills settle.

    Each regression is a pass of sums over the data. A fill replays all rounds of
    regressions, from the simple fill on, in one expression whose size doesn't
    depend on their number.
    """

    def __init__(self, columns: Sequence[str] | None = None, max_iter: int = 10, tolerance: float = 1e-3, initial_strategy: str = "mean") -> None:
        if initial_strategy not in ("mean", "median"):
            raise InvalidArgument("the initial strategy is mean or median")
        self.columns, self.max_iter, self.tolerance, self.initial_strategy = columns, max_iter, tolerance, initial_strategy

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        from ..plans.gram import gram

        names = list(self.columns or numeric_columns(df, [target] if target else []))
        require(df, *names)
        if not names:
            return {"columns": [], "start": [], "rounds": []}
        first = df.agg(*[F.coalesce(F.avg(double(n)), F.lit(0.0)) for n in names], *[F.count(F.when(col(n).isNull(), 1)) for n in names]).first()
        start, gaps = list(first[: len(names)]), list(first[len(names) :])
        if self.initial_strategy == "median":
            start = [v[0] or 0.0 for v in quantiles(df, names, [0.5]).values()]
        todo = [i for i in range(len(names)) if gaps[i]]
        known = F.array(*[double(n) for n in names])
        # ``f`` is the fill so far, carried from step to step, so that a step costs one pass however many went before.
        x = df.select(known.alias("x"), known.alias("f")).select("x", self._begun(start).alias("f"))
        rounds: list[list] = []
        before = None
        for _ in range(self.max_iter if len(names) > 1 else 0):
            x = written(x, "filled")
            step = []
            for i in todo:
                filled = self._replayed([step])
                rest = [j for j in range(len(names)) if j != i]
                cols = x.select("x", filled.alias("f"))
                g = gram(cols.filter(F.col("x")[i].isNotNull()), {f"x{j}": F.col("f")[j] for j in [*rest, i]})
                xx, xy = g.products[:-1, :-1], g.products[:-1, -1]
                b = np.linalg.lstsq(xx, xy, rcond=None)[0] if g.n else np.zeros(len(rest))
                c = float(g.means[-1] - g.means[:-1] @ b) if g.n else start[i]
                step.append([i, c, {str(j): float(v) for j, v in zip(rest, b, strict=True)}])
            rounds.append(step)
            x = x.select("x", self._replayed([step]).alias("f"))
            now = np.array([v for _, c, b in step for v in (c, *b.values())])
            if before is not None and np.abs(now - before).max(initial=0) <= self.tolerance * max(1.0, np.abs(now).max(initial=0)):
                break
            before = now
        return {"columns": names, "start": start, "rounds": rounds}

    @staticmethod
    def _begun(start: list, x: str = "x") -> Column:
        """The array ``x`` with the simple fill."""
        return F.zip_with(x, F.array(*[F.lit(float(v)) for v in start]), lambda v, s: F.coalesce(v, s))

    @staticmethod
    def _replayed(rounds: list, x: str = "x", f: Column | str = "f") -> Column:
        """The fill ``f`` of ``x`` after these rounds."""
        f = F.col(f) if isinstance(f, str) else f
        steps = [s for step in rounds for s in step]
        if not steps:
            return f
        size = len(steps[0][2]) + 1
        table = F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(float(c)).alias("c"), F.array(*[F.lit(float(b.get(str(j), 0.0))) for j in range(size)]).alias("w")) for i, c, b in steps
        ])

        def one(now: Column, s: Column) -> Column:
            value = F.aggregate(F.zip_with(now, s["w"], lambda v, w: v * w), s["c"], lambda a, v: a + v)
            return F.transform(now, lambda v, j: F.when((j == s["i"]) & F.get(F.col(x), j).isNull(), value).otherwise(v))

        return F.aggregate(table, f, one)

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.state["columns"]
        require(df, *names)
        if not names:
            return df
        x, f = fresh(df, "_known"), fresh(df, "_filled")
        made = df.withColumn(x, F.array(*[double(n) for n in names]))
        made = made.withColumn(f, self._replayed(self.state["rounds"], x, self._begun(self.state["start"], x)))
        return made.select(*[(col(f)[names.index(c)] if c in names else col(c)).alias(c) for c in df.columns])
