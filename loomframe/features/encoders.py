"""Encoders of categories. A category is its value's text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import col, fresh, require
from ..errors import InvalidArgument
from ..rows import order_columns, with_row_id
from ..session import scratch_path
from .base import Transformer

#: Categories that an encoder keeps on the driver at most. Codes, means and counts of more are kept as a table in the
#: shared folder and joined; columns can't be made for them.
MAX_CATEGORIES = 100_000
#: Up to so many are written into the plan; more are joined by broadcast.
IN_PLAN = 200


def _text(name: str) -> Column:
    return col(name).cast("string")


def _distinct(df: DataFrame, name: str, order_by=None) -> tuple[DataFrame, list[Column]]:
    """``v``, the distinct values that are not null, and what orders them: as they first appear in the order given, or sorted."""
    require(df, name)
    known = df.filter(col(name).isNotNull())
    if order_by is None:
        found = known.select(_text(name).alias("v")).distinct()
        key: list[Column] = [F.col("v")]
    else:
        order = order_columns(df, order_by)
        found = known.groupBy(_text(name).alias("v")).agg(F.min(F.struct(*order)).alias("o"))
        key = [F.col("o")]
    return found, key


def _categories(df: DataFrame, name: str, order_by=None) -> list[str]:
    found, key = _distinct(df, name, order_by)
    rows = found.orderBy(*key).limit(MAX_CATEGORIES + 1).select("v").collect()
    if len(rows) > MAX_CATEGORIES:
        raise InvalidArgument(f"{name!r} has more than {MAX_CATEGORIES} categories")
    return [r["v"] for r in rows]


def _kept(found: DataFrame, k: str, v: str) -> dict | str:
    """What ``found`` says of each text, as a mapping or, of more than MAX_CATEGORIES, as the path of a table."""
    rows = found.orderBy(k).limit(MAX_CATEGORIES + 1).collect()
    if len(rows) <= MAX_CATEGORIES:
        return {r[k]: r[v] for r in rows}
    path = scratch_path(found.sparkSession, "categories")
    found.select(F.col(k).alias("k"), F.col(v).alias("v")).write.parquet(path)
    return path


def _plain(tables: dict) -> dict:
    for c, table in tables.items():
        if isinstance(table, str):
            raise InvalidArgument(f"the categories of {c!r} are too many for the driver; their table is {table}")
    return dict(tables)


def _mapped(df: DataFrame, tables: dict[str, dict[str, float | int] | str], kind: str, unknown: dict[str, Column]) -> DataFrame:
    """Columns replaced by what the tables say of their text; nulls stay null, the rest takes ``unknown``."""
    out, values = df, {}
    for i, (name, table) in enumerate(tables.items()):
        require(df, name)
        k, v = fresh(df, f"_k{i}"), fresh(df, f"_v{i}")
        if isinstance(table, str):
            held = df.sparkSession.read.parquet(table).select(F.col("k").alias(k), F.col("v").cast(kind).alias(v))
            out = out.join(held, _text(name) == F.col(k), "left")
            found = F.col(v)
        elif len(table) <= IN_PLAN:
            found = F.lit(None).cast(kind)
            if table:
                found = F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v).cast(kind))]), _text(name))
        else:
            held = df.sparkSession.createDataFrame(list(table.items()), f"{k} string, {v} {kind}")
            out = out.join(F.broadcast(held), _text(name) == F.col(k), "left")  # MAX_CATEGORIES rows at most
            found = F.col(v)
        values[name] = F.when(col(name).isNotNull(), F.coalesce(found, unknown[name]))
    return out.select(*[values.get(c, col(c)).alias(c) for c in df.columns])


class OneHotEncoder(Transformer):
    """A 0/1 column ``{column}_{category}`` for each category, in place of the column. Nulls are 0 throughout.

    Categories are in the order they first appear, given ``order_by``, or sorted.
    """

    def __init__(self, columns: Sequence[str], drop_first: bool = False, handle_unknown: str = "ignore", order_by: Sequence[str] | None = None) -> None:
        if handle_unknown not in ("ignore", "error"):
            raise InvalidArgument("handle_unknown is ignore or error")
        self.columns, self.drop_first, self.handle_unknown, self.order_by = list(columns), drop_first, handle_unknown, order_by

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        return {"categories": {c: _categories(df, c, self.order_by) for c in self.columns}}

    def _transform(self, df: DataFrame) -> DataFrame:
        require(df, *self.columns)
        made = [col(c) for c in df.columns if c not in self.columns]
        for c, categories in self.state["categories"].items():
            value = _text(c)
            if self.handle_unknown == "error":
                wrong = F.concat(F.lit(f"unknown category in {c}: "), value)
                value = F.when(value.isNull() | value.isin(categories), value).otherwise(F.raise_error(wrong).cast("string"))
            for k in categories[1:] if self.drop_first else categories:
                made.append(F.coalesce((value == k).cast("long"), F.lit(0).cast("long")).alias(f"{c}_{k}"))
        return df.select(*made)

    @property
    def categories(self) -> dict[str, list[str]]:
        return dict(self.state["categories"])


class _Codes(Transformer):
    """Whole numbers for categories; an unknown one fails the query."""

    column: str

    def _transform(self, df: DataFrame) -> DataFrame:
        wrong = F.raise_error(F.concat(F.lit(f"unknown category in {self.column}: "), _text(self.column))).cast("long")
        return _mapped(df, {self.column: self.state["mapping"]}, "long", {self.column: wrong})

    @property
    def mapping(self) -> dict[str, int]:
        return dict(_plain({self.column: self.state["mapping"]})[self.column])


class LabelEncoder(_Codes):
    """0, 1, ... for categories as they first appear, given ``order_by``, or sorted. Nulls stay null."""

    def __init__(self, column: str, order_by: Sequence[str] | None = None) -> None:
        self.column, self.order_by = column, order_by

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        found, key = _distinct(df, self.column, self.order_by)
        return {"mapping": _kept(with_row_id(found, key, "_code").select("v", "_code"), "v", "_code")}

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Codes back to the categories' text; an unknown code fails the query."""
        back = self.state["mapping"]
        if isinstance(back, str):
            found = df.sparkSession.read.parquet(back).select(F.col("v").cast("string").alias("i"), "k")
            back = _kept(found, "i", "k")
        else:
            back = {str(i): k for k, i in back.items()}
        wrong = F.raise_error(F.concat(F.lit("unknown code: "), _text(self.column))).cast("string")
        return _mapped(df, {self.column: back}, "string", {self.column: wrong})


class OrdinalEncoder(_Codes):
    """The position of each category in the list given."""

    def __init__(self, column: str, categories: Sequence[str]) -> None:
        self.column, self.categories = column, list(categories)

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        require(df, self.column)
        return {"mapping": {str(k): i for i, k in enumerate(self.categories)}}


class TargetEncoder(Transformer):
    """(sum of the target + smooth * overall mean) / (rows + smooth), over rows where both have values.

    Unknown categories take the overall mean; nulls stay null.
    """

    def __init__(self, columns: Sequence[str], smooth: float = 1.0) -> None:
        self.columns, self.smooth = list(columns), smooth

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        if target is None:
            raise InvalidArgument("a target encoder needs a target")
        require(df, target, *self.columns)
        y = col(target).cast("double")
        mean = df.agg(F.avg(y)).first()[0]
        if mean is None:
            raise InvalidArgument(f"the target {target!r} has no values")
        tables = {}
        for c in self.columns:
            both = df.filter(col(c).isNotNull() & y.isNotNull())
            enc = (F.sum(y) + F.lit(self.smooth * mean)) / (F.count(y) + F.lit(float(self.smooth)))
            tables[c] = _kept(both.groupBy(_text(c).alias("k")).agg(enc.alias("v")), "k", "v")
        return {"mean": mean, "mapping": tables}

    def _transform(self, df: DataFrame) -> DataFrame:
        return _mapped(df, self.state["mapping"], "double", {c: F.lit(self.state["mean"]) for c in self.columns})

    @property
    def mapping(self) -> dict[str, dict[str, float]]:
        return _plain(self.state["mapping"])


class FrequencyEncoder(Transformer):
    """How many rows have the category, or their share of those that have one. Unknown ones are 0, nulls stay null."""

    def __init__(self, columns: Sequence[str], normalize: bool = False) -> None:
        self.columns, self.normalize = list(columns), normalize

    def _fit(self, df: DataFrame, target: str | None) -> dict:
        require(df, *self.columns)
        tables = {}
        for c in self.columns:
            known = df.filter(col(c).isNotNull())
            n = (known.count() or 1) if self.normalize else 1
            tables[c] = _kept(known.groupBy(_text(c).alias("k")).agg((F.count(F.lit(1)) / F.lit(n)).alias("v")), "k", "v")
        return {"mapping": tables}

    def _transform(self, df: DataFrame) -> DataFrame:
        return _mapped(df, self.state["mapping"], "double", {c: F.lit(0.0) for c in self.columns})

    @property
    def mapping(self) -> dict[str, dict[str, float]]:
        return _plain(self.state["mapping"])
