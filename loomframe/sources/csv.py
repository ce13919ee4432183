"""CSV with a list of NA strings and types inferred from all values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import col, require
from ..errors import DuplicateColumn

#: The strings that mean a missing value.
NA_VALUES = ("", "NA", "N/A", "NULL", "null", "NaN", "nan", "#N/A", "#NA", "None", "none", "-")
_INT = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"
_BOOL = r"^(?i:true|false)$"


def read_csv(
    spark: SparkSession, path: str | Sequence[str], delimiter: str = ",", header: bool = True, na_values: Sequence[str] = NA_VALUES,
    dtypes: dict[str, str] | None = None, infer: bool = True, multi_line: bool = False, **ignored,
) -> DataFrame:
    """CSV files as a typed frame.

    Types come from all values that are not NA: boolean, long, double, else
    string, in that order; a column that is NA throughout is a string. ``dtypes``
    (Spark type names) override, and a value that doesn't fit them fails. Columns
    are named col_0, col_1, ... without a header; a name twice is
    DuplicateColumn. With all types given, or ``infer=False``, the data are read
    once; inference costs one pass more. ``multi_line``: quoted values may hold
    line ends, which keeps a file in one task. Chunk sizes and parallelism are
    Spark's; arguments for them are taken and ignored.
    """
    options = {"sep": delimiter, "header": header, "inferSchema": False, "quote": '"', "escape": '"', "multiLine": multi_line, "enforceSchema": False, "emptyValue": "", "nullValue": "\x00"}
    if header:
        names = _header(spark, path, delimiter, multi_line)
        if len(set(names)) < len(names):
            raise DuplicateColumn(f"the header is {names}")
    raw = spark.read.options(**options).csv(path)
    names = names if header else [f"col_{i}" for i in range(len(raw.columns))]
    text = raw.toDF(*names)
    given = dtypes or {}
    require(text, *given)
    clean = text.select(*[F.when(~col(n).isin(*na_values), col(n)).alias(n) for n in names])
    open_ = [n for n in names if n not in given]
    kinds = dict(given) | (_infer(clean, open_) if infer and open_ else dict.fromkeys(open_, "string"))
    return clean.select(*[_parsed(col(n), kinds[n]).alias(n) for n in names])


def _header(spark: SparkSession, path, delimiter: str, multi_line: bool) -> list[str]:
    first = spark.read.options(sep=delimiter, header=False, inferSchema=False, quote='"', escape='"', multiLine=multi_line, nullValue="\x00").csv(path).first()
    return [] if first is None else ["" if v is None else v for v in first]


def _parsed(c: Column, kind: str) -> Column:
    if kind in ("boolean", "bool"):
        return F.lower(c).cast("boolean")
    return c if kind == "string" else c.cast({"int64": "long", "float64": "double"}.get(kind, kind))


def _infer(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """One pass: for each column whether all values are booleans, longs or doubles."""
    tests = []
    for i, n in enumerate(names):
        c = col(n)
        fits = {
            "boolean": c.rlike(_BOOL),
            "long": c.rlike(_INT) & c.try_cast("bigint").isNotNull(),
            "double": c.rlike(_FLOAT) & c.try_cast("double").isNotNull(),
        }
        tests += [F.every(F.when(c.isNotNull(), t)).alias(f"{k}_{i}") for k, t in fits.items()]
    found = df.agg(*tests).first()
    return {n: next((k for k in ("boolean", "long", "double") if found[f"{k}_{i}"]), "string") for i, n in enumerate(names)}


def read_csv_column(spark: SparkSession, path: str, name: str, **options) -> DataFrame:
    df = read_csv(spark, path, **options)
    require(df, name)
    return df.select(col(name))


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, na_value: str = "", single: bool = False, mode: str = "error") -> None:
    """A folder of CSV files, or of one file if ``single``, which one task must write."""
    out = df.select(*[col(c).cast("string").alias(c) for c in df.columns])
    out = out.coalesce(1) if single else out
    out.write.mode(mode).options(sep=delimiter, header=header, nullValue=na_value, emptyValue="", quote='"', escape='"').csv(path)
