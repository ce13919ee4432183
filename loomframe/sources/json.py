"""JSON as records, columns or lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import col
from ..errors import InvalidArgument, InvalidShape


def read_json(spark: SparkSession, path: str, orient: str = "records", lines: bool = False, numbers_as_double: bool = False, schema=None) -> DataFrame:
    """records: an array of objects, keys united and missing ones null; columns: an object of arrays of one length; lines: an object a line.

    Lines are split among tasks; a file of the other two is read by one.
    """
    if orient not in ("records", "columns"):
        raise InvalidArgument(f"orient is records or columns, not {orient!r}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if lines:
        df = reader.option("mode", "FAILFAST").json(path)
    elif orient == "records":
        df = reader.option("multiLine", True).option("mode", "FAILFAST").json(path)
    else:
        df = _columns(reader.option("multiLine", True).option("mode", "FAILFAST").json(path))
    if numbers_as_double:
        df = df.select(*[(col(f.name).cast("double") if isinstance(f.dataType, T.NumericType) else col(f.name)).alias(f.name) for f in df.schema.fields])
    return df


def _columns(df: DataFrame) -> DataFrame:
    names = df.columns
    sizes = df.select(F.array(*[F.size(col(n)) for n in names]).alias("s")).filter(F.array_min("s") != F.array_max("s"))
    if not sizes.isEmpty():
        raise InvalidShape(f"the arrays of {path_names(names)} differ in length")
    zipped = F.arrays_zip(*[col(n) for n in names])
    return df.select(F.explode(zipped).alias("r")).select(*[F.col("r")[n].alias(n) for n in names])


def path_names(names: list[str]) -> str:
    return ", ".join(names[:5]) + (", ..." if len(names) > 5 else "")


def _field(array: str, name: str):
    """One field of each struct in an array."""
    return F.transform(array, lambda r: r[name]).alias(name)


#: One JSON text is one row of one task: no more bytes than this are gathered.
MAX_TEXT = 1 << 30


def write_json(df: DataFrame, path: str, orient: str = "records", lines: bool = False, mode: str = "error", indent: int | None = None) -> None:
    """lines: a folder of files, written in parallel, nulls written out.

    records and columns are one JSON text, which one task gathers: frames whose
    text would be above MAX_TEXT bytes are InvalidArgument, and are written as lines.
    """
    if orient not in ("records", "columns"):
        raise InvalidArgument(f"orient is records or columns, not {orient!r}")
    if lines:
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
        return
    row = F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    size = df.agg(F.sum(F.octet_length(row))).first()[0] or 0
    if size > MAX_TEXT:
        raise InvalidArgument(f"{size} bytes are too many for one JSON text; write lines")
    options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if indent else {})
    if orient == "records":
        whole = df.agg(F.to_json(F.collect_list(F.struct(*[col(c) for c in df.columns])), options).alias("value"))
    else:
        # collect_list leaves nulls out, so values travel in structs.
        rows = df.agg(F.collect_list(F.struct(*[col(c) for c in df.columns])).alias("r"))
        whole = rows.select(F.to_json(F.struct(*[_field("r", c) for c in df.columns]), options).alias("value"))
    whole.coalesce(1).write.mode(mode).text(path)
