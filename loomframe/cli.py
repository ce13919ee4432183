"""Command line: info, head, tail, describe, convert, filter, select."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import col, require
from .errors import FrameError
from .operators import agg, select
from .rows import ROW, with_row_id
from .session import get_or_create
from .sources import csv, json


def read(spark: SparkSession, path: str) -> DataFrame:
    """By the file's ending: .csv, .json (records), .jsonl, else Parquet."""
    kind = Path(path).suffix.lower()
    if kind == ".csv":
        return csv.read_csv(spark, path)
    if kind in (".json", ".jsonl", ".ndjson"):
        return json.read_json(spark, path, lines=kind != ".json")
    return spark.read.parquet(path)


def write(df: DataFrame, path: str) -> None:
    kind = Path(path).suffix.lower()
    if kind == ".csv":
        csv.write_csv(df, path)
    elif kind in (".json", ".jsonl", ".ndjson"):
        json.write_json(df, path, lines=kind != ".json")
    else:
        df.write.parquet(path)


def _in_file_order(df: DataFrame) -> DataFrame:
    return with_row_id(df.withColumn("_file_at", F.monotonically_increasing_id()), "_file_at").drop("_file_at")


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomframe", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("info", "describe"):
        commands.add_parser(name).add_argument("file")
    for name in ("head", "tail"):
        p = commands.add_parser(name)
        p.add_argument("file")
        p.add_argument("-n", type=int, default=10)
    p = commands.add_parser("convert")
    p.add_argument("input")
    p.add_argument("output")
    p = commands.add_parser("filter")
    p.add_argument("file")
    p.add_argument("-c", "--column", required=True)
    p.add_argument("-v", "--value", required=True)
    p = commands.add_parser("select")
    p.add_argument("file")
    p.add_argument("-c", "--columns", required=True, help="names, parted by commas")
    a = parser.parse_args(argv)
    spark = get_or_create()
    try:
        df = read(spark, a.input if a.command == "convert" else a.file)
        if a.command == "info":
            print(f"rows\t{df.count()}\ncolumns\t{len(df.columns)}")
            for n, kind in df.dtypes:
                print(f"{n}\t{kind}")
        elif a.command == "describe":
            print(select.show_text(agg.describe(df), 10_000))
        elif a.command == "convert":
            write(df, a.output)
        elif a.command == "head":
            print(select.show_text(df, a.n))
        elif a.command == "tail":
            print(select.show_text(select.tail(_in_file_order(df), a.n, ROW).drop(ROW), a.n))
        elif a.command == "filter":
            require(df, a.column)
            print(select.show_text(df.filter(col(a.column).cast("string") == a.value), 1000))
        else:
            names = a.columns.split(",")
            require(df, *names)
            print(select.show_text(select.select(df, *names), 1000))
    except FrameError as e:
        parser.exit(1, f"{type(e).__name__}: {e}\n")
    return 0
