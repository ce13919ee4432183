"""The Spark session with the settings this library is tested under."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import InvalidArgument


def get_or_create(app: str = "loomframe", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """An existing session, or a new one with UTC times, ANSI mode and adaptive execution.

    master: by default what spark-submit or the environment says, else all local
    cores. shuffle_partitions: left to Spark on a cluster, where adaptive
    execution merges small ones.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    master = master or os.environ.get("LOOMFRAME_MASTER")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_OWN: dict[str, str] = {}


def scratch_path(spark: SparkSession, tag: str) -> str:
    """An unused path in the folder that all executors share, ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves, but only for a local master: on
    a cluster each machine would have a folder of its own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise InvalidArgument("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _OWN.setdefault(sc.applicationId, "")
        if not base:
            base = _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="loomframe-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a lost executor costs no recomputation of what lies before, and values stay as they are."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
