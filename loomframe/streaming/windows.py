"""Aggregates over time windows, the same for a stream and for a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import col, fresh, require
from ..session import scratch_path


def time_windows(
    df: DataFrame, time: str, width: str, *aggregates: Column, slide: str | None = None, gap: bool = False, keys: tuple[str, ...] = (), late: str | None = None
) -> DataFrame:
    """One row for each window and key: ``window_start``, ``window_end``, the keys, the aggregates.

    Tumbling windows of ``width``, sliding ones with ``slide``, sessions that end
    after ``width`` without an event with ``gap``. ``late``: how long a stream
    waits for late rows before it lets a window's state go.
    """
    require(df, time, *keys)
    # Watermarks are for times with a zone.
    rows = df.withColumn(time, col(time).cast("timestamp")).withWatermark(time, late) if late else df
    window = F.session_window(col(time), width) if gap else F.window(col(time), width, slide or width)
    found = rows.groupBy(window.alias("_window"), *[col(k) for k in keys]).agg(*aggregates)
    rest = [c for c in found.columns if c != "_window"]
    return found.select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *[col(c) for c in rest])


def run_to_end(stream: DataFrame, tag: str = "stream", keys: Sequence[str] | None = None) -> DataFrame:
    """Run a stream over what is there now, exactly once, into Parquet, and read that.

    Append mode: a window appears when the watermark has passed it, so those still
    open at the end don't. With ``keys``, the columns that tell rows of the result
    apart, windows are written whenever they change and the last state of each is
    read, open ones included (not for sessions, which Spark only appends).
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, tag), scratch_path(spark, f"{tag}-state")
    if keys is None:
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    at, kept = fresh(stream, "_batch"), set()

    def keep(changed: DataFrame, number: int) -> None:
        kept.add(number)
        # A batch that is run again writes the same folder again.
        changed.withColumn(at, F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/{number:09d}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", state).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField(at, T.LongType())])
    done = spark.read.schema(schema).parquet(f"{out}/*") if kept else spark.createDataFrame([], schema)
    rest = [c for c in stream.columns if c not in keys]
    last = done.groupBy(*[col(k) for k in keys]).agg(F.max_by(F.struct(*[col(c) for c in rest]), col(at)).alias(at))
    return last.select(*[(col(at)[c] if c in rest else col(c)).alias(c) for c in stream.columns])
