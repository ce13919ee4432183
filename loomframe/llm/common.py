"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}
#: What one partition of a range holds: bytes of the input as stored, and the most partitions made.
PARTITION_BYTES, MOST_PARTITIONS = 128 << 20, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) a folder of
    this application is made; on a cluster each machine would have one of its own.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _OWN_DIRS:
        _OWN_DIRS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="loomframe-")
    return _OWN_DIRS[sc.applicationId]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs no recomputation of what lies
    before, and values such as row numbers made on the way stay as they are.
    """
    path = new_path(df.sparkSession, tag)
    _MADE.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_made(spark: SparkSession) -> int:
    """How many tables :func:`materialise` has made for this application and :func:`release` has not deleted."""
    return len(_MADE.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that :func:`materialise` made for this application, from the one numbered ``since`` on and but for the last ``keep``.

    Frames that read them can't be used any more.
    """
    sc = spark.sparkContext
    made = _MADE.get(sc.applicationId, [])
    end = len(made) - keep
    gone = made[since:end]
    del made[since:end]
    if not made and sc.applicationId in _OWN_DIRS:
        gone.append(_OWN_DIRS.pop(sc.applicationId))
    for name in gone:
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(df: DataFrame) -> int:
    """Partitions for a range over ``df``: the session's number for shuffles, or more if the input is large."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, least, min(-(-size // PARTITION_BYTES), MOST_PARTITIONS))


def fresh(names: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores added until no name in ``names`` equals it, case ignored."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits that tell a row's id and text: two 64-bit hashes, salted apart."""
    return [
        F.xxhash64(F.lit(1), col(id_col), text_of(text_col)).alias("_k1"),
        F.xxhash64(F.lit(2), text_of(text_col), col(id_col)).alias("_k2"),
    ]


def keep_rows(docs: DataFrame, keep: DataFrame, id_col: str, text_col: str, once: bool) -> DataFrame:
    """The rows of ``docs`` whose :func:`row_keys` are in ``keep`` (columns _k1, _k2).

    once: of rows that agree in id and text, one stays. Both steps use the same
    partitioning, so the texts move at most once.
    """
    k1, k2 = fresh(docs.columns, "_k1"), fresh(docs.columns, "_k2")
    a, b = row_keys(id_col, text_col)
    keyed = docs.select("*", a.alias(k1), b.alias(k2))
    wanted = keep.select(F.col("_k1").alias(k1), F.col("_k2").alias(k2)).distinct()
    out = keyed.join(wanted, [k1, k2], "left_semi")
    if once:
        out = out.dropDuplicates([k1, k2])
    return out.select(*[col(c) for c in docs.columns])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
