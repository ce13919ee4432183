"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own. The
shards take turns, in proportion to their weights, to claim the next slot they
prefer that is free, until none is. A key's shard is that of the slot its hash
falls on. If a shard is added or lost, few keys move that need not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, materialise

#: The table's size, a prime much larger than the number of shards.
SLOTS = 65_537
SHARDS = 64
#: The table is broadcast, so no more slots than this are allowed.
MAX_SLOTS = 1 << 22


def _number(text: str, salt: int) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")


def fill_table(shards: list[str], slots: int = SLOTS, weights: list[float] | None = None) -> list[int]:
    """The position in ``shards`` of each slot's owner. ``slots`` is a prime of at least the number of shards."""
    if slots > MAX_SLOTS:
        raise ValueError(f"{slots} slots are more than {MAX_SLOTS}")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not a prime")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    weights = weights or [1.0] * len(shards)
    if len(weights) != len(shards) or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be one for each shard, none negative, not all 0")
    offset = [_number(s, 1) % slots for s in shards]
    skip = [_number(s, 2) % (slots - 1) + 1 for s in shards]
    step = [w / max(weights) for w in weights]
    asked, credit = [0] * len(shards), [0.0] * len(shards)
    owner, free = [-1] * slots, slots
    while free:
        for s in range(len(shards)):
            credit[s] += step[s]
            if credit[s] < 1:
                continue
            credit[s] -= 1
            while True:
                at = (offset[s] + asked[s] * skip[s]) % slots
                asked[s] += 1
                if owner[at] < 0:
                    break
            owner[at] = s
            free -= 1
            if not free:
                break
    return owner


def slot_table(spark: SparkSession, shards: list[str], slots: int = SLOTS, weights: list[float] | None = None) -> DataFrame:
    """``slot``, ``shard`` (position), ``shard_name``: as many rows as slots, whatever the data."""
    owner = fill_table(shards, slots, weights)
    rows = [(k, s, shards[s]) for k, s in enumerate(owner)]
    return spark.createDataFrame(rows, "slot long, shard int, shard_name string")


def assign_shards(
    df: DataFrame, keys: list[str], shards: list[str] | int = SHARDS, slots: int = SLOTS, weights: list[float] | None = None
) -> DataFrame:
    """``df``'s key columns with ``slot``, ``shard`` and ``shard_name`` for each row.

    The table is broadcast: its size is fixed by ``slots``. Placement reads the
    keys alone and moves no row. Null keys hash like any value; repeated rows
    share a shard; an empty table gives an empty table. If a key is itself named
    like one of the new columns, the key's name gets an underscore before it.
    """
    names = [f"shard-{k:05d}" for k in range(shards)] if isinstance(shards, int) else list(shards)
    table = F.broadcast(slot_table(df.sparkSession, names, slots, weights))
    own = {"slot", "shard", "shard_name"}
    kept = [col(k).alias("_" + k if k.lower() in own else k) for k in keys]
    placed = df.select(*kept, F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(slots)).alias("slot"))
    return placed.join(table, "slot").select(*[c for c in placed.columns if c != "slot"], "slot", "shard", "shard_name")


def write_shards(df: DataFrame, path: str, keys: list[str], shards: int = SHARDS, slots: int = SLOTS, parts_each: int = 1) -> None:
    """Write ``df`` to ``path``, one folder a shard (``shard_name=...``), each of ``parts_each`` files however unevenly keys fall.

    Rows are dealt to a shard's files in turn, whatever their keys, so that a key
    that holds most rows is still spread. All columns are kept as they are; if one
    is itself named ``shard_name``, the folders' name gets an underscore after it.
    Null keys hash like any value, repeated rows are all written, a shard without
    rows gets no folder, and an empty table gives an empty folder.
    """
    spark = df.sparkSession
    table = slot_table(spark, [f"shard-{k:05d}" for k in range(shards)], slots)
    names = df.columns
    folder = fresh(names, "shard_name")
    slot, shard, turn, place = (fresh([*names, folder], f"_{n}") for n in ("slot", "shard", "turn", "place"))
    dealt = df
    if parts_each > 1:
        # Written first, so that a task that runs twice deals its rows alike.
        dealt = materialise(df.withColumn(turn, F.monotonically_increasing_id()), "turns")
    marked = dealt.withColumn(slot, F.pmod(F.xxhash64(*[col(k) for k in keys]), F.lit(slots))).join(
        F.broadcast(table.select(F.col("slot").alias(slot), F.col("shard").alias(shard), F.col("shard_name").alias(folder))), slot
    )
    n = shards * parts_each
    at = col(shard) * F.lit(parts_each) + (F.pmod(col(turn), F.lit(parts_each)).cast("int") if parts_each > 1 else F.lit(0))
    # The exchange places a row by the hash of a number; each (shard, file) takes one that falls on a partition of its own.
    marked = marked.withColumn(place, F.element_at(F.array(*[F.lit(x) for x in _seats(spark, n)]), at + 1))
    marked.repartition(n, col(place)).select(*[col(c) for c in names], col(folder)).write.partitionBy(folder).parquet(path)


def _seats(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions an integer whose hash falls on it."""
    found: dict[int, int] = {}
    begin, size = 0, max(64, 16 * n)
    while len(found) < n:
        rows = spark.range(begin, begin + size).select(F.col("id").cast("int").alias("x")).groupBy(F.pmod(F.hash("x"), F.lit(n)).alias("p")).agg(F.min("x").alias("x")).collect()
        for r in rows:
            found.setdefault(r["p"], r["x"])
        begin += size
    return [found[p] for p in range(n)]
