import hashlib
import os
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from loomframe.llm import queries, sharding


def test_tables_are_full_and_even():
    owner = sharding.fill_table([f"s{k}" for k in range(7)], 1009)
    counts = Counter(owner)
    assert len(owner) == 1009 and max(counts.values()) - min(counts.values()) <= 1
    assert owner == sharding.fill_table([f"s{k}" for k in range(7)], 1009)
    two = Counter(sharding.fill_table(["a", "b", "c"], 1009, [2, 1, 0]))
    assert two[2] == 0 and abs(two[0] - 2 * two[1]) <= 3


def test_each_shard_claims_by_its_own_order():
    shards, slots = ["a", "b", "c"], 13
    want = {}
    prefer = [[(sharding._number(s, 1) + j * (sharding._number(s, 2) % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
    assert all(sorted(p) == list(range(slots)) for p in prefer)
    turn = 0
    while len(want) < slots:
        at = next(x for x in prefer[turn % 3] if x not in want)
        want[at] = turn % 3
        turn += 1
    assert sharding.fill_table(shards, slots) == [want[k] for k in range(slots)]


def test_few_keys_move_when_a_shard_goes():
    names = [f"s{k}" for k in range(10)]
    a, b = sharding.fill_table(names, 10007), sharding.fill_table(names[:-1], 10007)
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 9)
    assert moved < 0.1 * 10007


def test_bad_arguments():
    for shards, slots, weights in ([["a"], 12, None], [[], 13, None], [["a", "a"], 13, None], [["a"], 13, [0]], [["a", "b"], 13, [1]]):
        with pytest.raises(ValueError):
            sharding.fill_table(shards, slots, weights)


def test_documents_are_placed_by_the_table(docs_of):
    rows = [(i, "x") for i in range(500)] + [(None, None), (None, None), (7, "x")]
    df = docs_of(rows, clashing=True)
    placed = sharding.assign_shards(df, ["doc_id"], 5, 101).collect()
    owner = sharding.fill_table([f"shard-{k:05d}" for k in range(5)], 101)
    assert len(placed) == 503 and all(owner[r["slot"]] == r["shard"] and r["shard_name"] == f"shard-{r['shard']:05d}" for r in placed)
    assert len({r["shard"] for r in placed if r["doc_id"] is None}) == 1
    assert len({r["shard"] for r in placed if r["doc_id"] == 7}) == 1
    assert sharding.assign_shards(docs_of([]), ["doc_id"]).count() == 0
    clash = sharding.assign_shards(df.withColumn("slot", F.lit(1)), ["slot"], 5, 101)
    assert clash.columns == ["_slot", "slot", "shard", "shard_name"] and clash.count() == 503


def test_written_shards_hold_all_rows(spark, docs_of, tmp_path):
    df = docs_of([(i, "x") for i in range(300)])
    sharding.write_shards(df, str(tmp_path / "o"), ["doc_id"], 4, 101, parts_each=2)
    back = spark.read.parquet(str(tmp_path / "o"))
    assert back.count() == 300 and back.select("shard_name").distinct().count() == 4


def brute_table(names, slots):
    """The table by hand: shards claim in turn the next free slot of their own order."""

    def number(name, salt):
        return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")

    orders = [iter([(number(n, 1) + j * (number(n, 2) % (slots - 1) + 1)) % slots for j in range(slots)]) for n in names]
    owner, turn = {}, 0
    while len(owner) < slots:
        at = next(x for x in orders[turn % len(names)] if x not in owner)
        owner[at] = turn % len(names)
        turn += 1
    return owner


def test_the_query_against_brute_force(spark, tmp_path):
    ids = [*range(-50, 400), 2**62, -(2**63), None]
    spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    owner = brute_table([f"shard-{k:05d}" for k in range(64)], 65_537)
    got = {r["doc_id"]: r for r in queries.op8_sharding(spark, str(tmp_path)).collect()}
    assert set(got) == set(ids)
    for i, r in got.items():
        h = 42 if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
        slot = (h - 2**64 if h >= 2**63 else h) % 65_537
        assert (r["slot"], r["shard"], r["shard_name"]) == (slot, owner[slot], f"shard-{owner[slot]:05d}")


def test_written_columns_are_kept_whatever_their_names(spark, tmp_path):
    rows = [(i % 5, f"k{i}", i, "x" * 100_000 if i == 3 else "y", None) for i in range(200)]
    df = spark.createDataFrame(rows, "slot int, shard_name string, _turn int, shard string, place string").repartition(3)
    for key in ("slot", "shard_name", "shard"):
        where = str(tmp_path / key)
        sharding.write_shards(df, where, [key], 4, 101, parts_each=2)
        back = spark.read.parquet(where)
        assert back.columns == [*df.columns, "shard_name_"]
        assert sorted(map(str, back.drop("shard_name_").collect())) == sorted(map(str, df.collect()))
    sharding.write_shards(df.limit(0), str(tmp_path / "none"), ["slot"], 4, 101)


def test_a_hot_key_is_spread_over_its_shards_files(spark, tmp_path):
    df = spark.range(4000).selectExpr("IF(id % 2 = 0, 7, id) AS k", "id AS v").repartition(5)
    where = str(tmp_path / "hot")
    sharding.write_shards(df, where, ["k"], 4, 101, parts_each=3)
    assert spark.read.parquet(where).count() == 4000
    for folder in [f for f in os.listdir(where) if f.startswith("shard_name=")]:
        files = [f for f in os.listdir(f"{where}/{folder}") if f.endswith(".parquet")]
        sizes = [spark.read.parquet(f"{where}/{folder}/{f}").count() for f in files]
        assert len(sizes) == 3 and max(sizes) < 1.2 * sum(sizes) / 3


def test_too_many_slots():
    with pytest.raises(ValueError, match="more than"):
        sharding.fill_table(["a"], sharding.MAX_SLOTS + 1)


def test_long_keys(spark):
    keys = ["k" * 1_000_000, "k" * 1_000_000, "k" * 999_999, "", None]
    placed = sharding.assign_shards(spark.createDataFrame([(k, "x") for k in keys], "key string, v string"), ["key"], 5, 101).collect()
    owner = sharding.fill_table([f"shard-{k:05d}" for k in range(5)], 101)
    for r in placed:
        h = 42 if r["key"] is None else xxhash.xxh64_intdigest(r["key"].encode(), 42)
        assert r["slot"] == (h - 2**64 if h >= 2**63 else h) % 101 and r["shard"] == owner[r["slot"]]
