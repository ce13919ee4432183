"""Near-duplicate detection: SimHash fingerprints joined by Golay-code fuzzy keys.

Fingerprints of 64 bits are cut into three segments. If two fingerprints differ
in at most two bits, then in the ring of the three segments there is one without
an error whose successor has at most one. So a key is such a pair of segments:
the first verbatim, the second as the index of a nearby codeword of the perfect
binary Golay code. A 23-bit word within distance 2 of its codeword is
covered by it together with all its neighbours; a word at distance 3 gets the
five codewords at distance 4 as well, so that two words one bit apart always
share an index. Fingerprints that share a key are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, row_keys, text_of
from .components import connected_components

SHINGLE = 3
SEED = 42
#: Widths of the three segments, and where each begins.
WIDTHS, STARTS = (22, 21, 21), (0, 22, 43)
#: Buckets of up to so many fingerprints are compared pair by pair; larger ones by words between.
BUCKET = 256
#: Fingerprints whose keys, about 16 each, make a partition.
PRINTS = 200_000
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the binary Golay code of length 23.
GENERATOR = 0b101011100011
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TO_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def words_of(text: str) -> list[bytes]:
    """The words of a text: ASCII blanks part them, and A to Z are lowered."""
    # UTF-8 keeps ASCII bytes apart from all others.
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).translate(_TO_BLANK).split(b" ")
    return [w for w in words if w]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: bit k is 1 if set in over half the XXH64 of its shingles.

    No words give 0; fewer words than a shingle needs are one shingle.
    """
    words = words_of(text)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        to = min(n, at + (1 << 16))
        spans = zip(begins[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)
        hashes = np.fromiter((h(joined[b:e], SEED) for b, e in spans), np.uint64, to - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id``, ``_k1``, ``_k2`` (row keys), ``f`` (the fingerprint as a signed long), one row per row."""
    source = docs.select(col(id_col).alias("id"), *row_keys(id_col, text_col), text_of(text_col).alias("t"))
    keys = source.select("id", "_k1", "_k2").schema.fields
    out = pa.schema([pa.field("id", _arrow(keys[0].dataType)), pa.field("_k1", pa.int64()), pa.field("_k2", pa.int64()), pa.field("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(x, shingle) for x in b.column(3).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(f)], schema=out)

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, _k1 long, _k2 long, f long")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# --- the Golay code -------------------------------------------------------


def _remainder(words: np.ndarray) -> np.ndarray:
    """The syndrome: each 23-bit word modulo the generator."""
    r = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        r ^= np.where((r >> bit) & 1, GENERATOR << (bit - 11), 0)
    return r


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the one error of at most 3 bits, its weight, and the errors of 4 bits (or -1)."""
    one = 1 << np.arange(23, dtype=np.int64)
    i, j = np.triu_indices(23, 1)
    two = one[i] | one[j]
    three = np.unique((two[:, None] | one[None, :]).ravel())
    three = three[np.bitwise_count(three) == 3]
    four = np.unique((three[:, None] | one[None, :]).ravel())
    four = four[np.bitwise_count(four) == 4]
    error = np.zeros(2048, np.int64)
    for words in (one, two, three):
        error[_remainder(words)] = words
    weight = np.bitwise_count(error)
    s = _remainder(four)
    order = np.argsort(s, kind="stable")
    s, four = s[order], four[order]
    first = np.searchsorted(s, np.arange(2048))
    more = np.full((2048, 5), -1, np.int64)
    for k in range(5):
        at = np.minimum(first + k, len(s) - 1)
        fits = (s[at] == np.arange(2048)) & (weight == 3)
        more[fits, k] = four[at][fits]
    return error, weight, more


def nearby(words: np.ndarray) -> np.ndarray:
    """Codeword indices (12 bits) near each 23-bit word: 6 columns, -1 where there are fewer."""
    error, _, more = _tables()
    s = _remainder(words)
    out = np.full((len(words), 6), -1, np.int64)
    out[:, 0] = (words ^ error[s]) >> 11
    for k in range(5):
        e = more[s, k]
        out[:, k + 1] = np.where(e >= 0, (words ^ e) >> 11, -1)
    return out


def fuzzy_keys(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64): positions in ``f`` and, for each, a key."""
    parts = [((f >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(STARTS, WIDTHS, strict=True)]
    near = [nearby(p) for p in parts]
    at, keys = [], []
    for i in range(3):
        j = (i + 1) % 3
        row, k = np.nonzero(near[j] >= 0)
        at.append(row)
        keys.append((i << 40) | (parts[i][row] << 12) | near[j][row, k])
    return np.concatenate(at), np.concatenate(keys)


# --- linking --------------------------------------------------------------


def _forest(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what differs in at most two bits within a bucket: one for each member at most.

    A search by levels: the members reached last are compared with those not
    reached yet, in blocks, so that memory stays small however dense the bucket.
    """
    a, b = [], []
    rest = f
    while len(rest) > 1:
        level, rest = rest[:1], rest[1:]
        while len(level) and len(rest):
            reached = []
            for at in range(0, len(level), 256):
                block = level[at : at + 256]
                near = np.bitwise_count(block[:, None] ^ rest[None, :]) <= 2
                hit = near.any(axis=0)
                if hit.any():
                    a.append(rest[hit])
                    b.append(block[near[:, hit].argmax(axis=0)])
                    reached.append(rest[hit])
                    rest = rest[~hit]
            level = np.concatenate(reached) if reached else rest[:0]
    if not a:
        return f[:0], f[:0]
    return np.concatenate(a), np.concatenate(b)


def _pairs(alone: list, left: list, right: list) -> Iterator[pa.RecordBatch]:
    if alone:
        a = np.concatenate(alone)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64())], names=["a", "b"])
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def fuzzy_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join all fingerprints differing in at most two bits.

    ``prints`` has distinct fingerprints ``f``. The keys are dealt out by range
    over key and fingerprint, so that no bucket weighs on one task. A bucket
    that is larger than ``bucket`` or touches a partition's edge isn't held:
    its members are returned as ``b`` null, for :func:`midpoint_links`.
    Links within a bucket are a spanning forest, never all pairs.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(f), 4096):
                part = f[at : at + 4096]
                row, key = fuzzy_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["k", "f"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, f, edge = np.empty(0, np.int64), np.empty(0, np.int64), True  # the last group so far, and if it can't be held
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.concatenate([k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([f, batch.column(1).to_numpy(zero_copy_only=False)])
            begins = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1])
            sizes = np.diff(begins)  # of all groups but the last
            alone, left, right = [], [], []
            for g in np.flatnonzero(sizes > 1).tolist() + ([0] if len(sizes) and sizes[0] == 1 and edge else []):
                members = f[begins[g] : begins[g] + sizes[g]]
                if sizes[g] > bucket or g == 0 and edge:
                    alone.append(members)
                else:
                    x, y = _forest(members.view(np.uint64))
                    left.append(x.view(np.int64))
                    right.append(y.view(np.int64))
            if len(sizes):
                edge = False
            k, f = k[begins[-1] :], f[begins[-1] :]
            if len(f) > bucket:
                alone.append(f)
                k, f, edge = k[-1:], f[-1:], True
            yield from _pairs(alone, left, right)
        if len(f):
            yield from _pairs([f], [], [])

    keys = prints.select("f").mapInArrow(make, "k long, f long")
    least = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, least, -(-prints.count() // PRINTS))
    return keys.repartitionByRange(n, "k", "f").sortWithinPartitions("k", "f").mapInArrow(link, "a long, b long")


def midpoint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints ``f`` differing in at most two bits.

    Such two have a word within one bit of both. Each fingerprint names the 65
    words within one bit; no word is named by more than 65 fingerprints, so no
    group is large. The cost is linear in the fingerprints given.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), k) for k in range(64)])
    words = prints.select("f", F.explode(flips).alias("e")).select("f", F.col("f").bitwiseXOR(F.col("e")).alias("w"))
    groups = words.groupBy("w").agg(F.collect_set("f").alias("fs")).filter(F.size("fs") > 1)
    return groups.select(F.array_min("fs").alias("b"), F.explode("fs").alias("a")).filter("a <> b").select("a", "b").distinct()


def near_components(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``node``, ``component`` for those distinct fingerprints ``f`` that have a link."""
    found = materialise(fuzzy_links(prints, bucket), "pairs")
    close = found.filter("b IS NOT NULL")
    wide = found.filter("b IS NULL").select(F.col("a").alias("f")).distinct()
    return connected_components(close.unionAll(midpoint_links(wide)))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET
) -> DataFrame:
    """Each row of ``docs`` with its fingerprint and the component it belongs to.

    Returns the id, ``fingerprint`` (16 hex digits), ``component_id`` (the
    smallest id reachable by links of fingerprints that differ in two bits or
    fewer), the row keys ``_k1``, ``_k2`` and ``stays``, true for the rows of
    each component that agree with its first in id and text.

    Null text counts as empty: fingerprint zero, linked like any other. A null
    id is larger than all others: the component's id is null only if all of its
    ids are. Repeated rows come back as often as they came. An empty table gives
    an empty table. Other columns are ignored whatever their names.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "prints")
    least = F.min(F.struct(F.col("id").isNull().alias("x"), "id", "_k1", "_k2"))
    prints = materialise(rows.groupBy("f").agg(least.alias("least")), "distinct")
    linked = near_components(prints.select("f"), bucket)
    of = prints.join(linked.withColumnRenamed("node", "f"), "f", "left").select("f", "least", F.coalesce("component", "f").alias("c"))
    # Written, so that the join may split a component of many fingerprints among tasks.
    of = materialise(of, "members")
    first = materialise(of.groupBy("c").agg(F.min("least").alias("first")), "firsts")
    out = rows.join(of.join(first, "c").select("f", "first"), "f")
    same = (F.col("_k1") == F.col("first._k1")) & (F.col("_k2") == F.col("first._k2"))
    return out.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"),
        same.alias("stays"),
        "_k1",
        "_k2",
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``docs`` with one document of each group of near copies, that with the smallest id; all columns kept.

    Near copies have word shingles of a Jaccard similarity of ``similarity`` or
    more. Fingerprints that Golay keys bring together are candidates, and so are
    sets that agree in a band of minima: at 0.8, fingerprints differ in about
    ten bits, which the keys do not reach (:mod:`.shingles`). Every link is
    verified on the whole sets of shingles.

    Null text counts as empty; documents without words are alike. A null id is
    larger than all others. Repeated rows stay once. An empty table gives an
    empty table. Other columns are kept and ignored whatever their names.
    """
    from .shingles import drop_similar

    return drop_similar(docs, id_col, text_col, words, similarity)
