"""Near copies by the Jaccard similarity of word shingles: candidates, and their verification.

A document is the set of the hashes of its shingles, and has a SimHash of that
set. Sets are compared if their fingerprints fall in one component of Golay keys
(:mod:`.simhash`), or if they agree in one of several bands of minima of the
set under independent hashes. SimHash alone does not reach a similarity of 0.8:
fingerprints of 64 bits then differ in about ten, and the keys find two. Of BANDS
bands of ROWS minima each, all miss a pair of similarity s with a chance of
(1 - s^ROWS)^BANDS: 0.00007 at 0.8, less than 10^-6 at 0.85.

A candidate whose fingerprints differ in more than APART bits is dropped (at 0.8
some 12 are expected at most, with a deviation of 3). Every other one is verified on the whole sets.

What these chances leave out is found without any loss by :func:`missed_links`.
In a common order of all shingles, two sets of a similarity s share one of the
first n - ceil(s n) + 1 of each. Such shingles that several of the components
found so far hold give the pairs that are left to verify.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, keep_rows, materialise, row_keys, text_of
from .components import connected_components
from .simhash import SEED, _arrow, near_components, words_of

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
APART = 26
#: Candidates of groups of up to GROUP are listed as pairs. Larger groups are compared in place, in blocks of about BLOCK
#: members; of groups above BLOCK, what is similar to the group's centre leaves first.
GROUP, BLOCK = 32, 512
#: Members whose sets are compared in place by a task.
MEMBERS = 50_000
#: Rows whose shingles tell which are common, about, and how many of these come last in the order. They change no result.
SAMPLE, COMMON = 5_000, 1 << 16
#: Least and most bits that hold the parity of a set's shingles: two sets differ in as many shingles at least as in these bits.
PARITY, MOST_PARITY = 1 << 10, 1 << 20
#: Bytes of a shingle's hash by which sets meet, and such keys in a task.
KEY, KEYS = 5, 2_000_000
#: Rows whose keys are dealt out at a time.
ROWS_DEALT = 2048
#: The rows of so few documents are found by broadcasting their keys, some 3 MB; those of more by a join that moves all texts.
FEW = 100_000


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, sorted (int64); no words give none, fewer than a shingle needs are one."""
    found = words_of(text)
    if not found:
        return np.empty(0, np.int64)
    joined, h, n = b" ".join(found), xxhash.xxh64_intdigest, max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(begins[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((h(joined[b:e], SEED) for b, e in spans), np.uint64, n).view(np.int64))


def set_print(s: np.ndarray) -> int:
    """The SimHash of a set of shingles (signed): a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 16):
        ones += np.unpackbits(s[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<i8")[0])


_FACTORS = np.array([xxhash.xxh64_intdigest(str(k), SEED) | 1 for k in range(BANDS * ROWS)], np.uint64)


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band: the hash of its number and of the set's minima under its ROWS hashes. An empty set has none."""
    if not len(s):
        return np.empty(0, np.int64)
    h = s.view(np.uint64)
    h = h ^ (h >> np.uint64(31))
    least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(h), 4096):  # bounded memory for very long texts
        np.minimum(least, (_FACTORS[:, None] * h[None, at : at + 4096]).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(bands[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def prefix(s: np.ndarray, similarity: float, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which one is in the first of every similar set: rare ones first, then by their hashes.

    ``common``, sorted, came so many ``times`` in a sample; others count as 0.
    """
    n = len(s)
    k = n - max(1, math.ceil(similarity * n - 1e-6)) + 1
    if not n or not len(common):
        return s[: k if n else 0]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    return s[np.argsort(np.where(common[at] == s, times[at], 0), kind="stable")[:k]]


def parity(s: np.ndarray) -> bytes:
    """The parity of how many shingles end with each value of some bits, as many values as shingles or more. Halves add up to that of a bit less."""
    wide = min(max(PARITY, 1 << max(0, len(s) - 1).bit_length()), MOST_PARITY)
    return np.packbits(np.bincount(s & (wide - 1), minlength=wide) & 1).tobytes()


def common_shingles(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come in several rows of a sample, sorted, and how often. They decide what is compared first, never what is found."""
    part = max(1, docs.count() // SAMPLE)
    source = docs.select(row_keys(id_col, text_col)[0], text_of(text_col).alias("t")).filter(F.pmod("_k1", F.lit(part)) == 0).select("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shingle_set(t.as_py(), words) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *s]))], names=["h"])

    found = source.mapInArrow(run, "h long").groupBy("h").count().filter("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    found.sort()
    return np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64)


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """``id``, ``_k1``, ``_k2``, ``f`` (a hash of the set), ``n`` (its size), ``g`` (its SimHash), ``keys`` (of its bands), ``prefix`` (KEY bytes each), ``parity``, one row per row."""
    source = docs.select(col(id_col).alias("id"), *row_keys(id_col, text_col), text_of(text_col).alias("t"))
    kind = source.schema["id"].dataType
    long = pa.int64()
    out = pa.schema([("id", _arrow(kind)), ("_k1", long), ("_k2", long), ("f", long), ("n", long), ("g", long), ("keys", pa.list_(long)), ("prefix", pa.binary()), ("parity", pa.binary())])
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, id_col, text_col, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, n, g, keys, first, bits = [], [], [], [], [], []
            for t in b.column(3):
                s = shingle_set(t.as_py(), words)
                f.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                n.append(len(s))
                g.append(set_print(s))
                keys.append(band_keys(s))
                first.append(prefix(s, similarity, *common.value).view(np.uint8).reshape(-1, 8)[:, :KEY].tobytes())
                bits.append(parity(s))
            made = [pa.array(np.array(f, np.uint64).view(np.int64)), pa.array(n, long), pa.array(g, long), pa.array(keys, pa.list_(long))]
            made += [pa.array(first, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *made], schema=out)

    return source.mapInArrow(run, f"id {kind.simpleString()}, _k1 long, _k2 long, f long, n long, g long, keys array<long>, prefix binary, parity binary")


def _distinct_sets(rows: DataFrame) -> DataFrame:
    """``f``, ``least`` (its first row), ``n``, ``g``, ``keys`` and ``parity`` of each distinct set."""
    least = F.min(F.struct(F.col("id").isNull().alias("x"), "id", "_k1", "_k2"))
    return materialise(rows.groupBy("f").agg(least.alias("least"), *[F.first(c).alias(c) for c in ("n", "g", "keys", "parity")]), "distinctsets")


def _maybe(similarity: float) -> Column:
    """Neither the sizes ``n``, ``m`` nor the fingerprints ``g``, ``h`` rule the similarity out."""
    sizes = F.least("n", "m") >= F.greatest("n", "m") * F.lit(similarity) - F.lit(1e-9)
    return sizes & (F.bit_count(F.col("g").bitwiseXOR(F.col("h"))) <= F.lit(APART))


def _sets_of(wanted: DataFrame, docs: DataFrame, first: DataFrame, text_col: str, id_col: str, words: int) -> DataFrame:
    """``f`` and ``s``, the sets of the distinct ``f`` in ``wanted``, made anew from their texts. A row that comes twice has its set twice."""
    wanted = materialise(wanted, "wanted")
    one = first.join(wanted, "f").select("f", F.col("least._k1").alias("_k1"), F.col("least._k2").alias("_k2"))
    one = F.broadcast(one) if wanted.count() <= FEW else one
    texts = docs.select(*row_keys(id_col, text_col), text_of(text_col).alias("t")).join(one, ["_k1", "_k2"]).select("f", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shingle_set(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.list_(pa.int64()))], names=["f", "s"])

    return materialise(texts.mapInArrow(run, "f long, s array<long>"), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, first: DataFrame, text_col: str, id_col: str, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets have the similarity."""
    wanted = pairs.select(F.col("a").alias("f")).unionAll(pairs.select("b")).distinct()
    sets = _sets_of(wanted, docs, first, text_col, id_col, words)
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                u, v = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(u, v, assume_unique=True))
                near.append(shared >= similarity * (len(u) + len(v) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return materialise(both.mapInArrow(compare, "a long, b long"), "near")


def _forest(f: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the members of a block that pairs of the similarity join: one for each member at most."""
    size = np.array([len(s) for s in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(size) - size
    there = np.zeros(at.max() + 1, np.int32)
    label, out = np.arange(len(f)), []
    for i in range(len(f)):
        own = at[begins[i] : begins[i] + size[i]]
        there[own] = 1
        shared = np.add.reduceat(there[at], begins)
        there[own] = 0
        for j in np.flatnonzero((shared >= similarity * (size + size[i] - shared) - 1e-9) & (label != label[i])).tolist():
            if label[j] != label[i]:
                out.append((int(f[j]), int(f[i])))
                label[label == label[j]] = label[i]
    return out


def _in_place(members: DataFrame, docs: DataFrame, first: DataFrame, text_col: str, id_col: str, words: int, similarity: float, block: int) -> DataFrame:
    """Links (a, b) within groups (``k``, ``f``, ``behind``) of any size, between members that don't stand behind a centre and all others.

    A forest for every two blocks of a group; no pair but those of links is written.
    """
    members = materialise(members, "inplace")
    blocks = lambda which: F.ceil(F.count(F.when(which, 1)) / F.lit(block)).cast("int")
    sizes = materialise(members.groupBy("k").agg(blocks(~F.col("behind")).alias("open"), blocks(F.col("behind")).alias("closed")), "blocks")
    sets = _sets_of(members.select("f").distinct(), docs, first, text_col, id_col, words)
    own = F.pmod(F.xxhash64(F.lit(SEED), "f"), F.when(F.col("behind"), F.col("closed")).otherwise(F.col("open"))).cast("int").alias("own")
    placed = members.join(sizes, "k").select("k", "f", "behind", "open", "closed", own)
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    # Open blocks meet one another, and each meets every closed one, which has a number below 0.
    met = F.transform(upto("open"), lambda o: F.when(F.col("behind"), pair(o, -1 - F.col("own"))).otherwise(pair(F.least(o, "own"), F.greatest(o, "own"))))
    closed = F.when(F.col("behind"), F.array().cast("array<struct<i:int,j:int>>")).otherwise(F.transform(upto("closed"), lambda c: pair(F.col("own"), -1 - c)))
    dealt = placed.select("k", "f", F.explode(F.concat(met, closed)).alias("at")).select("k", "at.i", "at.j", "f").join(sets.filter(F.size("s") > 0), "f")
    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-members.count() // MEMBERS))
    dealt = dealt.select("k", "i", "j", "f", "s").repartition(parts, "k", "i", "j").sortWithinPartitions("k", "i", "j", "f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def links() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                found = _forest(np.array(list(held), np.int64), list(held.values()), similarity)
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True)
            for (*now, f), s in zip(keys, batch.column(4), strict=True):
                if now != key:
                    yield from links()
                    key, held = now, {}
                held[f] = s.values.to_numpy()
        yield from links()

    return materialise(dealt.mapInArrow(run, "a long, b long"), "near")


def candidate_groups(first: DataFrame) -> DataFrame:
    """``f``, ``n``, ``g`` and ``k`` for every group that a set belongs to: one for each band, and its component of Golay keys."""
    linked = near_components(first.select(F.col("g").alias("f")).distinct()).select(F.col("node").alias("g"), "component")
    banded = first.select("f", "n", "g", F.explode("keys").alias("k"))
    # A fingerprint without links is a group of its own: sets that share it.
    golay = first.join(linked, "g", "left").select("f", "n", "g", F.xxhash64(F.lit("golay"), F.coalesce("component", "g")).alias("k"))
    return banded.unionAll(golay)


def _centres(members: DataFrame, group: int) -> DataFrame:
    """``k``, ``b``, ``m``, ``h`` and ``rank``: for each group of more than ``group`` members the one whose large groups hold most members.

    A text that many others vary is in the groups of all of them, and so is their
    centre. A centre outranks every other member of its group, so that what is
    dropped for a centre is never the centre's centre.
    """
    # Groups are written before they are joined, so that the join deals out members anew and may split a large group among tasks.
    large = materialise(members.groupBy("k").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > group), "large")
    within = materialise(members.join(large, "k").select("k", "f", "n", "g", "size"), "within")
    degree = materialise(within.groupBy("f").agg(F.sum("size").alias("d")), "degree")
    ranked = within.join(degree, "f").select("k", F.struct("d", "f", "n", "g").alias("z"))
    best = ranked.groupBy("k").agg(F.max("z").alias("z"))
    return materialise(best.select("k", F.col("z.f").alias("b"), F.col("z.n").alias("m"), F.col("z.g").alias("h")), "centres")


def similar_links(
    docs: DataFrame, first: DataFrame, id_col: str, text_col: str, words: int, similarity: float, group: int = GROUP, block: int = BLOCK
) -> DataFrame:
    """Links (a, b) between sets ``f`` of the similarity that are candidates; :func:`missed_links` finds what isn't.

    In a group of more than ``block`` each set is compared with the group's
    centre; those that are similar stand behind it, and the others are compared
    with the next centre, until a round finds no more. Groups of more than
    ``group`` are then compared in place; in those of more than ``block``, what
    stands behind a centre is compared with the rest alone. Of smaller groups
    candidates are listed as pairs.
    """
    given = (docs, first, text_col, id_col, words, similarity)
    members = candidate_groups(first)
    several = materialise(members.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "groups")
    members = materialise(members.join(several, "k"), "members")
    links, left, seen = [], members.filter(F.col("c") > block), None
    while not left.isEmpty():
        centres = _centres(left, block)
        seen = centres if seen is None else seen
        pairs = left.join(centres, "k").filter((F.col("f") != F.col("b")) & _maybe(similarity)).select(F.col("f").alias("a"), "b").distinct()
        found = _verified(materialise(pairs, "tocentre"), *given)
        if found.isEmpty():
            break
        links.append(found)
        left = materialise(left.join(found.select(F.col("a").alias("f")).distinct(), "f", "left_anti"), "left")
    large = members.filter((F.col("c") > group) & (F.col("c") <= block)).select("k", "f", F.lit(False).alias("behind"))
    if seen is not None:
        # The first centre has been compared with all of its group. Groups with nothing else left are done.
        rest = materialise(left.join(seen.select("k", F.col("b").alias("f")), ["k", "f"], "left_anti").select("k", "f"), "rest")
        whole = members.filter(F.col("c") > block).join(rest.select("k").distinct(), "k").select("k", "f")
        large = large.unionAll(rest.select("k", "f", F.lit(False))).unionAll(whole.join(rest, ["k", "f"], "left_anti").select("k", "f", F.lit(True)))
    links.append(_in_place(large, *given, block))
    shared = members.filter(F.col("c") <= group).select("k", "f", "n", "g")
    others = shared.select("k", F.col("f").alias("b"), F.col("n").alias("m"), F.col("g").alias("h"))
    rest = shared.join(others, "k").filter((F.col("f") > F.col("b")) & _maybe(similarity)).select(F.col("f").alias("a"), "b").distinct()
    out = _verified(materialise(rest, "rest"), *given)
    for found in links:
        out = out.unionAll(found)
    return out


def _shared_keys(rows: DataFrame, of: DataFrame, parts: int) -> DataFrame:
    """``k``, ``f``, ``c`` for the sets of all components ``c`` that hold a key, for each key of the sets' prefixes that several hold.

    Keys move as arrays, some 13 bytes each.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(at, ROWS_DEALT) for batch in batches for at in range(0, batch.num_rows, ROWS_DEALT)):
            f, c = (b.column(x).to_numpy(zero_copy_only=False) for x in (0, 1))
            raw = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, KEY) for x in b.column(2)]
            k = np.zeros((sum(map(len, raw)), 8), np.uint8)
            k[:, :KEY] = np.concatenate(raw)
            row = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
            part = (k.view(np.int64)[:, 0] % parts).astype(np.int32)
            order = np.argsort(part, kind="stable")
            held, begins = np.unique(part[order], return_index=True)
            own = np.split(order, begins[1:])
            arrays = [[k[x, :KEY].tobytes() for x in own], [f[row[x]].tobytes() for x in own], [(f ^ c)[row[x]].tobytes() for x in own]]
            if len(held):
                yield pa.RecordBatch.from_arrays([pa.array(held), *[pa.array(x, pa.binary()) for x in arrays]], names=["p", "k", "f", "d"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for p, *arrays in zip(*[x.to_pylist() for x in b.columns], strict=True):
                held.setdefault(p, []).append(arrays)
        for p in list(held):
            raw, f, d = (b"".join(x) for x in zip(*held.pop(p), strict=True))
            f = np.frombuffer(f, np.int64)
            c = f ^ np.frombuffer(d, np.int64)
            k = np.zeros((len(f), 8), np.uint8)
            k[:, :KEY] = np.frombuffer(raw, np.uint8).reshape(-1, KEY)
            k = k.view(np.int64)[:, 0]
            order = np.lexsort((f, c, k))
            k, f, c = k[order], f[order], c[order]
            once = np.append(True, (np.diff(k) != 0) | (f[1:] != f[:-1]))
            k, f, c = k[once], f[once], c[once]
            begins = np.flatnonzero(np.append(True, np.diff(k) != 0))
            ends = np.append(begins[1:], len(k))
            there = np.repeat(c[begins] != c[ends - 1], ends - begins)  # sorted: the first and the last component differ
            yield pa.RecordBatch.from_arrays([pa.array(x[there]) for x in (k, f, c)], names=["k", "f", "c"])

    labelled = rows.select("f", "prefix").join(F.broadcast(of) if of.count() <= FEW else of, "f", "left")
    dealt = labelled.select("f", F.coalesce("c", "f").alias("c"), "prefix").mapInArrow(deal, "p int, k binary, f binary, d binary")
    return materialise(dealt.repartition(parts, "p").mapInArrow(meet, "k long, f long, c long"), "sharedkeys")


def _possible(f: np.ndarray, c: np.ndarray, n: np.ndarray, parities: list[bytes], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different components that neither sizes nor parities rule out. Members of the largest component meet others alone."""
    _, of, count = np.unique(c, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(of != count.argmax())
    wide = np.array([len(x) for x in parities])
    folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bits(width: int, rows: np.ndarray) -> np.ndarray:
        """Parities of the width of those rows; wider ones are halved."""
        if width not in folded:
            there, made = np.flatnonzero(wide >= width), []
            for r in there.tolist():
                x = np.frombuffer(parities[r], np.uint64)
                while 8 * len(x) > width:
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                made.append(x)
            place = np.zeros(len(f), np.int64)
            place[there] = np.arange(len(there))
            folded[width] = place, np.stack(made)
        place, made = folded[width]
        return made[place[rows]]

    apart = (1 - similarity) / (1 + similarity)
    for begin in range(0, len(rest), 64):
        i = rest[begin : begin + 64]
        may = (c[i, None] != c[None, :]) & (np.minimum(n[i, None], n[None, :]) >= similarity * np.maximum(n[i, None], n[None, :]) - 1e-6)
        x, y = np.nonzero(may)
        x = i[x]
        both = np.minimum(wide[x], wide[y])
        for width in np.unique(both).tolist():
            which = np.flatnonzero(both == width)
            step = max(1, (1 << 21) // width)
            for to in range(0, len(which), step):
                u, v = x[which[to : to + step]], y[which[to : to + step]]
                near = np.bitwise_count(bits(width, u) ^ bits(width, v)).sum(axis=1, dtype=np.int64) <= apart * (n[u] + n[v]) + 1e-6
                if near.any():
                    a, b = f[u[near]], f[v[near]]
                    yield np.maximum(a, b), np.minimum(a, b)


def missed_links(
    rows: DataFrame, first: DataFrame, of: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, block: int = BLOCK
) -> DataFrame:
    """All links (a, b) of the similarity between sets of different components, ``of`` (``f``, ``c``); a set without a row there is its own.

    No pair is left out, and none is written but those that neither its sizes nor
    its parities rule out. Sets that share a key are compared in blocks of about ``block``.
    """
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = first.agg(F.sum(F.col("n") * F.lit(1 - similarity) + F.lit(1))).first()[0] or 0
    shared = _shared_keys(rows, of, max(1, least, int(keys) // KEYS))
    blocks = materialise(shared.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64(F.lit(SEED), "f"), F.col("blocks")).cast("int")
    placed = shared.join(blocks, "k").select("k", "f", "c", "blocks", own.alias("own")).join(first.select("f", "n", "parity"), "f")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "own").alias("i"), F.greatest(o, "own").alias("j")))
    dealt = placed.select("k", "f", "c", "n", "parity", F.explode(met).alias("at")).select("k", "at.i", "at.j", "f", "c", "n", "parity")
    parts = max(1, least, -(-shared.count() // MEMBERS))
    dealt = dealt.repartition(parts, "k", "i", "j").sortWithinPartitions("k", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f, c, n = (np.concatenate([b.column(x).to_numpy(zero_copy_only=False) for b in group]) for x in (3, 4, 5))
            if len(f) > 1:
                parities = [x for b in group for x in b.column(6).to_pylist()]
                for a, b in _possible(f, c, n, parities, similarity):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in range(3)])
            begins = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for at, to in zip(begins[:-1], begins[1:], strict=True):
                now = cell[:, at].tolist()
                if now != key and held:
                    yield from pairs(held)
                    held = []
                key = now
                held.append(batch.slice(at, to - at))
        if held:
            yield from pairs(held)

    found = materialise(dealt.mapInArrow(run, "a long, b long").distinct(), "missed")
    return _verified(found, docs, first, text_col, id_col, words, similarity)


def similar_components(
    rows: DataFrame, first: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, group: int = GROUP, block: int = BLOCK
) -> DataFrame:
    """``f`` and its component ``c`` for all sets that have a link, no link of the similarity left out."""
    linked = connected_components(similar_links(docs, first, id_col, text_col, words, similarity, group, block))
    of = materialise(linked.select(F.col("node").alias("f"), F.col("component").alias("c")), "linked")
    missed = missed_links(rows, first, of, docs, id_col, text_col, words, similarity, block)
    if missed.isEmpty():
        return of
    label = lambda x: of.select(F.col("f").alias(x), F.col("c").alias(f"c{x}"))
    between = missed.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = connected_components(between).select(F.col("node").alias("c"), "component")
    single = joined.select(F.col("c").alias("f"), "c").join(of, "f", "left_anti")
    return of.unionAll(single).join(joined, "c", "left").select("f", F.coalesce("component", "c").alias("c"))


def drop_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, group: int = GROUP, block: int = BLOCK
) -> DataFrame:
    """``docs`` with one document of each component of similar ones, that with the smallest id; all columns kept.

    Links are all pairs of a Jaccard similarity of ``similarity`` or more, or what
    joins the same documents: no component is parted.
    Words are parted by ASCII blanks, A to Z count as lower case. Null text
    counts as empty, and documents without words are alike. A null id is larger
    than all others. Repeated rows stay once. An empty table gives an empty table.
    """
    rows = materialise(_sets(docs, id_col, text_col, words, similarity), "shingled")
    first = _distinct_sets(rows)
    linked = similar_components(rows, first, docs, id_col, text_col, words, similarity, group, block)
    of = first.join(linked, "f", "left").select("least", F.coalesce("c", "f").alias("c"))
    keep = of.groupBy("c").agg(F.min("least").alias("least")).select("least._k1", "least._k2")
    return keep_rows(docs, keep, id_col, text_col, once=True)
