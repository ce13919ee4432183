"""Document fingerprints from Lempel-Ziv phrases.

A text's bytes are parsed into phrases, each the longest one seen before and one
byte more. Texts that compress well together share phrases. The set of phrase
hashes is kept as its smallest members, and two fingerprints estimate how far
the sets agree (their Jaccard index), a likeness close to that by compression.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, partitions_for, text_of

#: Hashes in a fingerprint.
SIZE = 64
#: Texts of more bytes keep their dictionary in flat arrays, about 6 bytes for each of the text; the parse is the same.
LONG = 1 << 22
#: A flat dictionary has room for so many phrases at first, and grows by doubling.
ROOM = 1 << 20
_MULTIPLIER, _MASK = 6364136223846793005, (1 << 64) - 1


class _Parse:
    """A parse that can be taken further, and back to where it was. Its dictionary takes some 25 bytes for each of the text."""

    __slots__ = ("at", "hashes", "number")

    def __init__(self) -> None:
        self.number: dict[int, int] = {}  # (phrase, byte) -> the longer phrase
        self.hashes = [0x9E3779B97F4A7C15]  # of each phrase, from its bytes alone
        self.at = 0  # the phrase begun

    def feed(self, data: bytes) -> None:
        number, hashes, at = self.number, self.hashes, self.at
        get, n = number.get, len(hashes)
        for byte in data:
            key = at << 8 | byte
            to = get(key)
            if to is None:
                number[key] = n
                n += 1
                hashes.append((hashes[at] * _MULTIPLIER + byte + 1) & _MASK)
                at = 0
            else:
                at = to
        self.at = at

    def back(self, phrases: int, at: int) -> None:
        """To when there were so many phrases, and this one was begun."""
        forget = self.number.popitem  # the last comes first
        for _ in range(len(self.number) - phrases):
            forget()
        del self.hashes[phrases + 1 :]
        self.at = at

    def lowest(self, begin: int, size: int) -> np.ndarray:
        """The signature of the phrases from ``begin`` on."""
        return np.unique(_mixed(np.array(self.hashes[begin + 1 :], np.uint64)))[:size]


class _LongParse:
    """The parse of :class:`_Parse` with its dictionary in flat arrays: open addressing, keys beside the phrases they lead to."""

    __slots__ = ("at", "hashes", "keys", "n", "to")

    def __init__(self, room: int = ROOM) -> None:
        self.hashes = np.zeros(room, np.uint64)
        self.hashes[0] = 0x9E3779B97F4A7C15
        self.keys, self.to = np.full(2 * room, -1, np.int64), np.zeros(2 * room, np.int32)
        self.n, self.at = 1, 0

    def feed(self, data: bytes) -> None:
        at, n = self.at, self.n
        keys, to, hashes = memoryview(self.keys), memoryview(self.to), memoryview(self.hashes)
        mask, room = len(keys) - 1, len(hashes)
        for byte in data:
            key = at << 8 | byte
            slot = (key * _MULTIPLIER >> 29) & mask
            while True:
                found = keys[slot]
                if found == key:
                    at = to[slot]
                    break
                if found < 0:
                    keys[slot], to[slot] = key, n
                    hashes[n] = (hashes[at] * _MULTIPLIER + byte + 1) & _MASK
                    n += 1
                    at = 0
                    if n == room:
                        keys = to = hashes = None
                        self._grow()
                        keys, to, hashes = memoryview(self.keys), memoryview(self.to), memoryview(self.hashes)
                        mask, room = len(keys) - 1, len(hashes)
                    break
                slot = (slot + 1) & mask
        self.at, self.n = at, n

    def _grow(self) -> None:
        self.hashes = np.concatenate([self.hashes, np.zeros(len(self.hashes), np.uint64)])
        there = self.keys >= 0
        key, value = self.keys[there], self.to[there]
        self.keys, self.to = np.full(2 * len(self.keys), -1, np.int64), np.zeros(2 * len(self.to), np.int32)
        mask = len(self.keys) - 1
        slot = ((key.astype(np.uint64) * np.uint64(_MULTIPLIER) >> np.uint64(29)) & np.uint64(mask)).astype(np.int64)
        while len(key):  # all that find their slot free are placed, one for each slot; the others go on by one
            free = np.flatnonzero(self.keys[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.keys[slot[placed]], self.to[slot[placed]] = key[placed], value[placed]
            left = np.ones(len(key), bool)
            left[placed] = False
            key, value, slot = key[left], value[left], (slot[left] + 1) & mask

    def lowest(self, begin: int, size: int) -> np.ndarray:
        return np.unique(_mixed(self.hashes[begin + 1 : self.n]))[:size]


def _parsed(data: bytes) -> _Parse | _LongParse:
    parse = _Parse() if len(data) <= LONG else _LongParse()
    parse.feed(data)
    return parse


def _phrases(data: bytes) -> np.ndarray:
    """A hash of each phrase of the parse."""
    parse = _parsed(data)
    return np.array(parse.hashes[1:], np.uint64) if isinstance(parse, _Parse) else parse.hashes[1 : parse.n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


def signature(text: str, size: int = SIZE) -> np.ndarray:
    """The smallest distinct 32-bit phrase hashes, in order."""
    return _parsed(text.encode("utf-8", "surrogatepass")).lowest(0, size)


def _merged(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    return np.union1d(a, b)[:size]


def as_text(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u4").tobytes()).decode()


def fingerprint(text: str, size: int = SIZE) -> str:
    """A text's fingerprint; equal texts have equal ones, the empty text the empty one."""
    return as_text(signature(text, size))


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The Jaccard index of two phrase sets, estimated from signatures; 1 for two empty ones."""
    union = np.union1d(a, b)[:size]
    if not len(union):
        return 1.0
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True)).sum() / len(union))


def similarity(a: str, b: str, size: int = SIZE) -> float:
    """:func:`likeness` of two fingerprints."""
    return likeness(*[np.frombuffer(base64.b64decode(x), "<u4") for x in (a, b)], size)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """The id and ``fingerprint`` of each row, whole texts read.

    Null text counts as empty, whose fingerprint is empty; rows come back as
    often as they came, null ids as any other; equal texts have equal
    fingerprints; an empty table gives an empty table. Other columns are ignored
    whatever their names.
    """
    source = docs.select(col(id_col).alias("id"), text_of(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, size) for t in b.column(1).to_pylist()], pa.string())], names=["id", "fingerprint"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by the first as many code points of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


class _Row:
    """A text, its signature, and its parse up to where an edit begins, kept for the edited text."""

    __slots__ = ("low", "parse", "sig", "text")

    def __init__(self, text: str, size: int) -> None:
        self.text, self.parse = text, None
        head = text[: len(text) - len(text) // 3].encode("utf-8", "surrogatepass")
        rest = text[len(text) - len(text) // 3 :].encode("utf-8", "surrogatepass")
        if len(head) + len(rest) > LONG:
            self.sig = signature(text, size)
            return
        parse = self.parse = _Parse()
        parse.feed(head)
        phrases, at = len(parse.number), parse.at
        self.low = parse.lowest(0, size)
        parse.feed(rest)
        self.sig = _merged(self.low, parse.lowest(phrases, size), size)
        parse.back(phrases, at)

    def compared(self, following: _Row, size: int) -> tuple:
        other = edited(self.text, following.text)
        data = other.encode("utf-8", "surrogatepass")
        if other == self.text:
            sig = self.sig
        elif self.parse is None or len(data) > LONG:
            sig = signature(other, size)
        else:
            phrases = len(self.parse.number)
            self.parse.feed(following.text[: len(self.text) // 3].encode("utf-8", "surrogatepass"))
            sig = _merged(self.low, self.parse.lowest(phrases, size), size)
        sha = hashlib.sha256(data).digest()
        return len(self.text), sha, self.sig.tobytes(), sig.tobytes(), likeness(self.sig, sig, size), likeness(self.sig, following.sig, size)


#: As they are between tasks; fingerprints and digests become text at the end.
_COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Each row's fingerprint against that of its edited text and of the next row's text.

    Rows are in descending order of id (null last), then by text; the row after
    the last is the first. Returns the id, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and ``near_next``.
    Null text counts as empty: its fingerprint is empty, and its likeness to another
    empty text 1, to others 0. A single row follows itself. Repeated rows follow
    one another. An empty table gives an empty table. Other columns are ignored
    whatever their names.

    Rows are dealt out by range, so that a row and the next are nearly always in
    one task; only the last of each task and the first of the one after meet later.
    """
    spark = docs.sparkSession
    source = docs.select(col(id_col).alias("id"), text_of(text_col).alias("t"))
    kind = source.schema["id"].dataType.simpleString()
    n = partitions_for(source)
    order = [F.desc_nulls_last("id"), F.xxhash64("t")]
    dealt = source.repartitionByRange(n, *order).sortWithinPartitions(*order, "t")
    names = ["id", "pid", "kind", *_COLUMNS, "text"]
    types = f"id {kind}, pid int, kind int, {_TYPES}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        none = (None,) * len(_COLUMNS)
        before = None
        for b in batches:
            ids, rows, slots = b.column(0), [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                row = _Row(t, size)
                if before is None:
                    rows.append((pid, 1, *none, t))
                    slots.append(ids.slice(i, 1))
                else:
                    rows.append((pid, 0, *before[1].compared(row, size), None))
                    slots.append(before[0])
                before = (ids.slice(i, 1), row)
            if rows:
                yield _batch(slots, rows, names)
        if before is not None:
            yield _batch([before[0]], [(pid, 2, *none, before[1].text)], names)

    found = materialise(dealt.mapInArrow(run, types), "lz")
    inside = found.filter("kind = 0")
    edges = found.filter("kind > 0").select("id", "pid", "kind", "text")
    pids = sorted(r["pid"] for r in edges.filter("kind = 2").select("pid").collect())  # one for each partition at most
    following = spark.createDataFrame([(p, pids[(k + 1) % len(pids)]) for k, p in enumerate(pids)], "pid int, next int")
    ends = edges.filter("kind = 2").join(F.broadcast(following), "pid").select("id", "text", "next")
    met = ends.join(edges.filter("kind = 1").select(F.col("pid").alias("next"), F.col("text").alias("head")), "next").select("id", "text", "head")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_Row(t, size).compared(_Row(h, size), size) for t, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            if rows:
                yield _batch([b.column(0)], rows, ["id", *_COLUMNS])

    rest = met.mapInArrow(finish, f"id {kind}, {_TYPES}")
    whole = inside.select("id", *_COLUMNS).unionAll(rest)
    line = lambda c: F.replace(F.base64(c), F.lit("\r\n"), F.lit(""))
    texts = {"edited_sha256": F.lower(F.hex("edited_sha256")), "fingerprint": line("fingerprint"), "edited_fingerprint": line("edited_fingerprint")}
    return whole.select(F.col("id").alias(id_col), *[texts.get(c, F.col(c)).alias(c) for c in _COLUMNS])


def _batch(ids: list, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"pid": pa.int32(), "kind": pa.int32(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
    kinds |= dict.fromkeys(("edited_sha256", "fingerprint", "edited_fingerprint"), pa.binary())
    columns = [pa.array(c, kinds.get(k, pa.string())) for k, c in zip(names[1:], zip(*rows, strict=True), strict=True)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], names=names)
