"""Best-fit packing with exact-complement hashing.

Token sequences are counted by length. Because there are at most as many
lengths as a sequence has tokens, the plan is made from those counts alone,
however large the corpus is: which combinations of lengths share a sequence, and
how often. An index holds the sums of single lengths, pairs and triples; gaps are
first filled exactly by what it has under their sum and the counts still
available, and what is left goes to the fullest sequence it fits. Pieces then
find their place by the rank within their length.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, text_of

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Words remembered by a worker: two generations of so many.
CACHE = 250_000
#: The rules of a tokenizer file under which a text's ids are those of its words.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
    "model": {
        "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>",
        "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
    },
}


# --- tokens ---------------------------------------------------------------


class _Words:
    """Token ids of texts, just as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    The default vocabulary's added tokens stand alone wherever a text spells
    them, and its tokenizer drops white space; what stands on either side of
    either is encoded alike alone or together. So the ids of a text are those
    of its words in a row, and words are remembered within a bound. A file with other
    rules (:data:`RULES`) gets whole texts encoded.
    """

    SIMPLE = re.compile(r"[ɐ-\U0010ffffİ]")
    TAIL = re.compile(r"(?<=[a-zß-öø-ÿ])([.,])(?=[ \n]|$)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        told = _told(path)
        added = told.get("added_tokens") or []
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
        model = {k: v for k, v in told["model"].items() if k not in ("vocab", "merges")}
        self.whole = not plain or {k: told.get(k) for k in RULES if k != "model"} | {"model": model} != RULES
        self.tokenizer = Tokenizer.from_file(path)
        if self.whole:
            return
        self.added = {t["content"]: np.asarray([t["id"]], "<u4").tobytes() for t in added}
        self.cut = re.compile("|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True))) if added else None
        self.tokenizer.encode_special_tokens = True  # the strings of added tokens are cut out before; what lower case makes of others is no added token
        self.model = self.tokenizer.model
        self.bytes_of = _byte_letters()
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        if self.whole:
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.cut is None or not self.cut.search(text):
            return self._span(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._span(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self._span(text[at:])])

    def _span(self, text: str) -> bytes:
        if not self.SIMPLE.search(text):  # elsewhere lower case may depend on what stands around
            text = self.TAIL.sub(r" \1", text.lower())
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.now.__getitem__, words))
        except KeyError:
            return b"".join(map(self._word, words))

    def _word(self, word: str) -> bytes:
        got = self.now.get(word)
        if got is None:
            got = self.before.get(word)
            if got is None:
                got = self._encode(word)
            if len(self.now) >= CACHE:
                self.before, self.now = self.now, {}
            self.now[word] = got
        return got

    def _encode(self, word: str) -> bytes:
        if word.isalpha() and word == word.lower() and not self.SIMPLE.search(word):
            letters = word.encode().decode("latin-1").translate(self.bytes_of)
            ids = [t.id for t in self.model.tokenize(letters)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()


def _told(path: str) -> dict:
    """What a tokenizer's file says but for its vocabulary, which is large and comes last."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    head, vocabulary, _ = text.partition('"vocab"')
    try:
        return json.loads(head.rstrip().rstrip(",") + "}}" if vocabulary else text)
    except ValueError:  # in another order
        return json.loads(text)


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


@cache
def _words(path: str) -> _Words:
    return _Words(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32``: each text's ids and the end id, cut at ``capacity``.

    ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``;
    tokenizer: a path that every executor has; by default the public vocabulary
    installed beside the Python packages, looked up on the executor. Any file of
    that library will do; ``end`` is the id put after a text.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(col(id_col).alias("id"), text_of(text_col).alias("t"))
    kind = source.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer or tokenizer_path())
        last = np.asarray([end], "<u4").tobytes()
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = words.ids(t) + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                schema=schema,
            )

    return source.mapInArrow(run, f"id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


# --- the plan -------------------------------------------------------------


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how many sequences hold each; every counted piece is used exactly once."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if have[capacity]:
        out.append(((capacity,), int(have[capacity])))
        have[capacity] = 0
    _fill_exactly(have, capacity, out)
    out += _fill_best(have, capacity)
    return out


class SumIndex:
    """Available lengths by the sums that one, two or three of them make.

    Pairs are kept by sum, with the number of those still available under each;
    a triple is found under its sum by its largest member, which leads to the pair
    under what remains. Counts only fall, so pairs are never added.
    """

    def __init__(self, have: np.ndarray) -> None:
        self.have, top = have, len(have) - 1
        self.alive = have > 0
        self.double = have > 1
        lengths = np.flatnonzero(self.alive)
        larger, sums = [], []
        for a in lengths.tolist():
            b = lengths[: np.searchsorted(lengths, min(a, top - a), side="right")]
            if len(b) and b[-1] == a and not self.double[a]:
                b = b[:-1]
            larger.append(np.full(len(b), a, np.int32))
            sums.append((a + b).astype(np.int32))
        sums = np.concatenate(sums) if sums else np.empty(0, np.int32)
        order = np.argsort(sums, kind="stable")  # under a sum, the larger members ascend
        self.larger = np.concatenate(larger)[order] if larger else sums
        self.first = np.searchsorted(sums[order], np.arange(top + 2))
        self.live = np.bincount(sums, minlength=top + 1)

    def take(self, combination: list[int], times: int) -> None:
        """Lower the counts, and unlist the pairs that this uses up."""
        for x in combination:
            self.have[x] -= times
        top = len(self.have) - 1
        for x in set(combination):
            if self.double[x] and self.have[x] < 2:
                self.double[x] = False
                if 2 * x <= top:
                    self.live[2 * x] -= 1
            if self.alive[x] and not self.have[x]:
                self.alive[x] = False
                self.live[np.flatnonzero(self.alive[: max(top - x + 1, 0)]) + x] -= 1

    def single(self, total: int, most: int) -> list[int] | None:
        """The length ``total``, if available and not above ``most``."""
        return [total] if 0 < total <= most and self.have[total] else None

    def pair(self, total: int, most: int) -> list[int] | None:
        """Two available lengths of this sum, neither above ``most``, the larger one as large as can be."""
        if total < 2 or not self.live[total]:
            return None
        a = self.larger[self.first[total] : self.first[total + 1]]
        b = total - a
        fits = np.flatnonzero((a <= most) & (self.have[b] > 0) & (self.have[a] > (a == b)))
        return [int(a[fits[-1]]), int(b[fits[-1]])] if len(fits) else None

    def triple(self, total: int, most: int) -> list[int] | None:
        """Three available lengths of this sum, none above ``most``, the largest as large as can be."""
        low, high = -(-total // 3), min(most, total - 2)
        if high < low:
            return None
        a = np.flatnonzero(self.have[low : high + 1] > 0) + low
        for x in a[self.live[total - a] > 0][::-1].tolist():
            self.have[x] -= 1
            rest = self.pair(total - x, x)
            self.have[x] += 1
            if rest:
                return [x, *rest]
        return None


def _fill_exactly(have: np.ndarray, capacity: int, out: list) -> None:
    """Use up lengths, the largest first, in combinations of two to four whose sum is the capacity."""
    index = SumIndex(have)
    for length in range(capacity - 1, 0, -1):
        while have[length]:
            gap = capacity - length
            have[length] -= 1
            rest = index.single(gap, length) or index.pair(gap, length) or index.triple(gap, length)
            have[length] += 1
            if rest is None:
                break
            combination = [length, *rest]
            times = min(int(have[x]) // combination.count(x) for x in set(combination))
            index.take(combination, times)
            out.append((tuple(combination), times))


def _fill_best(have: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: equal sequences are kept together, by the gap they leave."""
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in np.flatnonzero(have)[::-1].tolist():
        left = int(have[length])
        for gap in sorted(g for g in gaps if g >= length):
            most = gap // length
            while left and gaps[gap]:
                held, times = gaps[gap].pop()
                each, use = (most, min(times, left // most)) if left >= most else (left, 1)
                if times > use:
                    gaps[gap].append((held, times - use))
                gaps[gap - each * length].append((held + (length,) * each, use))
                left -= each * use
            if not left:
                break
        full = capacity // length
        if left >= full:
            gaps[capacity - full * length].append(((length,) * full, left // full))
            left %= full
        if left:
            gaps[capacity - left * length].append(((length,) * left, 1))
        for gap in [g for g in gaps if not gaps[g]]:
            del gaps[gap]
    have[:] = 0
    return [x for held in gaps.values() for x in held]


def intervals(combinations: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces by (length, rank): first key of each run, its sequence less its rank, and its offset.

    A key is length * 2^44 + rank. Sequences are numbered in the order of the plan.
    """
    used: dict[int, int] = defaultdict(int)
    keys, shift, offset = [], [], []
    sequence = 0
    for lengths, times in combinations:
        at = 0
        for length in lengths:
            rank = used[length]
            keys.append((length << 44) | rank)
            shift.append(sequence - rank)
            offset.append(at)
            used[length] += times
            at += length
        sequence += times
    order = np.argsort(np.asarray(keys, np.int64))
    return tuple(np.asarray(x, np.int64)[order] for x in (keys, shift, offset))


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, group: int | None = None
) -> DataFrame:
    """Each piece of each row of ``docs`` with its sequence and its offset there.

    Returns the id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` and ``offset``. Null text counts as empty: a piece that is
    the end id alone. Texts longer than ``capacity`` ids are cut. Repeated rows
    are packed as often as they come, null ids as any other. An empty table gives
    an empty table. Other columns are ignored whatever their names.
    """
    made = materialise(
        pieces(docs, id_col, text_col, tokenizer, capacity).withColumn("h", F.xxhash64("id", "piece", "ids_crc32")), "pieces"
    )
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = sum(counts.values())
    keys, shift, offset = intervals(plan(counts, capacity))
    # Ranks within a length, however common it is: ranks in groups, each after the groups before it.
    # By default a length has about as many groups as a group has rows, so that neither grows faster than the root of all rows.
    parts = max(1, -(-rows // (group or math.isqrt(rows) + 1)))
    dealt = made.withColumn("part", F.pmod("h", F.lit(parts)))
    from pyspark.sql import Window as W

    sizes = dealt.groupBy("length", "part").count()
    before = sizes.select("length", "part", (F.sum("count").over(W.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"))
    within = W.partitionBy("length", "part").orderBy("h", "id", "piece")
    ranked = dealt.withColumn("r", F.row_number().over(within)).join(before, ["length", "part"])
    placed = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("r") - 1).alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast((keys, shift, offset))  # a few runs for each length
    schema = placed.schema
    names = [f.name for f in schema.fields][:5]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shift, offset = shared.value
        for b in batches:
            length = b.column(3).to_numpy(zero_copy_only=False)
            rank = b.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(shift[at] + rank), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    kind = schema["id"].dataType.simpleString()
    out = placed.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
