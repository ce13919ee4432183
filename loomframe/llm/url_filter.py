"""URL filters over a sorted array of digests.

Rules are hashed to 64-bit xxhash keys and written, sorted, to one index file
with their full strings. Workers map the file into memory, so that all of a
machine share one copy, and probe it for whole batches by binary search. A key
found is a rule only if the stored string agrees.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, new_path

ALLOW, BLOCK = "allow", "block"
_MAGIC = b"URLRULE2"
#: Every executor gets a copy of the index on its disk, so no larger one is published.
MAX_INDEX = 4 << 30


def build_index(rules: Iterable[tuple[str, str]], mask: int = 2**64 - 1) -> bytes:
    """The index of (rule, verdict): rules are ``host/path`` with a host in lower case.

    Layout, little-endian: magic, number of rules, number of path lengths, mask,
    most labels of a host; then path lengths, sorted keys, string ends, verdicts, strings. ``mask``
    narrows the keys, so that tests can force collisions. The last verdict given
    for a rule holds.
    """
    verdicts = dict(rules)
    for rule, verdict in verdicts.items():
        if "/" not in rule or verdict not in (ALLOW, BLOCK):
            raise ValueError(f"not a rule: {rule!r}, {verdict!r}")
    raw = [(xxhash.xxh64_intdigest(r.encode()) & mask, r.encode(), v == BLOCK) for r, v in verdicts.items()]
    raw.sort()
    lengths = sorted({len(r.partition("/")[2]) + 1 for r in verdicts})
    labels = max((r.partition("/")[0].count(".") + 1 for r in verdicts), default=0)
    ends = np.cumsum([len(r) for _, r, _ in raw]) if raw else []
    return b"".join(
        [
            _MAGIC, struct.pack("<QQQQ", len(raw), len(lengths), mask, labels), np.asarray(lengths, "<u8").tobytes(), np.asarray([k for k, _, _ in raw], "<u8").tobytes(),
            np.asarray(ends, "<u8").tobytes(), np.asarray([b for _, _, b in raw], "u1").tobytes(), *[r for _, r, _ in raw],
        ]
    )


class Index:
    """An index mapped from a file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != _MAGIC:
            raise ValueError(f"{path} is no index of rules")
        n, m, self.mask, self.labels = struct.unpack_from("<QQQQ", self.map, 8)
        at = 40
        self.lengths = np.frombuffer(self.map, "<u8", m, at).astype(int).tolist()
        self.keys = np.frombuffer(self.map, "<u8", n, at := at + 8 * m)
        self.ends = np.frombuffer(self.map, "<u8", n, at := at + 8 * n)
        self.block = np.frombuffer(self.map, "u1", n, at := at + 8 * n)
        self.strings = at + n

    def string(self, k: int) -> str:
        begin = int(self.ends[k - 1]) if k else 0
        return self.map[self.strings + begin : self.strings + int(self.ends[k])].decode()

    def find(self, candidates: list[str]) -> np.ndarray:
        """The position of each candidate's rule, or -1."""
        out = np.full(len(candidates), -1, np.int64)
        if not len(self.keys) or not candidates:
            return out
        hashes = np.fromiter((xxhash.xxh64_intdigest(c.encode("utf-8", "surrogatepass")) & self.mask for c in candidates), np.uint64, len(candidates))
        low = np.searchsorted(self.keys, hashes, side="left")
        for i in np.flatnonzero((low < len(self.keys)) & (self.keys[np.minimum(low, len(self.keys) - 1)] == hashes)).tolist():
            k = int(low[i])
            while k < len(self.keys) and self.keys[k] == hashes[i]:
                if self.string(k) == candidates[i]:
                    out[i] = k
                    break
                k += 1
        return out


def candidates(host: str, path: str, lengths: list[int], labels: int) -> list[str]:
    """The rules that would fit, the longest first; of two as long, that with the longer host first. No rule's host has more labels than ``labels``."""
    parts = host.rsplit(".", labels)[-labels:] if labels else []
    suffixes = [".".join(parts[k:]) for k in range(len(parts))]
    found = [(len(s) + n, len(s), s + path[:n]) for s in suffixes for n in lengths if n <= len(path)]
    return [c for _, _, c in sorted(found, key=lambda x: (-x[0], -x[1]))]


@lru_cache(4)
def _opened(name: str) -> Index:
    from pyspark import SparkFiles

    return Index(SparkFiles.get(name))


def publish(spark: SparkSession, index: bytes) -> str:
    """Put the index file where every executor gets its own copy; returns its name there. ValueError above MAX_INDEX bytes."""
    if len(index) > MAX_INDEX:
        raise ValueError(f"an index of {len(index)} bytes; at most {MAX_INDEX} are copied to every executor")
    path = new_path(spark, "urlrules") + ".idx"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        for at in range(0, len(index), 1 << 20):
            out.write(bytearray(index[at : at + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def judge_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = ALLOW, mask: int = 2**64 - 1
) -> DataFrame:
    """The id, ``host``, ``path``, ``rule`` and ``verdict`` of every row.

    A rule ``host/path`` fits its host and all subdomains if the url's path
    starts with the rule's; the longest that fits decides, and ``default`` where
    none does. Rules are held by the driver once, as a file by each machine, and
    by no worker as Python objects. A null url, or one without ``://``, has an
    empty host and path, which no rule fits. Repeated rows are each judged; an
    empty table, or no rules, gives rows with the default. Other columns are
    ignored whatever their names.
    """
    name = publish(pages.sparkSession, build_index(rules, mask))
    url = col(url_col).cast("string")
    source = pages.select(col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _opened(name)
        for b in batches:
            wanted, owner = [], []
            for i, (h, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if h and p:
                    c = candidates(h, p, index.lengths, index.labels)
                    wanted += c
                    owner += [i] * len(c)
            rule, verdict = [None] * b.num_rows, [default] * b.num_rows
            at = index.find(wanted)
            for j in np.flatnonzero(at >= 0).tolist():
                if rule[owner[j]] is None:
                    rule[owner[j]] = wanted[j]
                    verdict[owner[j]] = BLOCK if index.block[at[j]] else ALLOW
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    out = source.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
