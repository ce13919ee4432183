"""Quality classifier by importance resampling of hashed n-grams.

Two generative models over hashed word and word-pair counts are estimated: one
of target text (documents labelled as good), one of raw text (all documents).
A document's log-importance is the log of the ratio of its probabilities under
the two. Perturbing it with Gumbel noise and taking the k largest samples k
documents without replacement, in proportion to importance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, keep_rows, materialise, row_keys, text_of

BUCKETS = 1 << 16
#: At most so many labelled rows are used to fit, those with the smallest hashes of their ids.
MAX_LABELLED = 20_000
SMOOTHING = 0.5
SEED = 42
#: Words and runs of punctuation.
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: A word's number is remembered for so many words at a time.
CACHE = 100_000


class _Numbers(dict):
    """16-bit numbers of tokens, remembered within a bound."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        n = self[token] = xxhash.xxh32_intdigest(token.encode("utf-8", "surrogatepass")) >> 16
        return n


_NUMBERS = _Numbers()


def numbers(text: str) -> np.ndarray:
    """The 16-bit numbers of a text's words, in order."""
    tokens = TOKEN.findall(text.lower())
    return np.fromiter(map(_NUMBERS.__getitem__, tokens), np.uint16, len(tokens))


def bucketed(words: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of words and word pairs, repeats included, from their numbers."""
    one = words.astype(np.uint64)
    mixed = one * np.uint64(0x9E3779B97F4A7C15)
    pair = (mixed[:-1] ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    both = np.concatenate([mixed, pair])
    return (both >> np.uint64(40)).astype(np.int64) % buckets


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's words and word pairs, repeats included."""
    return bucketed(numbers(text), buckets)


def _labelled(labels: DataFrame, id_col: str, label_col: str, limit: int) -> DataFrame:
    """A bounded sample of labelled rows: ``_id`` and ``_good`` (0 or 1)."""
    known = labels.select(col(id_col).alias("_id"), col(label_col).cast("int").alias("_good")).dropna()
    known = known.groupBy("_id").agg(F.min("_good").alias("_good"))
    return known.orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id").limit(limit)


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``_k1``, ``_k2`` and ``words``, the text's :func:`numbers` (little-endian), for each row. Texts are read here alone."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(col(id_col).alias("id"), *row_keys(id_col, text_col), text_of(text_col).alias("t"))
    kind = source.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("_k1", pa.int64()), ("_k2", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [numbers(t.as_py()).astype("<u2").tobytes() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(words, pa.binary())], schema=schema)

    return materialise(source.mapInArrow(run, f"id {kind.simpleString()}, _k1 long, _k2 long, words binary"), "words")


def _read(words: pa.BinaryScalar, buckets: int) -> np.ndarray:
    return bucketed(np.frombuffer(words.as_buffer(), "<u2"), buckets)


def fit(words_of: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", limit: int = MAX_LABELLED, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """(log ratio of target to raw by bucket, share of good rows among the labelled), from :func:`hashed` documents.

    Raw counts are over all of them; the target is those that the sample of
    ``labels`` calls good. Without good rows or without documents the ratio is 0
    everywhere, and without labels the share is 1: nothing is rejected then.
    """
    sample = materialise(_labelled(labels, id_col, label_col, limit), "labelled")
    n, good = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("_good") > 0).cast("int")), F.lit(0))).first()
    if not n or not good:
        return np.zeros(buckets), 1.0
    known = F.broadcast(sample.filter("_good > 0").select(F.col("_id").alias("id"), F.lit(True).alias("g")))  # `limit` rows at most
    marked = words_of.join(known, "id", "left").select("g", "words")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for g, words in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = _read(words, buckets)
                if len(found) > buckets:
                    found = np.bincount(found, minlength=buckets)
                    raw += found
                    target += found if g else 0
                else:
                    np.add.at(raw, found, 1)
                    if g:
                        np.add.at(target, found, 1)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["b", "raw", "target"])

    summed = marked.mapInArrow(count, "b long, raw long, target long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in summed.collect():  # one row for each bucket at most
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    if not target.any():
        return np.zeros(buckets), good / n
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * buckets)
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * buckets)
    return np.log(p) - np.log(q), good / n


def score(words_of: DataFrame, log_ratio: np.ndarray) -> DataFrame:
    """``id``, ``_k1``, ``_k2``, ``log_importance`` for each :func:`hashed` row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = words_of.schema["id"].dataType
    shared = words_of.sparkSession.sparkContext.broadcast(log_ratio)
    schema = pa.schema([("id", to_arrow_type(kind)), ("_k1", pa.int64()), ("_k2", pa.int64()), ("log_importance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            s = [float(w[_read(words, len(w))].sum()) for words in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(s, pa.float64())], schema=schema)

    return words_of.mapInArrow(run, f"id {kind.simpleString()}, _k1 long, _k2 long, log_importance double")


def top_k_threshold(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the longs in column ``key``, by counts alone; None if k < 1.

    Four passes fix 16 bits each: counts by 16 bits are at most 65,536 rows.
    """
    if k < 1:
        return None
    prefix, left = 0, k
    unsigned = F.col("key").bitwiseXOR(F.lit(-(2**63)))
    for step in range(4):
        shift = 48 - 16 * step
        part = keys if not step else keys.filter(F.shiftrightunsigned(unsigned, shift + 16) == F.lit(prefix))
        digit = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit(0xFFFF))
        counts = sorted(part.groupBy(digit.alias("d")).count().collect(), reverse=True)
        for d, n in counts:
            if left <= n:
                break
            left -= n
        else:
            return -(2**63)
        prefix = (prefix << 16) | int(d)
    return prefix - 2**63


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    share: float | None = None, seed: int = SEED, limit: int = MAX_LABELLED,
) -> DataFrame:
    """Each row of ``docs`` with the id, ``log_importance``, ``gumbel_key``, ``kept`` and the row keys.

    The k rows with the largest sum of log-importance and Gumbel noise are kept,
    k being ``share`` of all rows; by default the share of good rows among the
    labelled. The noise comes from the row's id and text, so that it is the same
    in every run. Rows that tie at the k-th place are all kept, so that repeated
    rows share their fate. Null text counts as empty and scores 0; null ids are
    never labelled; labels that are null are no labels. An empty table gives an
    empty table. Other columns are ignored whatever their names.
    """
    found = hashed(docs, id_col, text_col)
    log_ratio, good = fit(found, labels, id_col, label_col, limit)
    scored = materialise(score(found, log_ratio), "scored")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_k1", "_k2"), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    keyed = scored.withColumn("gumbel_key", F.col("log_importance") - F.log(-F.log(uniform)))
    # Doubles in order as longs: thousandths would tie too often, so 2^-20 is the unit.
    ranked = keyed.withColumn("key", F.round(F.col("gumbel_key") * F.lit(float(1 << 20))).cast("long"))
    n = scored.count()
    at = top_k_threshold(ranked.select("key"), round(n * (good if share is None else share)))
    kept = F.lit(False) if at is None else F.col("key") >= F.lit(at)
    return ranked.select(F.col("id").alias(id_col), "log_importance", "gumbel_key", kept.alias("kept"), "_k1", "_k2")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`classify` rejects, all columns kept.

    A null text counts as empty, a row with a null id is judged by its text,
    repeated rows share their fate, an empty table gives an empty table, and
    other columns are kept whatever their names.
    """
    keep = classify(docs, labels, id_col, text_col).filter("kept")
    return keep_rows(docs, keep, id_col, text_col, once=False)
