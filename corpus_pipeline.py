"""The corpus pipeline: from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm import exact_dedup, mixing, packing, quality, simhash
from loomframe.llm.common import materialise, read_table, release, tables_made


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; null texts are judged as empty, repeated rows alike, an empty table stays empty."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space apart: the longest, then that with the smallest id; null and empty texts are equal, a null id comes last."""
    return exact_dedup.drop_exact_copies(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: five-word shingles, Jaccard similarity 0.8 or more; texts without words are alike, a null id comes last."""
    return simhash.drop_near_copies(docs, words=5, similarity=0.8)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of sources, languages and topics; a null is a value of its own, texts without words follow their cell."""
    return mixing.sample_mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in their sequences; a null or empty text is a piece that is the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", distinct_documents),
    ("near_dedup", dissimilar_documents),
    ("mixing", mixed_documents),
    ("packing", packed_sequences),
]

#: SQL has neither the classifier, nor the near copies, nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again, and what it wrote on the way is deleted.

    Null texts count as empty, and all empty documents as copies of one another;
    rows that agree in id and text are one document; of equal and similar texts
    one stays as the stages' docstrings tell; documents whose quality isn't known
    are judged like others. Empty tables give an empty result. Further columns of
    ``documents`` are carried through, whatever their names, up to packing.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = tables_made(spark)
        docs = materialise(stage(spark, docs, sf_dir), name)
        release(spark, before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
