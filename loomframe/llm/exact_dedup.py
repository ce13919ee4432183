"""Exact deduplication by content-defined chunk recipes.

A text is normalised (white space deleted) and cut where its own content says
so. Every chunk gets an identifier; a pass over the distinct chunks verifies,
against their full contents, that no two chunks share an identifier. A document
is then the ordered list of its identifiers, its recipe, and two documents are
equal exactly if their recipes are equal. Long documents are never moved or
compared as a whole: distinct chunks move once, recipes afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, keep_rows, materialise, row_keys, text_of

#: Characters that normalisation deletes.
SPACES = " \t\n\x0b\x0c\r"
MIN_CHUNK, MAX_CHUNK = 512, 4096
#: Once it is long enough, a chunk ends after these three classes of letters or, in other scripts, after a mark that follows a letter.
BOUNDARY = r"(?:[aeiouy][b-df-hj-np-tv-xz][aeiouy]|[^\x00-\x7F]\p{Po})"
#: Identifiers start with this many 64-bit hashes, and widen up to MAX_WIDTH.
WIDTH, MAX_WIDTH = 2, 4


def normalised(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def chunks(text: Column) -> Column:
    """Content-defined chunks: together they are the text; none is empty."""
    pattern = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 3}}}?{BOUNDARY}|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _identifiers(chunk: Column, width: int, bits: int) -> list[Column]:
    hashes = [F.xxhash64(F.lit(salt), chunk) for salt in range(width)]
    return [h if bits >= 64 else F.pmod(h, F.lit(1 << bits)) for h in hashes]


def verified_width(texts: DataFrame, bits: int = 64) -> int | None:
    """The number of hashes in an identifier for which no two distinct chunks agree.

    ``texts`` has one column, ``t``, of normalised texts. None: no width up to
    MAX_WIDTH will do, and chunks themselves must serve.
    """
    for width in range(WIDTH, MAX_WIDTH + 1):
        ids = [f"i{k}" for k in range(width)]
        distinct = (
            texts.select(F.explode(chunks(F.col("t"))).alias("c"))
            .select(*[h.alias(i) for h, i in zip(_identifiers(F.col("c"), width, bits), ids, strict=True)], "c")
            .distinct()
        )
        if distinct.groupBy(*ids).count().filter("count > 1").isEmpty():
            return width
    return None


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Groups of documents with equal normalised texts.

    Returns one row per row of ``docs``: the id, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256``, ``recipe`` (identifiers in order, as text where
    hashes would not do), and the row keys ``_k1`` and ``_k2``. Of a group the
    row with the most code points in its original text stays, then that with
    the smallest id; a null id comes last.

    Null text counts as empty, and all empty texts are one group. Rows that
    agree in id and text are one group, of which exactly one row is kept. An
    empty table gives an empty table. Other columns are ignored whatever their
    names. ``bits`` narrows the hashes, so that tests can force clashes.
    """
    source = docs.select(col(id_col).alias("id"), text_of(text_col).alias("o"), *row_keys(id_col, text_col))
    texts = source.select("id", "_k1", "_k2", F.char_length("o").cast("long").alias("n"), normalised(F.col("o")).alias("t"))
    width = verified_width(texts.select("t"), bits)
    if width is None:
        recipe = chunks(F.col("t"))
    else:
        recipe = F.flatten(F.transform(chunks(F.col("t")), lambda c: F.array(*_identifiers(c, width, bits))))
    rows = materialise(
        texts.select(
            F.monotonically_increasing_id().alias("uid"), "id", "_k1", "_k2", "n",
            F.sha2(F.col("t"), 256).alias("text_sha256"), recipe.alias("recipe"),
        ),
        "recipes",
    )
    first = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("x"), F.col("id"), F.col("uid"))
    groups = rows.groupBy("recipe").agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
    several = groups.filter("group_size > 1").select("recipe", F.col("first.id").alias("g_id"), F.col("first.uid").alias("g_uid"), "group_size")
    # Written, so that the join deals out rows anew and may split a large group among tasks.
    several = materialise(several, "groups")
    out = rows.join(several, "recipe", "left")
    alone = F.col("g_uid").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("g_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("g_uid") == F.col("uid"))).alias("kept"),
        "text_sha256",
        "recipe",
        "_k1",
        "_k2",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of equal normalised texts, that which :func:`exact_dedup` keeps.

    Null and empty texts are one group, rows that agree in id and text are one
    document, a null id comes last, and an empty table gives an empty table. All
    columns are kept whatever their names.
    """
    keep = exact_dedup(docs, id_col, text_col).filter("kept")
    return keep_rows(docs, keep, id_col, text_col, once=True)
