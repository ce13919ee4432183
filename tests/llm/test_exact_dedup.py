import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomframe.llm import exact_dedup


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    return {
        (i, min(groups[norm(t)])[3], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows
    }


def cases():
    random.seed(2)
    word = lambda: "".join(random.choice("aeioubdgnrst") for _ in range(random.randint(1, 9)))
    long = " ".join(word() for _ in range(9000))
    rows = [(0, ""), (1, None), (2, "  \n\x0b"), (3, "a b"), (4, "ab"), (5, "a  b"), (6, "a\u00a0b"), (7, long), (8, long.replace(" ", "\n")), (9, long + "x"), (10, "é " * 3), (11, "ééé")]
    rows += [(100 + k, "same text again") for k in range(50)]
    return rows


@pytest.mark.parametrize("clashing", [False, True])
def test_groups_match_brute_force(docs_of, clashing):
    rows = cases()
    got = exact_dedup.exact_dedup(docs_of(rows, clashing)).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("bits", [1, 8])
def test_clashing_identifiers_are_widened_or_given_up(docs_of, bits):
    rows = cases()
    got = exact_dedup.exact_dedup(docs_of(rows), bits=bits).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == brute(rows)


def test_chunks_cut_by_content(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000))
    df = spark.createDataFrame([(text,), ("zz" + text,), ("",)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c"))
    a, b, c = (r["c"] for r in df.collect())
    assert "".join(a) == text and "".join(b) == "zz" + text and c == []
    assert len(set(a) & set(b)) > 0.8 * len(a) and max(map(len, a)) <= exact_dedup.MAX_CHUNK


def test_repeated_rows_null_ids_and_empty_tables(docs_of):
    rows = [(1, "x y"), (1, "x y"), (None, "xy"), (None, None)]
    got = exact_dedup.exact_dedup(docs_of(rows)).collect()
    assert len(got) == 4 and sum(r["kept"] for r in got) == 2
    assert {r["keep_id"] for r in got if r["text_sha256"] == hashlib.sha256(b"xy").hexdigest()} == {1}
    kept = exact_dedup.drop_exact_copies(docs_of(rows, clashing=True))
    assert kept.columns == docs_of(rows, clashing=True).columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"]) == [(1, "x y")] and kept.count() == 2
    assert exact_dedup.exact_dedup(docs_of([])).count() == 0 and exact_dedup.drop_exact_copies(docs_of([])).count() == 0


def test_chunks_follow_the_content_in_any_script(spark):
    r = random.Random(2)
    letters = {"latin": "etaoinshrdlu", "cyrillic": "оеаинтсрвлк", "han": "的一是不了人我在有他这中大来上", "arabic": "ايلمنرتبعه"}
    for name, alphabet in letters.items():
        mark = {"han": "。", "arabic": "؟"}.get(name, ".")
        text = "".join(r.choice(alphabet) + (mark if r.random() < 0.02 else "") for _ in range(40_000))
        a, b = ({x["c"] for x in spark.createDataFrame([(t,)], "t string").select(F.explode(exact_dedup.chunks(F.col("t"))).alias("c")).collect()} for t in (text, alphabet[:3] + text))
        assert len(a & b) >= 0.8 * len(a) and max(map(len, a)) <= exact_dedup.MAX_CHUNK, name
