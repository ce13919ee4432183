"""The pipeline against its stages by hand, on a small corpus with planted copies."""

import random
import re

import brute
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomframe.llm import packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(23)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for i in range(400):
        junk = r.random() < 0.15
        text = " ".join(word() + ("!!" if junk else "") for _ in range(r.randint(30, 200)))
        rows.append((i, text, r.choice(["en", "de"]), "hot" if i % 3 else f"s{i % 5}", len(text)))
        labels.append((i, int(not junk), 0))
    for k in range(60):
        t = rows[k % 10][1]
        rows.append((1000 + k, t.replace(" ", "\n") if k % 2 else t + " extra" * (k % 3), "en", "hot", len(t)))
    rows += [(2000, None, None, None, None), (2001, "", "en", "hot", 0), (2002, "word " * 9000, "en", "s1", 45_000)]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    rows = [tuple(r) for r in docs.collect()]
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["quality"](spark, docs, sf_dir)
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    _, good = brute.quality([r[:2] for r in rows], labels)
    want = [r for r in rows if r[0] in good]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want)) and kept.columns == docs.columns

    kept = stage["exact_dedup"](spark, kept, sf_dir)
    groups = {}
    for r in want:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append((-len(r[1] or ""), r[0], r))
    want = [min(g)[2] for g in groups.values()]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))

    kept = stage["near_dedup"](spark, kept, sf_dir)
    sets = {}
    for r in want:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets[r[0]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = [r for r in want if root(r[0]) == r[0]]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))

    sampled = stage["mixing"](spark, kept, sf_dir)
    want = [r for r, (*_, chosen) in zip(want, brute.mixing([r[:4] for r in want]), strict=True) if chosen]
    assert sorted(map(str, map(tuple, sampled.collect()))) == sorted(map(str, want)) and want

    packed = stage["packing"](spark, sampled, sf_dir).collect()
    words = Tokenizer.from_file(packing.tokenizer_path())
    assert sum(r["length"] for r in packed) == sum(len(words.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in want)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = corpus_pipeline.run(spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, whole)) == sorted(tuple(r[c] for c in columns) for r in packed)


def test_every_stage_takes_an_empty_table(spark, sf_dir, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_with_clashing_names(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60 OR doc_id >= 1000")
    for name in ("_k1", "_id", "id", "t", "f", "g", "k", "n", "kept", "recipe", "uid", "component", "least", "d0", "tokens", "piece", "length", "part", "Words"):
        docs = docs.withColumn(name, F.lit("x"))
    stage, kept = dict(corpus_pipeline.STAGES), docs
    for name in ("quality", "exact_dedup", "near_dedup", "mixing"):
        kept = stage[name](spark, kept, sf_dir)
        assert kept.columns == docs.columns and kept.filter("_k1 <> 'x' OR Words <> 'x'").isEmpty(), name
    packed = stage["packing"](spark, kept, sf_dir)
    plain = stage["packing"](spark, kept.select("doc_id", "text", "lang", "source", "n_chars"), sf_dir)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, packed.select(columns).collect())) == sorted(map(str, plain.select(columns).collect())) and packed.count() > 30


def test_entry_registers_all(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert {"pipeline"} | {n for n in names if re.match(r"op\d+_", n)} <= names and sum(bool(re.match(r"op\d+_", n)) for n in names) == 10
    assert set(e.oracle_sql()) <= names
