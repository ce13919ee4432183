import random
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from loomframe.llm import mixing, queries


def test_raking_meets_all_marginals():
    r = random.Random(5)
    cells = [(s, l, r.randint(50, 5000)) for s in "abc" for l in "xyz"]
    targets = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"x": 0.1, "y": 0.6}]
    weights, off = mixing.rake(cells, targets)
    assert off < 1e-6
    total = sum(c[-1] for c in cells)
    for d, target in enumerate([targets[0], {"x": 0.1, "y": 0.6, "z": 0.3}]):
        by = defaultdict(float)
        for c, w in zip(cells, weights, strict=True):
            by[c[d]] += w * c[-1] / total
        assert by == pytest.approx(target, abs=1e-4)


def corpus(n=3000):
    r = random.Random(6)
    return [(i, " ".join(["wordlike"] * r.randint(1, 40)), r.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 7}", 0) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("weight", F.lit(1)).withColumn("kept", F.lit("x"))


def test_samples_hit_targets_whichever_way_they_are_raked(spark):
    df = frame(spark, corpus())
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    targets = {"source": {"hot": 0.4}, "lang": 0.5}
    a = mixing.mix(df, dims, targets, budget=0.5).collect()
    b = mixing.mix(df, dims, targets, budget=0.5, max_cells=0).collect()
    pa, pb = ({r["doc_id"]: r["probability"] for r in x} for x in (a, b))
    assert pa == pytest.approx(pb, abs=1e-5) and len(a) == 3000
    tokens = sum(r["tokens"] for r in a)
    expected = sum(r["tokens"] * r["probability"] for r in a)
    assert expected == pytest.approx(0.5 * tokens, rel=1e-6)
    assert sum(r["tokens"] * r["probability"] for r in a if r["source"] == "hot") / expected == pytest.approx(0.4, abs=0.02)
    kept = sum(r["tokens"] for r in a if r["kept"])
    assert kept == pytest.approx(expected, rel=0.06)
    assert sum(r["tokens"] for r in a if r["kept"] and r["source"] == "hot") / kept == pytest.approx(0.4, abs=0.05)


def test_edges(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3), (3, "x " * 50_000, "de", "t", 0)]
    got = mixing.mix_documents(frame(spark, rows)).collect()
    assert len(got) == 6 and {r["tokens"] for r in got} == {0, 2, 50_000}
    assert len({r["kept"] for r in got if r["doc_id"] == 2}) == 1
    sampled = mixing.sample_mix(frame(spark, rows))
    assert sampled.columns == frame(spark, rows).columns and sampled.count() == sum(r["kept"] for r in got)
    assert mixing.mix_documents(frame(spark, [])).count() == 0 and mixing.sample_mix(frame(spark, [])).count() == 0


def test_a_topic_is_that_of_the_whole_text(spark):
    r = random.Random(8)
    pool = ["opening", *("".join(r.choice("abcdeÉ") for _ in range(8)) for _ in range(40))]
    texts = [" ".join(["opening", *(r.choice(pool).upper() for _ in range(r.randint(0, 60)))]) for _ in range(60)] + ["", "short words only", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bucket = {w["w"]: w["b"] for w in spark.createDataFrame([(w.lower(),) for w in pool], "w string").selectExpr("w", "pmod(xxhash64(w), 8) AS b").collect()}
    for text, topic in df.select("t", mixing.topic_of(F.col("t"))).collect():
        found = [bucket[w] for w in (text or "").lower().split() if w in bucket]
        assert topic == (f"t{max(range(8), key=lambda k: (found.count(k), -k))}" if found else None)


def test_plan_has_no_python(spark):
    df = mixing.mix_documents(frame(spark, corpus(50)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("max_cells", [50_000, 0])
def test_targets_that_contradict_are_told(spark, max_cells, monkeypatch):
    """Cells (a, x) and (b, y) alone: a has x's share, whatever the weights."""
    monkeypatch.setattr(mixing, "ROUNDS", 5)
    df = frame(spark, [(1, "t " * 100, "x", "a", 0), (2, "t " * 100, "y", "b", 0)])
    dims, targets = {"source": F.col("source"), "lang": F.col("lang")}, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.5, "y": 0.5}}
    with pytest.raises(ValueError, match="off by"):
        mixing.mix(df, dims, targets, max_cells=max_cells)
    with pytest.warns(UserWarning, match="off by"):
        rows = mixing.mix(df, dims, targets, max_cells=max_cells, unmet="report").collect()
    assert {round(r["residual"], 3) for r in rows} == {4.0}


def test_the_query_against_brute_force(spark, tmp_path):
    r = random.Random(12)
    rows = []
    for i in range(400):
        words = [r.choice(["a", "of", "Banana", "cherry", "éclair", "window", "streets", "MOUNTAIN", "rivers"]) for _ in range(r.randint(0, 60))]
        rows.append((i, " ".join(words), r.choice(["en", "en", "de", "it", None]), "hot" if i % 3 else f"s{i % 4}", 0))
    rows += [(400, None, "en", "hot", None), (401, "", None, None, 0), (7, rows[7][1], "en", "hot", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["source"] or "", r["lang"] or "", r["topic"] or "", r["tokens"], r["kept"], r["probability"]) for r in queries.op4_mixing(spark, str(tmp_path)).collect())
    found = brute.mixing([r[:4] for r in rows])
    want = [(r[0], *(x or "" for x in c), n, kept, p) for r, (c, n, p, kept) in zip(rows, found, strict=True)]
    want.sort()
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want], abs=1e-4)
