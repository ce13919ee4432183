import random

import brute
import numpy as np
import pytest

from loomframe.llm import quality, queries


def corpus(n=1500):
    r = random.Random(9)
    good = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < 0.2
        text = " ".join((r.choice(good) + ("!!" if bad else "")) for _ in range(r.randint(20, 80)))
        rows.append((i, text.upper() if bad else text))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def labels_of(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark, docs_of):
    rows, labels = corpus()
    seen = [x for x in labels if x[0] % 2]
    got = {r["doc_id"]: r["kept"] for r in quality.classify(docs_of(rows), labels_of(spark, seen)).collect()}
    held = [x for x in labels if not x[0] % 2]
    assert sum(got[i] == bool(q) for i, q in held) / len(held) > 0.97


def test_the_model_is_the_one_counted_by_hand(spark, docs_of):
    rows, labels = corpus(120)
    w, share = quality.fit(quality.hashed(docs_of(rows)), labels_of(spark, labels[:60]), buckets=997)
    raw, target = np.zeros(997), np.zeros(997)
    good = {i for i, q in labels[:60] if q}
    for i, t in rows:
        f = np.bincount(quality.features(t, 997), minlength=997)
        raw += f
        target += f if i in good else 0
    want = np.log((target + 0.5) / (target.sum() + 0.5 * 997)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * 997))
    assert np.allclose(w, want) and share == len(good) / 60


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 1001])
def test_the_kth_largest(spark, k):
    r = random.Random(10)
    keys = [r.choice([r.getrandbits(64) - 2**63, r.randint(-5, 5)]) for _ in range(1000)]
    at = quality.top_k_threshold(spark.createDataFrame([(x,) for x in keys], "key long"), k)
    assert at == (None if k == 0 else sorted(keys, reverse=True)[k - 1] if k <= 1000 else -(2**63))


def test_gumbel_noise_samples_in_proportion(spark, docs_of):
    rows = [(i, "same words") for i in range(2000)]
    got = quality.classify(docs_of(rows), labels_of(spark, [(0, 1)]), share=0.3).collect()
    assert sum(r["kept"] for r in got) == 600 and len({r["log_importance"] for r in got}) == 1
    noise = np.array([r["gumbel_key"] - r["log_importance"] for r in got])
    assert abs(noise.mean() - 0.5772) < 0.1 and abs(noise.std() - np.pi / 6**0.5) < 0.1


def test_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "q " * 60_000), (4, "a"), (4, "a")]
    none = labels_of(spark, [])
    assert all(r["kept"] for r in quality.classify(docs_of(rows, clashing=True), none).collect())
    odd = labels_of(spark, [(None, 1), (4, None), (3, 0), (3, 1), (2, 1)])
    got = quality.classify(docs_of(rows), odd).collect()
    assert len(got) == 6 and len({r["kept"] for r in got if r["doc_id"] == 4}) == 1
    kept = quality.keep_good(docs_of(rows, clashing=True), odd)
    assert kept.columns == docs_of(rows, clashing=True).columns and kept.count() == quality.classify(docs_of(rows), odd).filter("kept").count()
    assert quality.classify(docs_of([]), none).count() == 0 and quality.keep_good(docs_of([]), odd).count() == 0
    assert quality.keep_good(docs_of(rows), labels_of(spark, [(1, 0)])).count() == 6


def test_the_query_against_brute_force(spark, tmp_path):
    rows, labels = corpus(300)
    rows += [(300, None), (301, ""), (302, "Ünï ¡code! 日本 " * 30), (303, "long " * 30_000), (304, rows[0][1])]
    labels = [(i, q, 0) for i, q in labels[:150]] + [(303, 1, 0), (5000, 1, 0)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want, kept = brute.quality(rows, [r[:2] for r in labels])
    got = {r["doc_id"]: r for r in queries.op6_quality(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and {i for i, r in got.items() if r["kept"]} == kept
    for i, r in got.items():
        assert (r["log_importance"], r["gumbel_key"]) == pytest.approx(want[i], rel=1e-9, abs=1e-6)
