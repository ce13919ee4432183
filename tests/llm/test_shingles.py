"""Near copies by shingles against all pairs by hand."""

import random
import re

import pytest

import corpus_pipeline
from loomframe.llm import shingles, simhash


def brute(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def corpus():
    r = random.Random(31)
    rows, i = [], 0
    for _ in range(40):
        words = [r.choice("the of and to in is that it was for on".split()) + str(r.randint(0, 50)) for _ in range(r.randint(3, 150))]
        for _ in range(r.randint(1, 5)):
            rows.append((i, " ".join(words)))
            i += 1
            for _ in range(r.randint(1, 4)):
                words[r.randrange(len(words))] = f"edit{r.randint(0, 9)}"
    passage = " ".join(f"passage{j}" for j in range(30))
    for _ in range(30):
        rows.append((i, passage + " " + " ".join(f"w{r.randint(0, 999)}" for _ in range(r.randint(10, 60)))))
        i += 1
    base = [f"long{j}" for j in range(100)]
    for j in range(60):
        rows.append((i, " ".join(base[: 96 + j % 5] + [f"tail{j}"])))
        i += 1
    return rows + [(5000, None), (5001, ""), (4999, "\n"), (5002, rows[0][1].upper())]


@pytest.mark.parametrize(("group", "block", "clashing"), [(2, 5, True), (3, 512, False), (32, 512, False)])
def test_no_similar_pair_stays_and_none_goes_without_one(docs_of, group, block, clashing):
    rows = corpus()
    docs = docs_of(rows, clashing)
    kept = shingles.drop_similar(docs, group=group, block=block)
    assert kept.columns == docs.columns
    stay = sorted(r["doc_id"] for r in kept.collect())
    sets = {d: brute(t) for d, t in rows}
    near = {d: {e for e in sets if e != d and (similar(sets[d], sets[e]) or sets[d] == sets[e])} for d in sets}
    assert len(set(stay)) == len(stay) and not any(near[d] & set(stay) for d in stay)
    component, todo = {}, sorted(sets)
    for d in todo:
        reach = [] if d in component else [d]
        while reach:
            x = reach.pop()
            if x not in component:
                component[x] = d
                reach += near[x]
    assert stay == sorted(set(component.values()))  # the smallest id of each


def test_a_large_group_beside_a_common_passage(docs_of):
    """Near copies of one text leave its first; documents that share a passage, and no more, all stay."""
    r = random.Random(32)
    base = [f"b{j}" for j in range(80)]
    rows = [(j, " ".join([*base, f"end{j}"])) for j in range(400)]
    passage = " ".join(f"p{j}" for j in range(60))
    rows += [(1000 + j, passage + " " + " ".join(f"w{r.randint(0, 10**6)}" for _ in range(80))) for j in range(200)]
    kept = simhash.drop_near_copies(docs_of(rows))
    assert sorted(x["doc_id"] for x in kept.collect()) == [0, *range(1000, 1200)]


def test_a_pair_that_no_band_holds_is_found(docs_of):
    """Four of five shingles are shared, by chance no band of minima, and the fingerprints differ in ten bits."""
    words = [f"1605w{j}" for j in range(9)]
    a, b = shingles.shingle_set(" ".join(words)), shingles.shingle_set(" ".join(words[:8]))
    assert not set(shingles.band_keys(a).tolist()) & set(shingles.band_keys(b).tolist())
    rows = [(1, " ".join(words)), (2, " ".join(words[:8])), (3, " ".join(words[:7])), (4, "something else")]
    assert sorted(r["doc_id"] for r in shingles.drop_similar(docs_of(rows)).collect()) == [1, 3, 4]


@pytest.mark.parametrize(("block", "similarity", "sample"), [(5, 0.8, 5000), (512, 0.8, 40), (512, 0.5, 5000)])
def test_missed_links_are_all_links_where_none_is_known(spark, docs_of, monkeypatch, block, similarity, sample):
    monkeypatch.setattr(shingles, "SAMPLE", sample)
    docs = docs_of(corpus())
    rows = shingles._sets(docs, "doc_id", "text", 5, similarity)
    first = shingles._distinct_sets(rows)
    none = spark.createDataFrame([], "f long, c long")
    got = {(r["a"], r["b"]) for r in shingles.missed_links(rows, first, none, docs, "doc_id", "text", 5, similarity, block).collect()}
    f = {r["id"]: r["f"] for r in rows.collect()}
    sets = {f[i]: brute(t) for i, t in corpus()}
    want = {(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9}
    assert got == want and len(want) > 500


def test_parities_rule_out_no_similar_pair():
    """Pairs at the threshold pass, whatever their widths; those far below don't."""
    import numpy as np

    r = np.random.default_rng(6)
    random64 = lambda k: r.integers(-(2**63), 2**63, k, dtype=np.int64)
    for n in (5, 100, 1100, 2200, 9000):
        both, own = random64(8 * n // 10 + 1), random64(n - 8 * n // 10 - 1)
        a, b, other = np.unique(both), np.unique(np.concatenate([both, own])), np.unique(np.concatenate([both[: n // 2], random64(n - n // 2)]))
        found = shingles._possible(np.array([3, 1, 2]), np.array([3, 1, 2]), np.array([len(x) for x in (a, b, other)]), [shingles.parity(x) for x in (a, b, other)], 0.8)
        pairs = {(int(x), int(y)) for left, right in found for x, y in zip(left, right, strict=True)}
        assert (3, 1) in pairs and (n == 5 or pairs == {(3, 1)}), n


def test_the_stage_takes_what_simhash_let_pass(docs_of):
    words = [f"w{j}" for j in range(200)]
    other = [*words[:60], "edit", *words[61:140], "edit", *words[141:]]
    a, b = " ".join(words), " ".join(other)
    assert similar(brute(a), brute(b))
    kept = corpus_pipeline.dissimilar_documents(None, docs_of([(1, a), (2, b), (3, "something else")]), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_edges(docs_of):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "x y z"), (None, "x y z")]
    assert shingles.drop_similar(docs_of(rows)).count() == 2
    assert shingles.drop_similar(docs_of([])).count() == 0


def test_shingle_sets_by_hand():
    import xxhash

    for text in ["", " \n", "One", "a b c d", "a b c d e", "A b\x0bC d e f g a b c d e f", "x" * 100_000, "w " * 70_000 + "end"]:
        want = {xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in brute(text)}
        got = shingles.shingle_set(text)
        assert {int(x) % 2**64 for x in got} == want and list(got) == sorted(got)
        ones = [sum(h >> k & 1 for h in want) for k in range(64)]
        assert shingles.set_print(got) % 2**64 == sum(1 << k for k in range(64) if 2 * ones[k] > len(want))


def test_recall_of_candidates():
    """Pairs at the threshold itself share a band and come near enough in their fingerprints."""
    import numpy as np

    r, missed, far = np.random.default_rng(5), 0, 0
    random64 = lambda k: r.integers(-(2**63), 2**63, k, dtype=np.int64)
    for n in (4, 9, 45, 450) * 500:
        both = random64(4 if n == 4 else 8 * n // 9)
        own = (0, 1) if n == 4 else (n - len(both), n - len(both))  # 4 of 5, or 8 of 10 parts are shared
        a, b = (np.unique(np.concatenate([both, random64(k)])) for k in own)
        missed += not len(np.intersect1d(shingles.band_keys(a), shingles.band_keys(b)))
        far += ((shingles.set_print(a) ^ shingles.set_print(b)) % 2**64).bit_count() > shingles.APART
    assert missed <= 2 and far <= 2  # of 2,000; expected are 0.15 and 0.01
