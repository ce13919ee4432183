import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from loomframe.llm import simhash
from loomframe.llm.components import connected_components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_the_code_is_the_perfect_golay_code():
    error, weight, more = simhash._tables()
    assert Counter(weight.tolist()) == {0: 1, 1: 23, 2: 253, 3: 1771}
    assert (more[weight == 3] >= 0).all() and (more[weight < 3] < 0).all()
    codewords = np.flatnonzero(simhash._remainder(np.arange(1 << 23)) == 0)
    assert len(codewords) == 4096 and set(np.bitwise_count(codewords).tolist()) == {0, 7, 8, 11, 12, 15, 16, 23}


def test_words_one_bit_apart_share_an_index():
    r = np.random.default_rng(11)
    words = r.integers(0, 1 << 23, 3000)
    a = simhash.nearby(words)
    for bit in range(23):
        b = simhash.nearby(words ^ (1 << bit))
        assert ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_fingerprints_two_bits_apart_share_a_key():
    r = np.random.default_rng(12)
    f = r.integers(0, 2**64, 400, dtype=np.uint64)
    for _ in range(30):
        i, j = r.integers(0, 64, 2).astype(np.uint64)
        g = f ^ (np.uint64(1) << i) ^ (np.uint64(1) << j)
        ra, ka = simhash.fuzzy_keys(f)
        rb, kb = simhash.fuzzy_keys(g)
        shared = set(zip(ra.tolist(), ka.tolist(), strict=True)) & set(zip(rb.tolist(), kb.tolist(), strict=True))
        assert {x for x, _ in shared} == set(range(400))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b\x0bC", "É é\u00a0x É é\u00a0x É", "a b c a b c a b c d", "x" * 100_000, "w " * 80_000 + "end"])
def test_fingerprints_by_hand(text):
    assert simhash.fingerprint(text or "") == brute_print(text)


def clustered(n, seed, span=3):
    """Fingerprints in groups: chains and balls around a few centres, and some alone."""
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 5, 60])):
            out.add(x)
            for _ in range(r.randint(1, span)):
                x ^= 1 << r.randrange(64)
    return sorted(out)[:n]


@pytest.mark.parametrize("bucket", [2, 5, 1024])
def test_links_are_whole_for_every_bucket_size(spark, bucket):
    prints = clustered(600, 13)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "f long").repartition(4)
    got = {r["node"]: r["component"] for r in simhash.near_components(df, bucket).collect()}
    want = brute_components(dict(zip(signed, prints, strict=True)))
    assert {p: got.get(p, p) for p in signed} == want


def test_a_dense_ball(spark):
    centre = random.Random(14).getrandbits(63)
    ball = sorted({centre ^ (1 << i) ^ (1 << j) for i in range(63) for j in range(i)})
    df = spark.createDataFrame([(p,) for p in ball], "f long")
    for bucket in (16, 1024):
        got = {r["component"] for r in simhash.near_components(df, bucket).collect()}
        assert got == {min(ball)}


@pytest.mark.parametrize("clashing", [False, True])
def test_documents_match_brute_force(docs_of, clashing):
    r = random.Random(15)
    rows, i = [], 0
    for _ in range(40):
        words = [r.choice("the of and to in is that it was for on".split()) + str(r.randint(0, 50)) for _ in range(r.randint(1, 120))]
        for _ in range(r.randint(1, 4)):
            rows.append((i, " ".join(words)))
            i += 1
            words[r.randrange(len(words))] = "edit"
    rows += [(1000, None), (1001, ""), (999, "\n"), (1002, rows[0][1].upper())]
    got = {r["doc_id"]: r for r in simhash.simhash_groups(docs_of(rows, clashing)).collect()}
    prints = {d: brute_print(t) for d, t in rows}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints.items()}
    want = brute_components(prints)
    assert {d: r["component_id"] for d, r in got.items()} == want


def test_edges(docs_of):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "x y z"), (None, "x y z")]
    got = simhash.simhash_groups(docs_of(rows)).collect()
    assert len(got) == 5 and {r["component_id"] for r in got} == {5, None}
    assert simhash.drop_near_copies(docs_of(rows)).count() == 2
    assert simhash.simhash_groups(docs_of([])).count() == 0 and simhash.drop_near_copies(docs_of([])).count() == 0


def test_a_star_of_many_leaves(spark):
    """The hub of a star is joined by rows dealt out anew: no aggregate feeds a join of the links directly."""
    n = 30_000
    links = spark.range(n).selectExpr("id + 10 AS a", "5L AS b")
    got = connected_components(links)
    assert got.count() == n + 1 and [r["component"] for r in got.select("component").distinct().collect()] == [5]


def test_components(spark):
    r = random.Random(16)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 7)] + [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(200)] + [(5000, x) for x in range(4000, 4200)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
