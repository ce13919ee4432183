import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe.llm import packing


@pytest.fixture(scope="module")
def untouched():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


@pytest.fixture(scope="module")
def words(untouched):
    """Ids by a tokenizer of its own, as the contract calls it."""
    return lambda text: untouched.encode(text, add_special_tokens=False).ids


def ids(text):
    return np.frombuffer(packing._words(packing.tokenizer_path()).ids(text), "<u4").tolist()


LETTERS = st.text(alphabet=st.one_of(st.sampled_from("abcXYZéßİΣσς'.,-!? \t\n\r\x0b\x1c\u00a0\u2003\u0301日本1290|<>endoftext"), st.characters(codec="utf-8")), max_size=40)
ADDED = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|endoftext|>", "<|endoftext|>." , "'s", "</w>", " "])


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(LETTERS, ADDED), max_size=6).map("".join))
def test_ids_are_those_of_the_untouched_tokenizer(words, text):
    assert ids(text) == words(text)


def test_known_texts(words):
    texts = ["I'll go. Don't, stop... x.y 12,5 ÀÉÎ naïve.", "<|endoftext|> <|startoftext|>", "A.\nB,\tC.", "ſ K Å", "ª º ŉ ǰ", "a<|endoftext|>b.<|endoftext|>", "word.<|startoftext|>", "\u0301<|endoftext|>\u0301e"]
    for text in texts:
        assert ids(text) == words(text)
    assert ids("<|endoftext|> hi") == [49407, 1883]


def test_many_random_texts(words):
    r = random.Random(3)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "hello", "World.", "it's", "é", "e\u0301", "ΣΑΣ", "日本", "12", ",", " ", "\n", "  ", "\u2003", "<|", "|>", "İ"]
    for _ in range(20_000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert ids(text) == words(text), text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_vocabularies(name):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path(name)
    other = Tokenizer.from_file(path)
    for text in ["Hello  World\n it's<|endoftext|> so", "", " a", "ÀÉ 日本"]:
        assert np.frombuffer(packing._words(path).ids(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def brute_exact(have, capacity):
    """Any combination of two to four of what is left that sums to the capacity."""
    from itertools import combinations_with_replacement

    for k in (2, 3, 4):
        for c in combinations_with_replacement([n for n in range(len(have)) if have[n]], k):
            if sum(c) == capacity and all(c.count(x) <= have[x] for x in c):
                return c
    return None


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 23), st.integers(1, 4), max_size=12))
def test_no_exact_combination_is_left(counts):
    have = np.zeros(25, np.int64)
    for n, c in counts.items():
        have[n] = c
    before, out = have.copy(), []
    packing._fill_exactly(have, 24, out)
    assert brute_exact(have.tolist(), 24) is None
    for combination, times in out:
        assert sum(combination) == 24 and times > 0
        for n in combination:
            before[n] -= times
    assert (before == have).all() and (have >= 0).all()


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), max_size=10), st.lists(st.integers(1, 20), max_size=8))
def test_the_index_knows_every_sum(counts, taken):
    from itertools import combinations_with_replacement

    have = np.zeros(31, np.int64)
    for n, c in counts.items():
        have[n] = c
    index = packing.SumIndex(have)
    for n in taken:
        if have[n]:
            index.take([n], 1)
    there = [n for n in range(31) if have[n]]
    for k, find in ((1, index.single), (2, index.pair), (3, index.triple)):
        sums = {sum(c) for c in combinations_with_replacement(there, k) if all(c.count(x) <= have[x] for x in c)}
        for total in range(31):
            got = find(total, 30)
            assert (got is not None) == (total in sums)
            assert got is None or sum(got) == total and all(got.count(x) <= have[x] for x in got)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=30))
def test_plans_use_every_piece_once_within_capacity(counts):
    plan = packing.plan(counts, 64)
    used = dict.fromkeys(counts, 0)
    for lengths, times in plan:
        assert sum(lengths) <= 64 and times > 0
        for n in lengths:
            used[n] += times
    assert used == counts
    need = max(-(-sum(k * v for k, v in counts.items()) // 64), sum(v for k, v in counts.items() if k > 32))
    assert need <= sum(t for _, t in plan) <= 1.5 * need + 1


def test_plans_are_near_the_least():
    r = random.Random(7)
    counts = {}
    for _ in range(20_000):
        n = min(4096, max(2, int(r.lognormvariate(6, 1))))
        counts[n] = counts.get(n, 0) + 1
    plan = packing.plan(counts)
    assert sum(t for _, t in plan) <= -(-sum(k * v for k, v in counts.items()) // 4096) + 1
    assert packing.plan({2000: 3, 2096: 3}) == [((2096, 2000), 3)]
    assert packing.plan({}) == []


def check(rows, docs, words, capacity):
    by, texts = {}, {}
    for i, t in docs:
        texts.setdefault(i, []).append(t or "")
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    want = []
    for i, ts in texts.items():
        for t in ts:
            ids = [*words(t), packing.END]
            for k, s in enumerate(range(0, len(ids), capacity)):
                part = ids[s : s + capacity]
                want.append((i is None, i or 0, k, s, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)


def test_packed_documents(docs_of, words):
    r = random.Random(8)
    docs = [(i, " ".join(r.choice(["alpha", "beta", "gamma."]) for _ in range(r.randint(0, 60)))) for i in range(300)]
    docs += [(500, None), (501, ""), (None, "x"), (7, docs[7][1]), (7, docs[7][1]), (600, "word " * 3000)]
    for capacity, group in ((64, 10), (4096, None)):
        check(packing.pack(docs_of(docs, clashing=True), capacity=capacity, group=group).collect(), docs, words, capacity)
    assert packing.pack(docs_of([])).count() == 0
