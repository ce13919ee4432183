import base64
import hashlib
import random
import struct

import pytest

from loomframe.llm import lzprint


def brute_phrases(data):
    seen, at = set(), 0
    for end in range(1, len(data) + 1):
        if data[at:end] not in seen:
            seen.add(data[at:end])
            at = end
    return seen


def test_phrases_are_those_of_the_parse():
    r = random.Random(19)
    for n in (0, 1, 2, 50, 3000):
        data = bytes(r.choice(b"abcd \xc3\xa9") for _ in range(n))
        hashes = lzprint._phrases(data).tolist()
        want = brute_phrases(data)
        assert len(hashes) == len(set(hashes)) == len(want)
    a, b = b"abababab", b"abababxy"
    shared = len(set(lzprint._phrases(a).tolist()) & set(lzprint._phrases(b).tolist()))
    assert shared == len(brute_phrases(a) & brute_phrases(b))


def text(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(n))


def test_likeness_estimates_the_jaccard_index():
    r = random.Random(20)
    errors = []
    for _ in range(40):
        a = text(r, 400)
        k = r.randint(0, len(a))
        b = a[:k] + text(r, 400)[k:]
        x, y = brute_phrases(a.encode()), brute_phrases(b.encode())
        errors.append(abs(lzprint.similarity(lzprint.fingerprint(a), lzprint.fingerprint(b)) - len(x & y) / len(x | y)))
    assert sum(errors) / len(errors) < 0.06
    assert lzprint.similarity("", "") == 1 and lzprint.similarity("", lzprint.fingerprint("x")) == 0
    assert lzprint.fingerprint("") == "" and lzprint.similarity(lzprint.fingerprint(a), lzprint.fingerprint(a)) == 1


def brute_hash(phrase):
    h = 0x9E3779B97F4A7C15
    for byte in phrase:
        h = (h * 6364136223846793005 + byte + 1) % 2**64
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
    return (h ^ h >> 31) >> 32


def brute_signature(text):
    return sorted({brute_hash(p) for p in brute_phrases(text.encode())})[:64]


def brute_print(text):
    return base64.b64encode(b"".join(struct.pack("<I", h) for h in brute_signature(text))).decode()


def brute_likeness(a, b):
    a, b = brute_signature(a), brute_signature(b)
    union = sorted({*a, *b})[:64]
    return sum(h in a and h in b for h in union) / len(union) if union else 1.0


def test_signatures_by_hand():
    r = random.Random(24)
    for t in ["", "a", "aaaaaaaa", "é \U0001f600", *(text(r, n) for n in (3, 50, 1500))]:
        assert lzprint.fingerprint(t) == brute_print(t)


def test_long_texts_have_the_same_parse(monkeypatch):
    r = random.Random(21)
    texts = [text(r, n) for n in (1, 300, 6000)]
    want = [brute_print(t) for t in texts]
    monkeypatch.setattr(lzprint, "LONG", 10)
    monkeypatch.setattr(lzprint._LongParse.__init__, "__defaults__", (16,))
    assert [lzprint.fingerprint(t) for t in texts] == want
    # Fed in parts, as it is whole.
    data = texts[2].encode()
    parse = lzprint._LongParse()
    for at in range(0, len(data), 777):
        parse.feed(data[at : at + 777])
    assert set(parse.hashes[1 : parse.n].tolist()) == set(lzprint._phrases(data).tolist()) and parse.n - 1 == len(brute_phrases(data))


def test_a_text_above_the_switch():
    r = random.Random(25)
    t = text(r, 900_000)
    assert len(t) > lzprint.LONG
    short = lzprint._Parse()
    short.feed(t.encode())
    assert (lzprint.signature(t) == short.lowest(0, 64)).all()


@pytest.mark.parametrize("partitions", ["1", "5", "40"])
@pytest.mark.parametrize("clashing", [False, True])
def test_documents_match_brute_force(spark, docs_of, partitions, clashing):
    r = random.Random(22)
    rows = [(i * 3, text(r, r.randint(0, 60))) for i in range(30)] + [(200, None), (201, ""), (202, "é" * 50), (203, text(r, 9000)), (204, "ab")]
    r.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["doc_id"]: r for r in lzprint.compare_with_edits(docs_of(rows, clashing)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    order = sorted(rows, key=lambda x: -x[0])
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        e = t[: len(t) - n] + following[:n]
        assert tuple(got[i])[1:] == (len(t), hashlib.sha256(e.encode()).hexdigest(), brute_print(t), brute_print(e), brute_likeness(t, e), brute_likeness(t, following))


def test_edges(docs_of):
    assert lzprint.compare_with_edits(docs_of([])).count() == 0
    one = lzprint.compare_with_edits(docs_of([(1, "abcdef")])).collect()
    assert [(r["n_chars"], r["near_next"]) for r in one] == [(6, 1.0)]
    rows = [(None, "a b"), (None, None), (2, "same"), (2, "same"), (3, "x")]
    got = lzprint.compare_with_edits(docs_of(rows)).collect()
    assert len(got) == 5 and len({r["fingerprint"] for r in got if r["doc_id"] == 2}) == 1
    prints = lzprint.fingerprint_documents(docs_of(rows)).collect()
    assert len(prints) == 5 and {r["fingerprint"] for r in prints if r["doc_id"] == 2} == {lzprint.fingerprint("same")}
