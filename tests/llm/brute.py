"""What the operators compute, computed by hand: nothing here imports them."""

import math
import re
import struct
from collections import Counter, defaultdict

import xxhash


class Small(int):
    """A literal, hashed as four bytes."""


def spark_hash(*values):
    """Spark's xxhash64, unsigned: nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, Small) else "<Q", v if isinstance(v, Small) else v % 2**64)
            h = xxhash.xxh64_intdigest(raw, h)
    return h


def row_keys(i, text):
    return spark_hash(Small(1), i, text), spark_hash(Small(2), text, i)


def uniform(h):
    return ((h >> 11) + 0.5) * 2.0**-53


def quality_features(text):
    tokens = re.findall(r"\w+|[^\w\s]+", text.lower())
    number = [xxhash.xxh32_intdigest(t.encode()) >> 16 for t in tokens]
    one = [n * 0x9E3779B97F4A7C15 % 2**64 for n in number]
    two = [(a ^ (n * 0xC2B2AE3D27D4EB4F + 1) % 2**64) * 0x9E3779B97F4A7C15 % 2**64 for a, n in zip(one, number[1:], strict=False)]
    return [(h >> 40) % 65_536 for h in one + two]


def quality(rows, labels):
    """(scores and keys by id, ids kept) of (id, text) rows and (id, quality) labels; ids are distinct."""
    good = {i for i, q in labels if q}
    raw, target = Counter(), Counter()
    for i, t in rows:
        f = quality_features(t or "")
        raw.update(f)
        if i in good:
            target.update(f)
    all_raw, all_target = sum(raw.values()) + 0.5 * 65_536, sum(target.values()) + 0.5 * 65_536
    found = {}
    for i, t in rows:
        score = sum(math.log((target[b] + 0.5) / all_target) - math.log((raw[b] + 0.5) / all_raw) for b in quality_features(t or ""))
        u = uniform(spark_hash(Small(42), *row_keys(i, t or "")))
        found[i] = score, score - math.log(-math.log(u))
    k = round(len(rows) * len(good) / len(labels))
    return found, set(sorted(found, key=lambda i: -found[i][1])[:k])


def mixing(rows):
    """(cell, tokens, probability, kept) for each of (id, text, lang, source) rows."""
    cells, of = defaultdict(int), []
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    for _, t, lang, source in rows:
        found = [signed(spark_hash(w)) % 8 for w in re.findall(r"[^\W\d_]{6,}", (t or "").lower())]
        topic = f"t{max(range(8), key=lambda k: (found.count(k), -k))}" if found else None
        of.append((source, lang, topic))
        cells[source, lang, topic] += len((t or "").split())
    whole = sum(cells.values())
    weight = dict.fromkeys(cells, 1.0)
    goals = []
    for d in range(3):
        now = defaultdict(float)
        for c, n in cells.items():
            now[c[d]] += n
        if d == 1:
            named = {"en": 0.52, "fr": 0.16, "de": 0.16, "es": 0.11}
            rest = sum(n for v, n in now.items() if v not in named)
            share = {v: (named[v] if v in named else 0.05 * n / rest) if n else 0.0 for v, n in now.items()}
        else:
            share = {v: (n / whole) ** (0.8, 0, 0.9)[d] if n else 0.0 for v, n in now.items()}
        goals.append({v: x * whole / sum(share.values()) for v, x in share.items()})
    for _ in range(1000):
        before = dict(weight)
        for d in range(3):
            now = defaultdict(float)
            for c, n in cells.items():
                now[c[d]] += weight[c] * n
            for c in cells:
                weight[c] *= goals[d][c[d]] / now[c[d]] if now[c[d]] else 1.0
        if all(abs(weight[c] - before[c]) <= 1e-9 * weight[c] for c in cells):
            break
    low, high = 0.0, 1e9
    for _ in range(200):  # bisection for the scale
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1.0, weight[c] * mid) * n for c, n in cells.items()) < 0.8 * whole else (low, mid)
    out = []
    for (i, t, *_), c in zip(rows, of, strict=True):
        p = min(1.0, weight[c] * low)
        u = uniform(spark_hash(Small(42), "mix", *row_keys(i, t or "")))
        out.append((c, len((t or "").split()), p, u < p))
    return out
