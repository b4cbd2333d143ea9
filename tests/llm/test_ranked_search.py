from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from goldpan.llm import ranked_search as rs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    split = [(i, Counter(words(t))) for i, t in docs]
    split = [(i, c, c.total()) for i, c in split if c]
    n, length = len(split), sum(s for *_, s in split)
    df = Counter(t for _, c, _ in split for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in split:
            m = 100 - 25 + (25 * size * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in words(text) if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(str(item), r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k):
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS score").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 AS item", "'y' AS rank")
    return sorted(((str(r[0]), *r[1:]) for r in map(tuple, rs.rank_documents(a, b, k).collect())), key=str)


def made(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Über", "漢字", "x9", "é"] + [f"w{i}" for i in range(80)]
    weight = [60, 50] + [4] * 4 + [60 / (i + 2) for i in range(80)]
    text = lambda m: rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, weight, k=m)).upper()
    docs = [(i, text(rng.choice([1, 3, 20, 60]))) for i in range(n)]
    docs += [(1000 + i, "same text w1 w2 of the") for i in range(60)] + [(5, "w3 w3 w3"), (5, "w3"), (None, "w4 of"), (None, "w4 of")]
    docs += [(2000, None), (2001, ""), (2002, " ,.- "), (2003, text(30000))]
    items = [(i, text(rng.randint(1, 30))) for i in range(25)] + [(90, None), (91, ""), (92, "absent words"), (3, "w1 w1 of")]
    return docs, items + [(93, "same text"), (None, "w4")]


@pytest.mark.parametrize("small,k", [(True, 20), (False, 5)])
def test_against_plain(spark, monkeypatch, small, k):
    docs, items = made(k)
    if not small:
        monkeypatch.setattr(rs, "TERM_BYTES", 10)
        monkeypatch.setattr(rs, "PASS_TERMS", 100)
    monkeypatch.setattr(rs, "FIRST_READ", 4)
    assert run(spark, docs, items, k) == plain(docs, items, k)


def test_empty_tables(spark):
    docs, items = made(1, 5)
    assert run(spark, [], items, 3) == [] and run(spark, docs, [], 3) == []
    assert run(spark, [(1, None), (2, "?")], items, 3) == []


def test_long_text_is_counted_in_steps(monkeypatch):
    monkeypatch.setattr(rs, "STEP", 7)
    text = "Aa bb! " * 50 + "x" * 40 + " é漢 Ä"
    assert rs.counted(text.encode()) == Counter(t.encode() for t in words(text))
    assert rs.counted(None) == rs.counted(b"") == Counter()


def test_every_byte_as_the_pattern():
    text = "".join(map(chr, range(256))) + "a".join(map(chr, range(128)))
    assert rs.counted(text.encode()) == Counter(t.encode() for t in words(text))


def test_bounds_resolve_membership_and_ties():
    rng = np.random.default_rng(5)
    for trial in range(60):
        rows, k = 500, int(rng.integers(1, 12))
        lists, whole = [], np.zeros(rows, dtype=np.int64)
        for _ in range(int(rng.integers(1, 9))):
            who = rng.permutation(rows)[: int(rng.integers(0, rows))]
            impact = np.sort(rng.integers(1, rng.choice([3, 50, 10**9]), len(who)))[::-1].astype(np.int64)
            lists.append((who, impact))
            whole[who] += impact
        found, scores = rs.best_of(lists, rows, k)
        assert (whole[found] == scores).all()
        positive = np.sort(whole[whole > 0])[::-1]
        edge = positive[k - 1] if len(positive) >= k else 1
        assert sorted(found.tolist()) == np.flatnonzero(whole >= edge).tolist()


def test_reading_stops_early():
    """One clear winner: the rest of a long list stays unread."""
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read.append(key.stop)
            return super().__getitem__(key)

    who = np.arange(100_000).view(Watched)
    impact = np.r_[10**6, np.full(99_999, 10)].astype(np.int64)
    found, scores = rs.best_of([(who, impact)], 100_000, 1)
    assert found.tolist() == [0] and scores.tolist() == [10**6] and max(read) <= rs.FIRST_READ
