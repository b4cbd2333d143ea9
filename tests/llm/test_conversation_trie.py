from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from goldpan.llm import conversation_trie as ct


def plain(rows, family=5, most=8):
    """The whole definition in plain Python."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, _digest(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(found)] for c, found in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % (most + 1)
        rebuilt[c] = tuple(own.get(c - c % family, [])[:h] + own[c][h:])
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (
            min(who), len(node), min(members[node[:-1]]) if node else -1, len(who), len(children.get(node, ())),
            leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(c for c in who if rebuilt[c] == node))).encode()).hexdigest(),
        )
        for node, who in members.items()
    )


def _digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def run(spark, rows, **kw):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = ct.trie(table.selectExpr("*", "1 AS KEY", "'x' AS depth").repartition(5), **kw).collect()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, found))


def made(rng, convs, longest, words):
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("band", [2, 3, 8])
def test_against_plain(spark, band):
    rng = random.Random(band)
    rows = made(rng, 60, 12, ["a", "b", "é漢", "", None, "a b"])
    rows += [(100 + i, t, "user", f"turn {t}") for i in range(30) for t in range(20 + i % 3)]
    rows += [(300, None, "user", "null first"), (300, 1, None, None), (300, 1, None, None), (None, 1, "user", "nobody")]
    rows += [(400, 5, "user", "x"), (401, 1, "user", "only one")]
    rng.shuffle(rows)
    assert run(spark, rows, band=band) == plain(rows)


def test_long_and_deep(spark):
    rows = [(5, t, "user", f"{t}") for t in range(200)] + [(c, t, "user", f"{t}") for c in (10, 15) for t in range(150)]
    rows += [(c, 0, "user", "same") for c in range(20, 320)]
    assert run(spark, rows, band=3) == plain(rows)


def test_turnless_and_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "user", "x")]) == []
    # h of 3 is over 1 and conversation 0 is absent, so nothing is left of it.
    short = next(c for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9 >= 1)
    rows = [(short, 0, "user", "x")]
    assert run(spark, rows) == plain(rows) == [
        (short, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())
    ]


def test_ids_without_family_zero(spark):
    rows = [(c, t, "user", str(t % 3)) for c in (2, 3, 4, 7, 1000003) for t in range(10)]
    assert run(spark, rows) == plain(rows)


def test_ids_of_a_node_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(ct, "PART", 7)
    rows = [(5 * c, 0, "user", "same") for c in range(0, 200, 3)] + [(5 * c, 0, "user", "other") for c in range(1, 90, 3)]
    assert run(spark, rows) == plain(rows)
