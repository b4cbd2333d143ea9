from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from goldpan.llm import mixing


def test_targets_stop_at_the_cap_and_share_the_rest():
    assert mixing.source_targets([100, 100, 100], [3, 1, 2]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.source_targets([1, 1000], [3, 1]) == [2.0, pytest.approx(1499.5)]
    assert mixing.source_targets([], []) == []
    assert mixing.source_targets([0, 0], [3, 1]) == [0.0, 0.0]


def plain_flow_value(patterns, targets, passes):
    """Largest flow by subsets: min cut over the sources (Hall's condition)."""
    n, best = len(targets), None
    for mask in range(1 << n):
        cut = sum(targets[s] for s in range(n) if not mask >> s & 1)
        cut += sum(passes * size for members, size in patterns if any(mask >> s & 1 for s in members))
        best = cut if best is None else min(best, cut)
    return best


def test_flow_is_maximal_and_uses_first_passes_first():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 4)
        patterns = {}
        for _ in range(rng.randint(1, 6)):
            members = tuple(sorted(rng.sample(range(n), rng.randint(1, n))))
            patterns[members] = rng.randint(0, 30)
        patterns = list(patterns.items())
        targets = [rng.randint(0, 40) for _ in range(n)]
        quotas = mixing.pattern_quotas(patterns, targets, 2)
        assert all(0 <= q <= 2 * size for q, (_, size) in zip(quotas, patterns))
        assert sum(quotas) == plain_flow_value(patterns, targets, 2)
        # No cheaper flow: as many words as possible come from first passes.
        first = sum(min(q, size) for q, (_, size) in zip(quotas, patterns))
        assert first == plain_flow_value(patterns, targets, 1)


def check_mix(rows, mixed):
    sizes = collections.Counter()
    for doc_id, text, source in rows:
        sizes[source] += len((text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = mixing.source_targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    target = dict(zip(names, targets))
    source_of = {d: s for d, _, s in rows}
    size_of = {d: len((t or "").split()) for d, t, _ in rows}
    taken = collections.Counter()
    for r in mixed:
        source = source_of[r["doc_id"]]
        assert r["size"] == size_of[r["doc_id"]] and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(target[source])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source] += r["taken"]
    longest = max(size_of.values())
    for s in names:
        assert abs(taken[s] - target[s]) <= longest / 2 + 1
        times = {r["taken"] // r["size"] for r in mixed if source_of[r["doc_id"]] == s and r["size"]}
        assert max(times, default=0) - min(times, default=0) <= 1


def test_mix_documents(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        source = rng.choice(["b", "b", "b", "a", "é", "", None, "z"])
        rows.append((i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 60))), source))
    rows += [(400 + i, "copy of one text", "b") for i in range(300)] + [(900, None, "a"), (901, "", None), (902, " x\ty\x0bz ", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = frame.withColumn("size", F.lit("x")).withColumn("members", F.lit(1)).withColumn("order", F.lit(2))
    mixed = mixing.mix_documents(docs.repartition(5)).collect()
    assert len(mixed) == len(rows)
    check_mix(rows, mixed)
    again = mixing.mix_documents(docs.repartition(2)).collect()
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, again))
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixed if r["size"]}
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter({k: v for k, v in times.items() if v})
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_overlapping_sources(spark):
    rows = [(i, "a b c d", ["x", "y"] if i % 3 == 0 else ["x"] if i % 3 == 1 else ["y", None]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m array<string>")
    mixed = mixing.mix_documents(docs, members=F.col("m"), share=0.5).collect()
    assert {r["taken"] for r in mixed} <= {0, 4, 8}
    assert sum(r["taken"] for r in mixed) > 0


def test_on_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    check_mix(rows, mixing.mix_documents(docs).collect())
