from __future__ import annotations

import random

from test_near_documents import plain_near

from goldpan.llm import near_documents as N


def test_against_shingle_similarity_alone(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([60, 100, 300]))]
        other = list(words)
        for _ in range(max(1, len(words) // 60)):
            other[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    want = plain_near(rows, radius=64)
    assert plain_near(rows) != want  # 5 bits of a fingerprint lose pairs
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (500, 1):
        found = N.near_documents(docs.repartition(4), chunk=chunk)
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == want
