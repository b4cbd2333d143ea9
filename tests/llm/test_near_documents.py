from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from goldpan.llm import near_documents as N
from goldpan.llm.simhash import fingerprint, first_of_each


def plain_shingles(text):
    parts = (text or "").lower().split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def plain_near(rows, radius=5):
    """component of every id, by all pairs."""
    prints = {d: fingerprint(t, 2) for d, t in rows}
    sets = {d: plain_shingles(t) for d, t in rows}
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 6)))
    base = [[word() for _ in range(rng.choice([1, 4, 7, 60, 300]))] for _ in range(14)]
    rows = []
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            words[rng.randrange(len(words))] = word()
        text = rng.choice([" ", "\n"]).join(words)
        rows.append((i, text.upper() if rng.random() < 0.2 else text))
    return rows + [(200, None), (201, ""), (202, " \n")]


def test_against_all_pairs(spark):
    rows = corpus(random.Random(1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("print", F.lit(1))
    want = plain_near(rows)
    for chunk in (500, 3):
        found = N.near_documents(docs.repartition(4), chunk=chunk)
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == want
    stay = first_of_each(docs, found)
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(set(want.values()))
    odd = docs.unionAll(docs.where("doc_id < 3")).unionAll(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    again = N.near_documents(odd).collect()
    assert len(again) == len(rows) + 4
    assert {r["component_id"] for r in again if r["doc_id"] is None} == {want[5]}
    assert N.near_documents(docs.limit(0)).count() == 0


def test_similarity():
    words = [f"w{i}" for i in range(104)]
    other = words[:50] + ["x"] + words[51:]
    assert N.alike(N.shingles(" ".join(words)), N.shingles(" ".join(other)))
    assert not N.alike(N.shingles(" ".join(words)), N.shingles(" ".join(words[:70])))
    assert N.alike(N.shingles(None), N.shingles(" ")) and not N.alike(N.shingles(""), N.shingles("a"))
    for n in (1, 4, 5, 6):
        assert len(N.shingles(" ".join(words[:n]))) == max(1, n - 4)
