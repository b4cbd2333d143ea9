from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
import xxhash

from goldpan.llm import graph, simhash


def plain_fingerprint(text: str | None, words: int = 3) -> int:
    """Word for word from the definition, without numpy."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = [p for p in __import__("re").split("[\x20\x09-\x0d]+", lowered) if p]
    if not parts:
        return 0
    grams = [parts[i : i + words] for i in range(len(parts) - words + 1)] or [parts]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict[int, int], radius: int) -> dict[int, int]:
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(prints, 2):
        if (prints[x] ^ prints[y]).bit_count() <= radius:
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    return {d: find(d) for d in prints}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.covering_masks(list(range(64)), radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(64), min(radius, 2)):
        changed = sum(1 << b for b in bits)
        assert any(not m & changed for m in masks)
    rng = random.Random(1)
    for _ in range(2000):
        changed = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not m & changed for m in masks)


def test_second_buckets_are_bounded():
    for mask in simhash.covering_masks(list(range(64)), 2):
        free = [b for b in range(64) if not mask >> b & 1]
        for again in simhash.covering_masks(free, 2):
            assert 64 - (mask | again).bit_count() <= 12


def test_fingerprint_is_the_definition():
    rng = random.Random(2)
    texts = [None, "", " \t\n", "one", "ONE two", "ÀB ÀB ÀB c d", "a\x0bb\x1cc  d e f"]
    texts += [" ".join(rng.choice("abcdefgXYZ") for _ in range(n)) for n in (3, 4, 10, 300, 700)]
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components_of_stars_and_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, n) for n in range(101, 160)] + [(7, 7), (None, 3), (5, 4)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == [(i, 0) for i in range(41)] + [(n, 100) for n in range(100, 160)]


@pytest.mark.parametrize("bucket", [3, 2048])
def test_links_equal_all_pairs(spark, bucket):
    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(12):
            base_near = base
            for b in rng.sample(range(64), rng.randint(1, 4)):
                base_near ^= 1 << b
            prints.add(base_near)
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long").repartition(3)
    links = simhash.links(frame, 2, bucket)
    pairs = {tuple(sorted(r)) for r in links.collect()}
    real = {
        tuple(sorted((simhash._signed(a), simhash._signed(b))))
        for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 2
    }
    assert pairs <= real
    got = {r["node"]: r["root"] for r in graph.components(links).collect()}
    want = plain_components({simhash._signed(p): p for p in prints}, 2)
    assert {p: got.get(p, p) for p in want} == want


def test_stream_of_buckets_split_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 6, 300).astype(np.int64)
    prints = np.unique(prints)
    kept = prints >> 3
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(prints), np.int32)), pa.array(kept), pa.array(prints)], ["part", "kept", "print"])
    for size in (1, 5, 100):
        batches = [rows.slice(i, size) for i in range(0, len(prints), size)]
        for limit in (None, 4):
            out = [b.to_pydict() for b in simhash._link(2, limit)(iter(batches))]
            edges = [(a, b) for o in out for a, b, p in zip(o["a"], o["b"], o["part"]) if p is None]
            large = [a for o in out for a, p in zip(o["a"], o["part"]) if p is not None]
            sizes = {k: int((kept == k).sum()) for k in set(kept.tolist())}
            assert sorted(large) == [p for p in prints.tolist() if limit and sizes[p >> 3] > limit]
            assert all((a ^ b).bit_count() <= 2 and a >> 3 == b >> 3 for a, b in edges)


def test_near_duplicates_and_survivors(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(40):
        text = " ".join(word() for _ in range(rng.choice([2, 30, 400])))
        rows += [(3 * i, text, "x"), (3 * i + 1, text.upper(), "y")]
        rows.append((3 * i + 2, text + " " + word(), "z"))
    rows += [(500, None, "n"), (501, "", "n"), (None, "", "n"), (500, None, "n"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _first string").repartition(4)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows if r[0] is not None}
    want = plain_components(prints, 2)
    for r in found:
        if r["doc_id"] is None:
            assert r["fingerprint"] == "0" * 16 and r["component_id"] == 500
        else:
            assert r["fingerprint"] == format(prints[r["doc_id"]], "016x")
            assert r["component_id"] == want[r["doc_id"]]
    stay = simhash.first_of_each(docs, simhash.near_duplicates(docs))
    assert stay.columns == docs.columns
    ids = sorted(r["doc_id"] for r in stay.collect() if r["doc_id"] is not None)
    assert ids == sorted(set(want.values()))
    assert stay.where("doc_id is null").count() == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
