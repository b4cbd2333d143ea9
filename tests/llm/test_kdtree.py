from __future__ import annotations

import collections
import random
import zlib

from pyspark.sql import functions as F

from goldpan.llm import kdtree


def check(rows, found, shards):
    assert len(found) == len(rows)
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in found:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    total, longest = sum(size.values()), max(r["size"] for r in found)
    depth = (shards - 1).bit_length()
    for s in range(shards):
        assert abs(size[s] - total / shards) <= depth * longest
    got = collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found)
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert got == want


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randint(0, 50), rng.choice(["en", "de", None, "fr", "en"]), rng.randint(0, 90)) for i in range(600)]
    rows += [(700 + i, "copy of a text", "en", 14) for i in range(400)]
    rows += [(None, None, None, None), (5, "", "x", 0), (5, "", "x", 0), (1200, "z" * 3000, "en", 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    docs = docs.withColumn("size", F.lit("a")).withColumn("_first", F.lit(1)).repartition(5)
    for shards in (16, 5, 1):
        found = kdtree.shard_documents(docs, shards=shards).collect()
        check(rows, found, shards)
    again = kdtree.shard_documents(docs.repartition(3), shards=5).collect()
    once = kdtree.shard_documents(docs, shards=5).collect()
    assert sorted(map(str, again)) == sorted(map(str, once))
    assert kdtree.shard_documents(docs.limit(0), shards=4).count() == 0
    assert kdtree.shard_documents(docs, target_bytes=10_000).agg(F.max("shard")).first()[0] == sum(len((t or "").encode()) + 1 for _, t, *_ in rows) // 10_000


def test_copies_stay_together_where_no_cut_falls(spark):
    rows = [(i, f"text {i % 40}" + "x" * (i % 40), "en", i % 40) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    homes = collections.defaultdict(set)
    for r in kdtree.shard_documents(docs, shards=8).collect():
        homes[r["text_crc32"]].add(r["shard"])
    assert sum(len(h) - 1 for h in homes.values()) <= 7


def test_plan_has_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = kdtree.shard_documents(docs, shards=4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
