from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from goldpan.llm import decontaminate as D

SPLIT = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in SPLIT.split(lowered) if w]


def plain(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    lengths = {len(k) for k in wins}
    out = []
    for doc_id, text in docs:
        w = plain_words(text)
        hit, who = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                owners = wins.get(tuple(w[i : i + n]))
                if owners:
                    hit.update(range(i, i + n))
                    who |= owners
        digest = hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(who), digest, bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("shingle", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("window_id", F.lit(0))
    return sorted((tuple(r) for r in D.mark_documents(d.repartition(3), b).collect()), key=str)


def test_against_plain_search(spark):
    rng = random.Random(1)
    words = ["a", "b", "the", "É", "é", "x1", "Zed", "und", "ñ", "q"]
    text = lambda n: rng.choice([" ", ", ", "-", "\n", "_"]).join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 14, 30]))) for i in range(12)]
    items = [t for t in items if len(plain_words(t[1])) > 4] + [(50, "one"), (51, "two words"), (52, None), (53, " .. "), (54, "one"), (50, "one")]
    docs = []
    for i in range(60):
        body = text(rng.randint(0, 40))
        if i % 3 == 0:
            part = rng.choice(items)[1] or ""
            body = body + " ... " + part.upper().replace("É", "É") + "; " + text(5)
        docs.append((i, body))
    docs += [(100, None), (101, ""), (102, "ONE"), (103, "two  WORDS two words"), (103, "two  WORDS two words"), (None, "one")]
    docs += [(200 + i, docs[0][1]) for i in range(20)]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs, []) == plain(docs, [])
    assert run(spark, [], items) == []
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    kept = sorted(str(r["doc_id"]) for r in D.clean_rows(d, b).collect())
    assert kept == sorted(str(r[0]) for r in plain(docs, items) if not r[5])


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_BYTES", -1)
    items = [(1, "k l m n o p q r s t u v w x y z"), (2, "a a a a a a a a a a a a")]
    docs = [(1, "zz k l m n o p q r s t u zz"), (2, "a " * 30), (3, "a " * 9), (4, "k l m n o p q r s")]
    assert run(spark, docs, items) == plain(docs, items)


def test_on_test_data(spark):
    folder = "/root/testdata/sf0.01"
    d, b = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = sorted((tuple(r) for r in D.mark_documents(d, b).collect()), key=str)
    want = plain([(r["doc_id"], r["text"]) for r in d.collect()], [(r["item_id"], r["text"]) for r in b.collect()])
    assert got == want and sum(r[5] for r in got) > 0


def test_plan_has_no_python(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = D.mark_documents(d, b)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
