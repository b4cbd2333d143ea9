from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from goldpan.llm import topk


def plain(rows, step, k):
    good = [
        (i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _ in good if i % step == 0}):
        vector = min(v for i, v in good if i == q)
        scored = [(-sum(a * b for a, b in zip(vector, v)), i) for i, v in good if i != q and len(v) == len(vector)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def run(spark, rows, step, k, **kw):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))
    return sorted(map(tuple, topk.search(frame.repartition(7), F.col("vec_id") % step == 0, k, **kw).collect()))


def test_against_all_pairs(spark, monkeypatch):
    rng = random.Random(1)
    vector = lambda n=6: [float(np.float32(rng.uniform(-2, 2))) for _ in range(n)]
    rows = [(i, vector()) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(120)]
    rows += [(600, None), (601, [None] * 6), (602, [float("nan")] * 6), (603, [float("inf")] + [0.0] * 5), (None, vector())]
    rows += [(700, vector(4)), (701, vector(4)), (750, []), (751, []), (10, vector()), (10, rows[10][1])]
    assert run(spark, rows, 10, 5) == plain(rows, 10, 5)
    assert run(spark, rows, 10, 5, query_rows=9) == plain(rows, 10, 5)
    monkeypatch.setattr(topk, "FAN", 2)
    assert run(spark, rows[:3], 2, 5) == plain(rows[:3], 2, 5)
    assert run(spark, [], 10, 5) == []


def test_exact_beyond_doubles():
    left = np.array([[2.0**40, 3.0], [2.0**40 + 1, 1.0]])
    right = np.array([[2.0**20 + 1, 5.0], [2.0**40, 2.0**40]])
    out = topk.product(left, right)
    assert out[0, 0] == 2**40 * (2**20 + 1) + 15 and out[0, 1] == 2**63 - 1


def test_best_breaks_ties_by_id():
    scores = np.array([[5, 7, 7, 7, topk.NONE], [1, topk.NONE, topk.NONE, topk.NONE, topk.NONE]])
    ids = np.array([[9, 8, 3, 5, 1], [4, 1, 2, 3, 5]])
    top, who = topk.best(scores, ids, 2)
    assert top.tolist() == [[7, 7], [1, topk.NONE]] and who[0].tolist() == [3, 5] and who[1, 0] == 4
