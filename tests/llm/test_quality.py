from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from goldpan.llm import quality


def test_indicators_are_the_set_of_grams():
    mask = np.zeros(quality.BUCKETS, dtype=bool)
    once = quality.indicators("abcabc", mask)
    assert not mask.any() and len(once) == 3 + 3 + 3 + 3
    assert quality.indicators(None, mask).size == quality.indicators("", mask).size == 0
    runs = quality.indicators("a a a b", mask)
    assert {quality.HASHED, quality.HASHED + 1} <= set(runs.tolist()) and quality.HASHED + 2 not in runs


def test_long_texts_are_walked_whole(monkeypatch):
    mask = np.zeros(quality.BUCKETS, dtype=bool)
    text = "".join(random.Random(1).choice("abcdé ") for _ in range(5000))
    whole = quality.indicators(text, mask)
    monkeypatch.setattr(quality, "STEP", 97)
    assert quality.indicators(text, mask).tolist() == whole.tolist()


def test_dual_descent_solves_the_hinge_problem():
    """Against sub-gradient descent on the primal."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(80)]
    signs = np.array([1.0 if 3 in r or 4 in r else -1.0 for r in rows])
    scale = np.zeros(quality.BUCKETS)
    scale[:30] = rng.normal(size=30) + 2
    w, b = quality.dual_descent(rows, signs, scale, 400, 1.0, 0)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt((scale[r] ** 2).sum())
    x[:, 30] = 1.0
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - signs * (x @ v)).sum()
    v, best = np.zeros(31), np.inf
    for step in range(1, 20001):
        v -= (v - (signs * (signs * (x @ v) < 1)) @ x) / step
        best = min(best, loss(v))
    assert loss(np.append(w[:30], b)) <= best * 1.002


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score_documents(docs.withColumn("label", F.lit(1)).withColumn("_text", F.lit(2)), labels).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    assert (found.predicted == (found.score >= 0.3)).all()
    assert (found.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in found.doc_id]).all()
    judged = found.merge(labels.toPandas(), on="doc_id")
    out = judged[judged.held_out]
    low, high = out[out.quality == 0].score.to_numpy(), out[out.quality == 1].score.to_numpy()
    assert (high[:, None] > low[None]).mean() > 0.98
    assert (out.predicted == out.quality).mean() > 0.95
    # Labels of held-out rows change nothing.
    other = labels.withColumn("quality", F.when(quality.is_held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score_documents(docs, other).toPandas()
    assert again.sort_values("doc_id").score.tolist() == found.sort_values("doc_id").score.tolist()


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "good text here"), (2, None), (3, ""), (None, "x"), (4, "bad!! bad!!"), (4, "bad!! bad!!"), (6, "z" * 3_000_000)],
        "doc_id long, text string",
    )
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (2, None), (9, 1), (1, 1)], "doc_id long, quality int")
    found = quality.score_documents(docs, labels).collect()
    assert len(found) == 7 and all(0 <= r["score"] <= 1 for r in found)
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    none = quality.score_documents(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    one = quality.score_documents(docs, labels.where("quality = 1")).collect()
    assert all(r["predicted"] == 1 for r in one)
    assert quality.accepted(docs, labels.where("quality = 1")).columns == docs.columns
