"""Quality classifier: naive Bayes support vectors on hashed byte n-grams.

A text is the set of its byte n-grams (1 to 4 bytes), hashed into ``HASHED`` indicators, and of the
n-grams of the pattern "equals the word before" (runs of one word, which no short byte n-gram can
tell from the word itself). Each indicator is scaled by the log ratio of its smoothed frequency in the two classes, the scaled row
is brought to unit length, and a hinge-loss linear model is fitted on such rows by dual coordinate
descent. A logistic curve on cross-fitted margins turns a margin into a probability.

The class counts cover every labelled row. The linear model and the curve are fitted on at most
``fit_rows`` labelled rows, half of each class, those with the lowest hash of their key (documented
bound); the key chooses rows, it is no input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .package import ship

BUCKET_BITS = 17
HASHED = 1 << BUCKET_BITS
#: Longest run of one word that has an indicator of its own, and shares of repeated words.
RUNS = 8
SHARES = (1 / 16, 1 / 8, 1 / 4, 1 / 2)
BUCKETS = HASHED + RUNS + len(SHARES)
ORDERS = (1, 2, 3, 4)
#: Bytes hashed at once; a longer text is walked in steps of this size.
STEP = 1 << 20


@dataclass
class Model:
    """Weights per bucket, squared scales per bucket (for the row length), and the curve."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, texts) -> np.ndarray:
        mask = np.zeros(BUCKETS, dtype=bool)
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            seen = indicators(text, mask)
            out[i] = self.bias + self.weight[seen].sum() / max(np.sqrt(self.square[seen].sum()), 1e-9)
        return _sigmoid(self.slope * out + self.offset)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def indicators(text: str | None, mask: np.ndarray) -> np.ndarray:
    """Sorted buckets of the n-grams of the whole text; ``mask`` is an all-false work array."""
    encoded = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(encoded, dtype=np.uint8)
    for start in range(0, len(raw), STEP):
        part = raw[start : start + STEP + max(ORDERS) - 1].astype(np.uint32)
        gram = np.zeros(len(part), dtype=np.uint32)
        for n in ORDERS:
            if len(part) < n:
                break
            gram = (gram[: len(part) - n + 1] << np.uint32(8)) | part[n - 1 :]
            mixed = (gram + np.uint32(n * 0x01000193)) * np.uint32(2654435761)
            mask[(mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - BUCKET_BITS)] = True
    words = encoded.split()
    same = bytes(map(eq, words, words[1:]))
    repeated = same.count(1)
    for n in range(1, RUNS + 1):
        if b"\x01" * n not in same:
            break
        mask[HASHED + n - 1] = True
    for i, share in enumerate(SHARES):
        mask[HASHED + RUNS + i] = repeated > share * len(words)
    seen = np.flatnonzero(mask)
    mask[seen] = False
    return seen


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: number of rows of each class that have a bucket; bucket -1 counts the rows."""
    mask = np.zeros(BUCKETS, dtype=bool)
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    rows = [0, 0]
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[label, indicators(text, mask)] += 1
            rows[label] += 1
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.append(used, -1), pa.int32()),
            pa.array(np.append(counts[0, used], rows[0]), pa.int64()),
            pa.array(np.append(counts[1, used], rows[1]), pa.int64()),
        ],
        ["bucket", "low", "high"],
    )


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask = np.zeros(BUCKETS, dtype=bool)
    for batch in batches:
        rows = [indicators(t, mask).astype(np.int32) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.list_(pa.int32())), batch.column(1), batch.column(2)],
            ["buckets", "label", "order"],
        )


def dual_descent(rows, labels, scale, passes: int, cost: float, seed: int):
    """L1-loss support vectors: one dual variable per row, solved coordinate by coordinate.

    ``rows``: bucket arrays; a row's vector is ``scale`` on its buckets, at unit length, and a
    constant 1 for the bias. Returns (weights in the scaled space, bias).
    """
    weight, bias = np.zeros(BUCKETS), 0.0
    norm = [max(np.sqrt((scale[r] ** 2).sum()), 1e-9) for r in rows]
    alpha = np.zeros(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(passes):
        for i in random.permutation(len(rows)):
            row, sign = rows[i], labels[i]
            values = scale[row] / norm[i]
            gradient = sign * (weight[row] @ values + bias) - 1.0
            moved = min(max(alpha[i] - gradient / 2.0, 0.0), cost)  # the squared length is 2
            step = (moved - alpha[i]) * sign
            if step:
                weight[row] += step * values
                bias += step
                alpha[i] = moved
    return weight, bias


def _curve(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one margin with smoothed targets, by Newton steps."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ beta)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def train(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id",
    label: str = "quality", fit_rows: int = 4000, passes: int = 8, cost: float = 1.0,
    smoothing: float = 1.0, folds: int = 3, seed: int = 11,
) -> Model:
    """Fit on the rows of ``docs`` that ``labels`` marks 0 or 1.

    Null keys or labels take no part; a key labelled twice counts twice; a null text is an empty
    one. Without rows of both classes every score is the share of class 1 (0.5 without rows).
    Only the bucket counts (at most ``BUCKETS`` rows) and the bounded sample reach the driver.
    """
    ship(docs.sparkSession)
    marks = labels.where(F.col(label).isin(0, 1)).select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("label")
    )
    rows = (
        docs.where(F.col(key).isNotNull())
        .select(F.col(key).alias("_key"), F.col(text).alias("_text"))
        .join(marks.hint("merge"), "_key")  # marks grow with the documents: never broadcast
        .select(F.coalesce("_text", F.lit("")).alias("text"), "label")
    )
    counted = (
        rows.mapInArrow(_count_rows, "bucket int, low long, high long")
        .groupBy("bucket")
        .agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
        .toArrow()
    )
    bucket, low_rows, high_rows = (counted.column(i).to_numpy() for i in range(3))
    total = bucket < 0
    n0, n1 = int(low_rows[total].sum()), int(high_rows[total].sum())
    flat = Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, 0.0)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        flat.offset = float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30))
        return flat
    low, high = np.zeros(BUCKETS), np.zeros(BUCKETS)
    low[bucket[~total]], high[bucket[~total]] = low_rows[~total], high_rows[~total]
    scale = np.log((high + smoothing) / (high + smoothing).sum()) - np.log(
        (low + smoothing) / (low + smoothing).sum()
    )
    # The sample is drawn from the marks alone, so the texts need no second shuffle: at most
    # ``fit_rows`` keys are sent to the scan.
    drawn = [
        marks.where(F.col("label") == side).where(F.col("_key").isNotNull())
        .select("_key", "label", F.xxhash64(F.lit(seed), "_key").alias("order"))
        .orderBy("order", "_key").limit(fit_rows // 2)
        for side in (0, 1)
    ]
    keys = drawn[0].unionAll(drawn[1]).select("_key", "label")
    found = (
        docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .join(F.broadcast(keys), "_key")
        .select("text", "label", F.xxhash64("text").alias("order"))
        .mapInArrow(_sample_rows, "buckets array<int>, label int, order long")
        .toArrow()
        .combine_chunks()
    )
    lists = found.column("buckets").combine_chunks()
    flat_ids, ends = lists.flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy()
    vectors = [flat_ids[a:b] for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0])]
    side, order = found.column("label").to_numpy(), found.column("order").to_numpy()
    first = sorted(range(len(vectors)), key=lambda i: (order[i], side[i]))  # however rows arrived
    vectors, side, order = [vectors[i] for i in first], side[first], order[first]
    positive = side == 1
    signs = np.where(positive, 1.0, -1.0)
    if not positive.any() or positive.all():  # marks without a document filled the sample
        flat.offset = float(np.log(n1 / n0))
        return flat
    margins = np.zeros(len(vectors))
    # Copies of a text share a fold, or the curve would be fitted on seen rows.
    fold = (order % folds).astype(int)
    for f in range(folds):
        inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        w, b = dual_descent([vectors[i] for i in inside], signs[inside], scale, passes, cost, seed)
        for i in outside:
            values = scale[vectors[i]]
            margins[i] = b + (w[vectors[i]] @ values) / max(np.sqrt((values**2).sum()), 1e-9)
    slope, offset = _curve(margins, positive)
    # The sample is even between the classes; the prior of all labelled rows comes back here.
    sampled = positive.sum() / max((~positive).sum(), 1)
    offset += float(np.log(n1 / n0) - np.log(sampled)) if sampled else 0.0
    w, b = dual_descent(vectors, signs, scale, passes, cost, seed)
    return Model((w * scale).astype(np.float64), scale**2, b, slope, offset)


def score_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Column with the probability of class 1 for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2 x BUCKETS doubles

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return score(F.col(text))


def is_held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """The fold that is never learned from; a null key belongs to no fold and is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(True))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from rows that are not held out."""
    known = labels.where(~is_held_out())
    model = train(docs, known)
    return docs.select(
        "doc_id", is_held_out().alias("held_out"), score_column(docs, model).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns kept."""
    model = train(docs, labels.where(~is_held_out()))
    return docs.where(score_column(docs, model) >= threshold)
