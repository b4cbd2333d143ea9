"""Exact top-k inner products: tiled matrix products, partial selection, tree merge.

Queries are taken in blocks of ``QUERY_ROWS``; a block is a matrix of known size and goes to every
task. A task walks its shard of candidates in tiles, multiplies query tile by candidate tile, keeps
the best k of each product and merges them into its running lists. The lists of the tasks are then
merged in a tree of fan-in ``FAN``, so no merge step sees more than ``FAN * k`` rows of a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .package import ship

QUERY_ROWS = 16_384
QUERY_TILE = 256
ROW_TILE = 4_096
FAN = 16
#: Stands for "no candidate"; scores beyond the range of a long stop at the limits above it.
NONE = np.iinfo(np.int64).min
_LIMIT = (1 << 63) - 1


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component, exact in double precision."""
    return np.floor(values.astype(np.float64) * 256.0)


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products of rows; values that no long can hold stop at the nearest long."""
    bound = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(left.shape[1], 1)
    if bound < 2**53:
        return (left @ right.T).astype(np.int64)
    big = np.array([[int(x) for x in row] for row in left], dtype=object).reshape(left.shape)
    other = np.array([[int(x) for x in row] for row in right], dtype=object).reshape(right.shape)
    out = big @ other.T
    return np.clip(out, -_LIMIT, _LIMIT).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row (ties: smaller id) with their ids, filled up with NONE."""
    rows, width = scores.shape
    if width > k:
        bar = np.partition(scores, width - k, axis=1)[:, width - k]
    else:
        bar = np.full(rows, NONE)
    row, at = np.nonzero((scores >= bar[:, None]) & (scores != NONE))
    value, who = scores[row, at], ids[row, at]
    order = np.lexsort((who, -value, row))
    row, value, who = row[order], value[order], who[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    top = place < k
    out, names = np.full((rows, k), NONE), np.zeros((rows, k), np.int64)
    out[row[top], place[top]] = value[top]
    names[row[top], place[top]] = who[top]
    return out, names


def _matrices(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by their length: (ids, matrix of whole numbers). Other lengths never meet."""
    flat = whole(vectors.flatten().to_numpy(zero_copy_only=False))
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
    names, out = ids.to_numpy(zero_copy_only=False), {}
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        out[int(n)] = names[rows], flat[starts[rows][:, None] + np.arange(n)]
    return out


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {
            n: [np.full((len(ids), k), NONE), np.zeros((len(ids), k), np.int64)]
            for n, (ids, _) in shared.value.items()
        }
        for batch in batches:
            for n, (ids, rows) in _matrices(batch.column(0), batch.column(1)).items():
                if n not in lists:
                    continue
                queries, matrix = shared.value[n]
                scores, names = lists[n]
                for r in range(0, len(ids), ROW_TILE):
                    own, tile = ids[r : r + ROW_TILE], rows[r : r + ROW_TILE]
                    for q in range(0, len(queries), QUERY_TILE):
                        part = slice(q, q + QUERY_TILE)
                        found = product(matrix[part], tile)
                        found[queries[part][:, None] == own[None, :]] = NONE
                        top, who = best(found, np.broadcast_to(own, found.shape), k)
                        scores[part], names[part] = best(
                            np.hstack([scores[part], top]), np.hstack([names[part], who]), k
                        )
        shard = TaskContext.get().partitionId()
        for n, (scores, names) in lists.items():
            row, at = np.nonzero(scores != NONE)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shared.value[n][0][row]), pa.array(names[row, at]),
                    pa.array(scores[row, at]), pa.array(np.full(len(row), shard, np.int64)),
                ],
                ["query_id", "vec_id", "score", "shard"],
            )

    return run


def tree_merge(lists: DataFrame, k: int, fan: int = FAN) -> DataFrame:
    """query_id, rank, vec_id, score from the lists of shards."""
    shards = (lists.agg(F.max("shard")).first()[0] or 0) + 1
    order = (F.col("score").desc(), F.col("vec_id"))
    while shards > 1:
        shards = -(-shards // fan)
        group = Window.partitionBy("query_id", "shard").orderBy(*order)
        lists = (
            lists.withColumn("shard", F.expr(f"shard div {fan}"))
            .withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= k)
        )
    last = Window.partitionBy("query_id").orderBy(*order)
    return lists.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def search(vectors: DataFrame, is_query: Column, k: int = 5, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for every query row.

    ``vectors`` has ``vec_id`` and ``embedding``. Rows whose id or vector is null, or whose vector
    holds a null or non-finite component, take no part. Vectors of another length than the query's
    are no candidates, nor are rows with the query's own id. An id that occurs several times is one
    query (its smallest vector) and several candidates. Empty vectors score 0.
    """
    spark = vectors.sparkSession
    ship(spark)
    finite = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "embedding"
    )
    asked = usable.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = written(asked, "queries")
    blocks = max(1, -(-asked.count() // query_rows))
    found = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        ids, rows = (mine.column(i).combine_chunks() for i in range(2))
        shared = spark.sparkContext.broadcast(_matrices(ids, rows))
        found.append(
            usable.mapInArrow(_search(shared, k), "query_id long, vec_id long, score long, shard long")
        )
    return tree_merge(written(reduce(DataFrame.unionAll, found), "tops"), k)
