"""Sharding, resuming and seeding (family J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import row_seed
from ..operators import batch
from . import inputs
from .inputs import SAMPLES, with_
from .registry import Tables, query


@query(
    "j01_stride_shard",
    with_(SAMPLES)
    + """SELECT source_index, sample_id, source_index % 4 AS shard, source_index // 4 AS shard_position
FROM samples""",
)
def _(t: Tables):
    return batch.stride_shard(inputs.samples(t).select("source_index", "sample_id"), 4)


@query(
    "j01_merge_issues",
    """WITH merged AS (SELECT l_orderkey + 7 AS source_index FROM lineitem),
counts AS (SELECT source_index, count(*) AS n FROM merged GROUP BY 1)
SELECT coalesce(o.o_orderkey, c.source_index) AS source_index,
  CASE WHEN c.n IS NULL THEN 'missing' WHEN o.o_orderkey IS NULL THEN 'unexpected'
       ELSE 'duplicate' END AS issue
FROM orders o FULL JOIN counts c ON c.source_index = o.o_orderkey
WHERE c.n IS NULL OR o.o_orderkey IS NULL OR c.n > 1""",
)
def _(t: Tables):
    merged = t.lineitem.selectExpr("l_orderkey + 7 AS source_index")
    return batch.merge_issues(inputs.samples(t), merged, "source_index")


@query(
    "j02_remaining",
    "SELECT o_orderkey AS source_index FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def _(t: Tables):
    done = t.lineitem.selectExpr("l_orderkey AS source_index")
    return batch.remaining(inputs.samples(t).select("source_index"), done, ["source_index"])


@query(
    "j02_prefix_violations",
    """SELECT o_orderkey AS source_index FROM orders WHERE o_orderkey NOT IN
  (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
AND o_orderkey <= (SELECT max(l_orderkey) FROM lineitem WHERE l_returnflag = 'A'
  AND l_orderkey IN (SELECT o_orderkey FROM orders))""",
)
def _(t: Tables):
    done = t.lineitem.where("l_returnflag = 'A'").selectExpr("l_orderkey AS source_index")
    return batch.prefix_gaps(inputs.samples(t).select("source_index"), done, "source_index")


@query(
    "j03_row_seed",
    """SELECT o_orderkey AS source_index, (42 * 1000003 + 97409 + CAST(o_orderkey AS BIGINT) * 9176)
  % 2147483647 AS seed FROM orders""",
)
def _(t: Tables):
    return t.orders.select(
        F.col("o_orderkey").alias("source_index"), row_seed(42, F.col("o_orderkey"), 1).alias("seed")
    )


def _round(turn: int) -> str:
    """One round of the permutation in SQL; l and r are below a and b."""
    k1, k2, k3 = batch.permutation_keys(7)[turn]
    moved, other, side = ("l", "r", "a") if turn % 2 == 0 else ("r", "l", "b")
    digest = f"(CAST({other} AS BIGINT) * {k1} + {k2}) % {batch.PRIME}"
    source = f"round{turn - 1}" if turn else "pairs"
    return (
        f"round{turn} AS (SELECT i, a, b, {other}, ({moved} + (h * h + {k3}) % {batch.PRIME}) % {side} AS {moved} "
        f"FROM (SELECT *, {digest} AS h FROM {source}))"
    )


# The permutation of every number below a * b; those below n walk until they are below n again.
_ORDERED = f"""size AS (SELECT count(*) AS n, min(o_orderkey) AS low, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a
  FROM orders),
box AS (SELECT *, (n + a - 1) // a AS b FROM size),
pairs AS (SELECT i, a, b, i % a AS l, i // a AS r FROM box, unnest(range(a * b)) AS u(i)),
{", ".join(_round(turn) for turn in range(batch.ROUNDS))},
steps AS (SELECT i, r * a + l AS p FROM round{batch.ROUNDS - 1}),
walk AS (SELECT i, p, 0 AS k FROM steps, box WHERE i < n
  UNION ALL SELECT w.i, s.p, k + 1 FROM walk w JOIN steps s ON s.i = w.p, box WHERE w.p >= n),
ordered AS (SELECT p AS position, i + low AS source_index FROM walk, box WHERE p < n),
padded AS (SELECT *, false AS repeated FROM ordered UNION ALL
  SELECT position + 1, source_index, true FROM ordered, box WHERE position = n - 1 AND n % 7 <> 0)"""


def _recursive(cte: str) -> str:
    return with_(cte).replace("WITH ", "WITH RECURSIVE ", 1)


@query("j04_seeded_order", _recursive(_ORDERED) + "SELECT * FROM padded")
def _(t: Tables):
    ids = t.orders.select(F.col("o_orderkey").alias("source_index"))
    return batch.seeded_order(ids, "source_index", 7, 7)


@query(
    "j05_pair_assignment",
    _recursive(_ORDERED) + "SELECT *, position // 7 AS cursor, position % 7 AS rank FROM padded",
)
def _(t: Tables):
    ids = t.orders.select(F.col("o_orderkey").alias("source_index"))
    return batch.pair_assignment(batch.seeded_order(ids, "source_index", 7, 7), 7)


@query(
    "j07_sample_cap",
    with_(SAMPLES) + "SELECT source_index, sample_id, db_id FROM samples ORDER BY source_index LIMIT 500",
)
def _(t: Tables):
    rows = inputs.samples(t).select("source_index", "sample_id", "db_id")
    return batch.sample_cap(rows, 500, "source_index")
