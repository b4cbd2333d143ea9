"""K-d tree sharding by distributed weighted medians, in DataFrame operations only.

All cells of a level are cut at once: every cell takes its widest dimension, rows are range-sorted
by (cell, that dimension, digest of the text, doc_id) with a running total of bytes, and each cell
is cut where the total passes the share of its left half. The order is total, so values that many
rows share, and groups of copies, are cut where the bytes ask for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import with_position, with_running_total
from ..session import written


def dimension(df: DataFrame, name: str) -> Column:
    """A number in the order of the column: numbers as they are, of strings the first six bytes
    (rows that tie are told apart by the rest of the order). Null comes before all values."""
    column = F.col(f"`{name}`")
    if dict(df.dtypes)[name] == "string":
        head = F.hex(F.substring(column.cast("binary"), 1, 6))
        number = F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double")
    else:
        number = column.cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(-1.0))


def shard_documents(
    docs: DataFrame, dimensions: Sequence[str] = ("lang", "n_chars"), *, shards: int | None = None,
    target_bytes: int | None = None,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; law is ``bytes``.

    Leaves are ``shards``, or as many as bring them to ``target_bytes`` at most on average. Sizes
    are UTF-8 bytes plus 1, so null and empty texts weigh 1 (their checksum is 0). Sizes of leaves
    differ by about one document per cut. Copies that agree in the dimensions are neighbours and
    share a shard unless a cut falls into their group. Repeated rows are placed one by one.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64("text").alias("_digest"),
        F.array(*[dimension(docs, d) for d in dimensions]).alias("_point"),
        F.lit(0).alias("_first"),
    )
    rows = written(rows, "points")
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    span = [F.max(F.get("_point", F.lit(i))) - F.min(F.get("_point", F.lit(i))) for i in range(len(dimensions))]
    widths = F.array(*span)
    whole = rows.agg(widths.alias("w")).first()["w"] or [0.0] * len(dimensions)
    rows = rows.withColumn("_leaves", F.lit(shards))
    for _ in range((shards - 1).bit_length()):
        # A row per cell, so never more than ``shards`` rows.
        cells = rows.groupBy("_first").agg(widths.alias("_w"))
        relative = [F.get("_w", F.lit(i)) / F.lit(w or 1.0) for i, w in enumerate(whole)]
        widest = F.array_position(F.array(*relative), F.greatest(*relative, *relative)).cast("int")
        chosen = rows.join(F.broadcast(cells.select("_first", widest.alias("_axis"))), "_first")
        order = [F.col("_first"), F.element_at("_point", F.col("_axis")), F.col("_digest"), F.col("doc_id")]
        placed = with_running_total(chosen, order, F.col("size"), "_before")
        sums = placed.groupBy("_first").agg(
            F.min("_before").alias("_offset"), F.sum("size").alias("_total")
        )
        left = F.shiftright("_leaves", 1)
        middle = F.col("_before") - F.col("_offset") + F.col("size") / 2
        goes_left = (middle * F.col("_leaves") < F.col("_total") * left) | (F.col("_leaves") == 1)
        rows = placed.join(F.broadcast(sums), "_first").select(
            "doc_id", "size", "text_crc32", "_digest", "_point",
            F.when(goes_left, F.col("_first")).otherwise(F.col("_first") + left).alias("_first"),
            F.when(F.col("_leaves") == 1, 1)
            .otherwise(F.when(goes_left, left).otherwise(F.col("_leaves") - left)).alias("_leaves"),
        )
        rows = written(rows, "cells")
    numbered = with_position(
        rows.drop("_point", "_leaves"), F.col("_first"), F.col("_digest"), F.col("doc_id"), name="_place"
    )
    starts = numbered.groupBy("_first").agg(F.min("_place").alias("_start"))
    return numbered.join(F.broadcast(starts), "_first").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        F.col("_first").alias("shard"), (F.col("_place") - F.col("_start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
