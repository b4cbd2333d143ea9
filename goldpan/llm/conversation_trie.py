"""Prefix trie of conversations by depth bands.

A node is a sequence of turns that at least one conversation starts with. A conversation is cut into
bands of ``BAND`` turns, bands into bands of bands, and so on, so that no row ever holds more than
``BAND`` turns or blocks, whatever a conversation's length. The keys of a level start from the
completed keys of the level above it.

Totals of subtrees go the same way. Nodes are first summed per band root. These totals belong to the
band roots, which form a tree a band's height shallower, and are rolled up there by the same step.
The completed total of a band root is then added to the node itself, and every node explodes only to
its ancestors inside its band. Rounds grow with the logarithm of the depth to the base ``BAND``, and
a node is repeated at most ``BAND`` times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import top_per_group, with_position
from ..session import cut
from .package import ship

BAND = 8
KEY_BYTES = 16
#: Neighbouring conv_ids that are written out together (fewer than twice as many around 0).
PART = 4096
NOTHING = hashlib.sha256().hexdigest()


def _key(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, KEY_BYTES)


def _root() -> Column:
    return F.lit(bytes(KEY_BYTES))


# --- conversations to rows (conv_id, pos, digest, bytes) ----------------------------------------


def ordered_turns(table: DataFrame) -> DataFrame:
    """conv_id, place, digest, bytes: turns in order of conversation, turn (null first) and digest.

    ``place`` counts on over all conversations. Null roles and texts are empty; rows without conv_id
    belong to no conversation; equal turn numbers are ordered by the digest of role and text, so
    repeated rows stay turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    size = F.char_length(role).cast("string")
    turns = table.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        _key(size.cast("binary"), F.lit(b":"), role.cast("binary"), text.cast("binary")).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    placed = with_position(turns, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), name="place")
    return placed.drop("turn")


def rebuilt_turns(turns: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows): each conversation c takes its first h turns from the first one of its
    family, c - c % family, and the turns after its own first h. h is crc32(decimal c) % (most + 1).

    ``conversations`` has conv_id, every one once, those left without turns too; ``rows`` has
    conv_id, pos (from 0), digest and bytes.
    """
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.min("place").alias("first"))
    sizes = sizes.withColumn("h", (F.crc32(c.cast("string").cast("binary")) % (most + 1)).cast("int"))
    heads = top_per_group(turns.where(c % family == 0), ["conv_id"], [F.col("place")], most)
    heads = heads.groupBy(c.alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("place", "digest", "bytes"))).alias("head")
    )
    convs = cut(
        sizes.withColumn("base", c - c % family).join(heads, "base", "left").select(
            "conv_id", "first", "h", F.slice("head", F.lit(1), F.col("h")).alias("head")
        )
    )
    taken = convs.select("conv_id", F.posexplode("head").alias("pos", "turn")).select(
        "conv_id", F.col("pos").cast("bigint").alias("pos"), "turn.digest", "turn.bytes"
    )
    # A conversation of very many turns makes one side of this join skewed, which Spark splits.
    scalars = convs.select("conv_id", "first", "h", F.coalesce(F.array_size("head"), F.lit(0)).alias("kept"))
    own = turns.join(scalars, "conv_id").withColumn("at", F.col("place") - F.col("first"))
    own = own.where(F.col("at") >= F.col("h")).select(
        "conv_id", (F.col("at") - F.col("h") + F.col("kept")).alias("pos"), "digest", "bytes"
    )
    return convs.select("conv_id"), taken.unionByName(own)


# --- keys ---------------------------------------------------------------------------------------


def _bands(items: DataFrame, band: int) -> DataFrame:
    """conv_id, block, items: at most ``band`` neighbours per row, in order."""
    extra = [c for c in items.columns if c not in ("conv_id", "pos")]
    return items.groupBy("conv_id", F.expr(f"pos div {band}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", *extra))).alias("items")
    )


def keyed_levels(items: DataFrame, band: int) -> list[DataFrame]:
    """Band rows of each level, the turns' first: conv_id, block, items, whole, keys.

    ``keys`` has the key before the first item and that after each item; it is the same for equal
    sequences of turns. The last key of a whole band is the key its block has one level up.
    """
    rows = cut(_bands(items, band).withColumn(
        "whole", (F.size("items") == band) & F.forall("items", lambda x: x["whole"])
    ))
    upper: list[DataFrame] = []
    top = rows.agg(F.max("block")).first()[0]
    if top:
        digest = F.aggregate("items", F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
        blocks = rows.select("conv_id", F.col("block").alias("pos"), _key(digest).alias("digest"), "whole")
        upper = keyed_levels(blocks, band)
        given = upper[0].select("conv_id", F.posexplode("items").alias("i", "item"), "keys").select(
            "conv_id", F.col("item.pos").alias("block"),
            F.element_at("keys", F.col("i") + 1).alias("start"), F.element_at("keys", F.col("i") + 2).alias("end"),
        )
        rows = rows.join(given, ["conv_id", "block"])
    else:
        rows = rows.withColumn("start", _root()).withColumn("end", F.lit(None).cast("binary"))
    chain = F.aggregate(
        "items", F.array("start"),
        lambda keys, x: F.concat(keys, F.array(_key(F.element_at(keys, -1), x["digest"]))),
    )
    joined = F.when(
        F.col("whole") & F.col("end").isNotNull(), F.concat(F.slice(chain, 1, band), F.array("end"))
    ).otherwise(chain)
    return [cut(rows.select("conv_id", "block", "items", "whole", joined.alias("keys"))), *upper]


def _prefixes(rows: DataFrame) -> DataFrame:
    """One row per item: key, parent, start (its band root), path (its ancestors below that)."""
    at = F.col("i")
    return rows.select("conv_id", F.posexplode("items").alias("i", "item"), "keys").select(
        "conv_id", "item",
        F.element_at("keys", at + 2).alias("key"), F.element_at("keys", at + 1).alias("parent"),
        F.element_at("keys", F.lit(1)).alias("start"), F.slice("keys", F.lit(2), at).alias("path"),
    )


# --- totals -------------------------------------------------------------------------------------


def rolled_up(levels: list[DataFrame], nodes: DataFrame, values: list[str]) -> DataFrame:
    """key and the sums of ``values`` over each node's subtree, the node included.

    ``nodes``: key, start, path and values of the first of ``levels``; the others give the band
    roots one level up, two levels up and so on.
    """
    if len(levels) > 1:
        below = nodes.groupBy(F.col("start").alias("key")).agg(*[F.sum(v).alias(v) for v in values])
        roots = _prefixes(levels[1]).where("item.whole").groupBy("key", "start", "path").agg(F.lit(1).alias("one"))
        roots = roots.drop("one").join(below, "key", "left").fillna(0, values)
        whole = rolled_up(levels[1:], roots, values)
        whole = whole.select("key", *[F.col(v).alias(f"under_{v}") for v in values])
        nodes = nodes.join(whole, "key", "left").select(
            "key", "path", *[(F.col(v) + F.coalesce(f"under_{v}", F.lit(0))).alias(v) for v in values]
        )
    up = nodes.select(F.explode(F.concat("path", F.array("key"))).alias("key"), *values)
    return up.groupBy("key").agg(*[F.sum(v).alias(v) for v in values])


# --- ends ---------------------------------------------------------------------------------------


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, part, ids) rows to one digest per key, holding one batch and one state."""
    key, state, found = None, None, ([], [])
    for batch in batches:
        for this, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if this != key:
                if state is not None:
                    found[0].append(key)
                    found[1].append(state.hexdigest())
                key, state = this, hashlib.sha256(ids.encode())
            else:
                state.update(f",{ids}".encode())
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1])], ["key", "ends_sha256"])
            found = ([], [])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of the conv_ids of each key, ascending and comma-joined.

    Neighbouring ids are written out in parts of at most ``PART`` first. The digest is sequential by
    its definition, so the parts of a key are streamed through one task; they are never held.
    """
    ship(ends.sparkSession)
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string"))
    parts = ends.groupBy("key", F.expr(f"conv_id div {PART}").alias("part")).agg(F.array_join(ids, ",").alias("ids"))
    rows = parts.repartition("key").sortWithinPartitions("key", "part")
    return rows.mapInArrow(_hash_ids, "key binary, ends_sha256 string")


# --- the trie -----------------------------------------------------------------------------------


def trie(table: DataFrame, family: int = 5, most: int = 8, band: int = BAND) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.

    ``table`` has conv_id, turn, role and text; other columns are not read. Rows without conv_id are
    left out; null roles and texts are empty; an empty table has no node, not even the root.
    saved_tokens counts the UTF-8 bytes of a node's last text once for each member but one.
    """
    convs, rows = rebuilt_turns(ordered_turns(table), family, most)
    levels = keyed_levels(rows.withColumn("whole", F.lit(True)), band)
    top = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("id")).first()

    last = levels[0].groupBy("conv_id").agg(
        F.max(F.struct("block", F.element_at("keys", -1).alias("key"))).alias("last")
    )
    ends = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("last.key", _root()).alias("key"))

    found = _prefixes(levels[0]).withColumn("depth", F.col("item.pos") + 1).withColumn("bytes", F.col("item.bytes"))
    nodes = cut(
        found.groupBy("key", "parent", "start", "path", "depth", "bytes").agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")
        )
    )
    children = cut(nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children")))
    nodes = nodes.join(children, "key", "left").fillna(0, ["n_children"])
    valued = nodes.select(
        "key", "start", "path",
        (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    totals = cut(rolled_up(levels, valued, ["n_leaves", "saved_tokens"]))

    # The root is one row: sums of sums, and every first turn's parent.
    whole = valued.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    under = children.where(F.col("key") == _root()).agg(F.sum("n_children").alias("n_children"))
    leaves, saved = whole.first()
    spark, count, smallest = table.sparkSession, top["n"], top["id"]
    root = spark.range(1 if count else 0).select(
        _root().alias("key"), F.lit(smallest).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("depth"),
        F.lit(None).cast("bigint").alias("parent_conv_id"), F.lit(count).cast("bigint").alias("n_convs"),
        F.lit(under.first()[0] or 0).cast("bigint").alias("n_children"),
        F.lit(1 if leaves is None else leaves).cast("bigint").alias("n_leaves"),
        F.lit(saved or 0).cast("bigint").alias("saved_tokens"),
    )
    names = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    first = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(smallest).cast("bigint"))
    deeper = nodes.where("depth > 1").join(names, "parent")
    rest = first.unionByName(deeper).drop("parent", "start", "path", "bytes").join(totals, "key")
    return root.unionByName(rest).join(end_digests(ends), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )

