"""SimHash near-duplicates by covering locality-sensitive hashing.

Bits of the fingerprint are dealt to the non-zero vectors of GF(2)^(radius+1). Each non-zero
vector v keeps the bits whose own vector has an odd product with v. Any ``radius`` differing bits
span less than the whole space, so some v is orthogonal to all of them and keeps none of them: two
fingerprints within the radius agree on at least one of the 2^(radius+1) - 1 kept parts. No pair
within the radius is missed.

A bucket (fingerprints that agree on a kept part) is reduced to a spanning forest of its exact
links. A bucket of more than ``BUCKET`` fingerprints is dealt again by a covering family over the
bits it leaves free; the second bucket has only the bits free in both, 12 for radius 2, so it holds
4,096 distinct fingerprints at most whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .graph import components
from .package import ship

BITS = 64
SEED = 42
#: Distinct fingerprints of a bucket that are compared at once.
BUCKET = 2048
#: Shingles whose bits are unpacked at once (64 bytes each).
STEP = 255 * 256
_POWERS = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned fingerprint: a bit is 1 if set in over half of the XXH64 of the word shingles.

    A-Z are lower-cased, words are runs without ASCII white space, repeats count. With fewer words
    than a shingle the whole sequence is one; without words the fingerprint is zero.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    count = len(parts) - words + 1
    shingles = map(b" ".join, zip(*(parts[i : i + count] for i in range(words))))
    hashes = np.fromiter(
        map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=count
    )
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, count, STEP):
        bits = np.unpackbits(
            hashes[start : start + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        )
        whole = len(bits) // 255 * 255
        # Sums of 255 rows fit one byte, which keeps the inner loop on bytes.
        ones += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(_POWERS[2 * ones > count].sum())


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """The kept bits of each table, as unsigned masks."""
    size = (1 << (radius + 1)) - 1
    owner = {bit: 1 + i % size for i, bit in enumerate(bits)}
    return [
        sum(1 << bit for bit, own in owner.items() if (own & v).bit_count() % 2)
        for v in range(1, size + 1)
    ]


_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, 256), np.uint64) << np.uint64(1) | np.uint64(1)


def band_keys(hashes: np.ndarray, bands: int, rows: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Signed MinHash keys of a set of 64-bit hashes: sets of Jaccard similarity s agree on a key
    with probability s^rows, and on any of them with 1 - (1 - s^rows)^bands. With ``starts`` the
    hashes are those of many sets, none of them empty, and each set has a row of keys."""
    if starts is not None:
        lows = np.stack([np.minimum.reduceat(hashes * odd, starts) for odd in _ODD[0, : bands * rows]])
        lows ^= lows >> np.uint64(29)
        lows *= _ODD[1, : bands * rows, None]
        return lows.reshape(bands, rows, -1).sum(axis=1, dtype=np.uint64).T.view(np.int64)
    low = np.full(bands * rows, ~np.uint64(0))
    for start in range(0, len(hashes), STEP // 8):
        part = hashes[start : start + STEP // 8, None] * _ODD[0, : bands * rows]
        low = np.minimum(low, part.min(axis=0))
    low ^= low >> np.uint64(29)
    return (low * _ODD[1, : bands * rows]).reshape(bands, rows).sum(axis=1, dtype=np.uint64).view(np.int64)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """Spanning forest of the links among distinct unsigned fingerprints: (end, other ends)."""
    left, found = prints, []
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            one = stack.pop()
            near = np.bitwise_count(left ^ one) <= radius
            if near.any():
                found.append((one, left[near]))
                stack.extend(left[near])
                left = left[~near]
    return found


def _link(radius: int, limit: int | None):
    """Rows (part, kept, print) sorted by (part, kept) -> forest edges (a, b), or, of buckets over
    the limit, the rows themselves (part, kept, a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]
        over = None  # the bucket at the end of the rows so far, if it is over the limit

        def step(rows, last: bool):
            nonlocal held, over
            part, kept, prints = rows
            if not len(part):
                return
            change = np.flatnonzero((part[1:] != part[:-1]) | (kept[1:] != kept[:-1])) + 1
            starts, ends = np.r_[0, change], np.r_[change, len(part)]
            sizes = ends - starts
            large = np.zeros(len(starts), bool) if limit is None else sizes > limit
            large[0] |= over == (part[0], kept[0])
            over = (part[-1], kept[-1]) if large[-1] else None
            ready = ~large
            ready[-1] &= last
            held = [x[len(part) if ready[-1] or large[-1] else starts[-1] :] for x in rows]
            unsigned = prints.view(np.uint64)
            at = starts[ready & (sizes == 2)]
            near = np.bitwise_count(unsigned[at] ^ unsigned[at + 1]) <= radius
            a, b = [unsigned[at][near]], [unsigned[at + 1][near]]
            for i in np.flatnonzero(ready & (sizes > 2)):
                for one, others in forest(unsigned[starts[i] : ends[i]], radius):
                    a.append(np.full(len(others), one, np.uint64))
                    b.append(others)
            yield _rows(a=np.concatenate(a).view(np.int64), b=np.concatenate(b).view(np.int64))
            whole = np.repeat(large, sizes)
            yield _rows(part=part[whole], kept=kept[whole], a=prints[whole])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            yield from step([np.concatenate(x) for x in zip(held, new)], last=False)
        yield from step(held, last=True)

    return run


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns["a"])
    kinds = {"part": pa.int32(), "kept": pa.int64(), "a": pa.int64(), "b": pa.int64()}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()],
        list(kinds),
    )


def _dealt(rows: DataFrame, masks: Column, first: Column) -> DataFrame:
    """Rows per (table, kept bits), buckets together; tables are numbered from ``first`` on."""
    return (
        rows.select("print", first.alias("_first"), F.posexplode(masks))
        .select(
            (F.col("_first") + F.col("pos")).cast("int").alias("part"),
            F.col("print").bitwiseAND(F.col("col")).alias("kept"), "print",
        )
        .repartition("part", "kept")
        .sortWithinPartitions("part", "kept")
    )


def masked_links(
    prints: DataFrame, radius: int, masks: list[int], again: Callable[[list[int]], list[int]],
    bucket: int = BUCKET,
) -> DataFrame:
    """Edges (a, b) with the same components as "at most ``radius`` differing bits".

    ``prints`` has one distinct, non-null long column ``print``. ``masks`` are the kept bits of the
    tables, ``again`` gives those for the bits that a table leaves free; both must let every pair
    within the radius meet.
    """
    ship(prints.sparkSession)
    schema = "part int, kept long, a long, b long"

    first = _dealt(prints.select("print"), F.lit([_signed(m) for m in masks]), F.lit(0))
    found = written(first.mapInArrow(_link(radius, bucket), schema), "links")
    # Buckets over the limit: dealt again over the bits that they leave free.
    fine = [
        [_signed(mask | m) for m in again([bit for bit in range(BITS) if not mask >> bit & 1])]
        for mask in masks
    ]
    width = max(map(len, fine))
    large = found.where(F.col("part").isNotNull()).select("part", F.col("a").alias("print"))
    second = _dealt(
        large, F.element_at(F.lit(fine), F.col("part") + 1), F.col("part") * width
    ).mapInArrow(_link(radius, None), schema)
    return found.where(F.col("part").isNull()).select("a", "b").unionAll(second.select("a", "b"))


def links(prints: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``masked_links`` with covering masks, at both levels."""
    masks = covering_masks(list(range(BITS)), radius)
    return masked_links(prints, radius, masks, lambda free: covering_masks(free, radius), bucket)


def _print_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))],
                ["doc_id", "print"],
            )

    return run


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row.

    ``component_id`` is the smallest doc_id whose fingerprint can be reached by steps of at most
    ``radius`` bits. A null text has no words, so its fingerprint is zero like that of an empty
    one. Repeated rows are returned as often as they occur. A null doc_id never names a component
    and is returned with the component of its fingerprint (null if no other id is in it).
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    prints = written(
        docs.select("doc_id", "text").mapInArrow(_print_batches(words), f"doc_id {kind}, print long"),
        "prints",
    )
    # One row per fingerprint: copies meet here and are never compared with each other.
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("_first"))
    roots = components(links(classes, radius))
    placed = classes.join(roots, classes["print"] == roots["node"], "left").select(
        "print", "_first", F.coalesce("root", "print").alias("_root")
    )
    lowest = placed.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = placed.join(lowest, "_root").select("print", "component_id")
    return prints.join(named, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest doc_id.

    ``found`` has doc_id and component_id of all rows. All columns are kept. If several rows share
    that doc_id, the first by the hash of all columns stays. Rows with a null doc_id cannot be told
    apart by id; they stay.
    """
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull())
    order = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    same = Window.partitionBy("doc_id").orderBy(order)
    stay = (
        named.join(kept, "doc_id", "left_semi")
        .withColumn("_goldpan_row", F.row_number().over(same))
        .where("_goldpan_row = 1").drop("_goldpan_row")
    )
    return stay.unionAll(docs.where(F.col("doc_id").isNull()))
