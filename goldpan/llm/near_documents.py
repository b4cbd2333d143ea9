"""Near-duplicate documents: SimHash candidates by covering masks, verified by shingles.

The fingerprint is taken over pairs of words: single words would bring all texts of a language
together, longer shingles move too far with each edit. Of the pairs of test documents that share 0.8
of their five-word shingles, 73 of 100 differ in ``RADIUS`` bits at most, and covering masks miss none
of those. Texts also meet if they agree on one of ``BANDS`` MinHash keys of their five-word shingles,
which pairs of similarity 0.8 miss with a probability of 0.0002, more similar ones with less. Texts
that meet form clusters; a pair of a cluster is a link if the Jaccard similarity of its sets of
five-word shingles is 0.8 or more, whatever its fingerprints. Clusters are compared in tiles, as the
fuzzy lines are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .fuzzy_lines import clustered, compare_tiles, tiled
from .graph import components
from .package import ship
from .simhash import BITS, SEED, _signed, band_keys, fingerprint, links

RADIUS = 5
#: Words of a shingle of the fingerprint, and of one of the similarity.
PRINT_WORDS = 2
WORDS = 5
#: Similarity of 4/5 or more, in whole numbers.
SIMILAR = (4, 5)
#: MinHash keys of a text, and minima that each is made of.
BANDS, BAND_ROWS = 16, 4
#: Documents of a cluster that are compared in one tile with as many others, on average.
CHUNK = 500


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles (lower case; fewer words: the whole sequence)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.int64)
    count = max(1, len(parts) - words + 1)
    grams = map(b" ".join, zip(*(parts[i : i + count] for i in range(words)))) if len(parts) >= words else [b" ".join(parts)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64, count=count)
    return np.unique(hashes).view(np.int64)


def alike(a, b) -> bool:
    """Jaccard similarity of two sets of distinct hashes is 4/5 or more; two empty sets are alike."""
    few, many = sorted((len(a), len(b)))
    if SIMILAR[1] * few < SIMILAR[0] * many:
        return False
    both = len(np.intersect1d(np.asarray(a, np.int64), np.asarray(b, np.int64), assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [_signed(fingerprint(t, PRINT_WORDS)) for t in batch.column(2).to_pylist()]
        keys = [band_keys(shingles(t).view(np.uint64), BANDS, BAND_ROWS) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "digest", "print", "keys"],
        )


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [shingles(t) for t in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array(grams, pa.list_(pa.int64()))],
            ["cluster", "chunks", "digest", "print", "grams"],
        )


def key_links(texts: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the fingerprints of texts that agree on a MinHash key."""
    keys = texts.select("print", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("print").alias("a"), F.max("print").alias("_high")).where("a < _high")
    return keys.join(shared, "key").where("print <> a").select("a", F.col("print").alias("b"))


def near_documents(docs: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """doc_id and component_id of every row.

    ``component_id`` is the smallest doc_id among the documents that can be reached by links, the
    copies of a text included. A null text counts as an empty one; texts without words are all
    alike. A null doc_id never names a component; repeated rows are returned as often as they occur.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.md5(text)).alias("digest"), text.alias("text"))
    prints = written(keyed.mapInArrow(_print_rows, f"doc_id {kind}, digest binary, print long, keys array<long>"), "prints")
    # One row per text: copies meet here and are never compared with each other.
    texts = written(
        prints.groupBy("digest").agg(
            F.min("doc_id").alias("first"), F.first("print").alias("print"), F.first("keys").alias("keys")
        ),
        "texts",
    )
    classes = texts.groupBy("print").agg(F.count("*").alias("_rows"))
    near = links(classes, radius).unionAll(key_links(texts))
    active = clustered(texts.drop("keys"), classes, near, chunk).withColumnRenamed("digest", "_of")
    # Joined by text and id, so the copies of a text spread over tasks and one of them is read.
    one = (F.col("digest") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("first"))
    rows = (
        keyed.join(active, one)
        .select("cluster", "chunks", "digest", "print", "text")
        .mapInArrow(_shingle_rows, "cluster long, chunks long, digest binary, print long, grams array<long>")
    )
    rows = written(rows, "shingles").dropDuplicates(["digest"])
    edges = tiled(rows, "print", "grams").mapInArrow(compare_tiles(BITS, alike), "a binary, b binary")
    placed = texts.join(components(edges), texts["digest"] == F.col("node"), "left").select(
        "digest", "first", F.coalesce("root", "digest").alias("_root")
    )
    lowest = placed.groupBy("_root").agg(F.min("first").alias("component_id"))
    named = placed.join(lowest, "_root").select("digest", "component_id")
    return prints.join(named, "digest").select("doc_id", "component_id")
