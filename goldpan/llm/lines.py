"""Lines as units: cutting, normalising, digests, and putting documents together again."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

UNITS = {
    "line": re.compile(r"\n"),
    "paragraph": re.compile(r"\n[ \t\r]*\n\s*"),
    # Lines, cut further after the end of a sentence.
    "sentence": re.compile(r"\n|(?<=[.!?])[ \t]+"),
}
#: What stands between kept units; sentences keep what stood behind them.
_MARKS = {"line": "\n", "paragraph": "\n\n"}


def cut(text: str | None, unit: str) -> list[tuple[int, int]]:
    """Start and end (code points) of each unit of the whole text, separators left out."""
    spans, at = [], 0
    if unit == "line":
        for line in (text or "").split("\n"):
            spans.append((at, at + len(line)))
            at += len(line) + 1
        return spans
    for mark in UNITS[unit].finditer(text or ""):
        spans.append((at, mark.start()))
        at = mark.end()
    spans.append((at, len(text or "")))
    return spans


def rejoin(text: str, spans: list[tuple[int, int]], removed: set[int], unit: str) -> str:
    """The text without the removed units."""
    if not removed:
        return text
    stay = [p for p in range(len(spans)) if p not in removed]
    if unit in _MARKS:
        return _MARKS[unit].join(text[spans[p][0] : spans[p][1]] for p in stay)
    behind = [start for start, _ in spans[1:]] + [len(text)]
    return "".join(text[spans[p][0] : spans[p][1] if p == stay[-1] else behind[p]] for p in stay)


def normalise(unit: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(unit.lower().split())


def document_key(docs: DataFrame):
    """Digest of a document row; rows with equal doc_id and text are one document."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("."), F.col("text"))))


def _unit_rows(unit: str, prepare: Callable[[str], str], extra: Callable[[str], int] | None, whole: Callable[[str], list[str]] | None = None, size: Callable[[str], int] | None = None):
    def prepared(text: str | None) -> list[str]:
        return [prepare(text[start:end]) if text else "" for start, end in cut(text, unit)]

    prepared, told = whole or prepared, extra or size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, places, digests, values = [], [], [], [], []
            for key, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for place, clean in enumerate(prepared(text)):
                    if clean:
                        keys.append(key)
                        ids.append(doc_id)
                        places.append(place)
                        digests.append(xxhash.xxh3_128_digest(clean.encode("utf-8", "surrogatepass")))
                        values.append(told(clean) if told else 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.binary()), pa.array(ids, batch.schema.field(1).type),
                    pa.array(places, pa.int32()), pa.array(digests, pa.binary()), pa.array(values, pa.int64()),
                ],
                ["key", "doc_id", "place", "digest", "value"],
            )

    return run


def unit_table(docs: DataFrame, unit: str, prepare=normalise, extra=None, whole=None, size=None) -> DataFrame:
    """(key, doc_id, place, digest, value): the units of all documents that are not blank, without
    their text. Written, since several passes read it. ``whole`` prepares all units of a text at once;
    ``value`` is ``extra`` of a unit, or else its ``size``."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.where(F.col("text").isNotNull()).select(document_key(docs).alias("key"), "doc_id", "text")
    return written(
        rows.mapInArrow(
            _unit_rows(unit, prepare, extra, whole, size),
            f"key binary, doc_id {kind}, place int, digest binary, value long",
        ),
        "units",
    )


def earliest():
    """Rank of an occurrence as one value: doc_id (nulls last), document, place."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("place").alias("p")))


def later_occurrences(units: DataFrame, kept: DataFrame) -> DataFrame:
    """(key, places): in every document the units that ``kept`` (digest, keeper) has elsewhere.

    The table of units is on the large side of the join, which Spark can split at a digest that
    many rows share; the other side has one row per repeated digest.
    """
    own = (F.col("key") == F.col("keeper.k")) & (F.col("place") == F.col("keeper.p"))
    return (
        units.select("key", "place", "digest").join(kept, "digest").where(~own)
        # A set, since repeated rows of one document bring their places again.
        .groupBy("key").agg(F.collect_set("place").alias("places"))
    )


OUTPUT = "array<struct<start:int,end:int>>"


def _span_lists(rows: list[list[tuple[int, int]]]) -> pa.Array:
    flat = np.array([s for row in rows for s in row], np.int32).reshape(-1, 2)
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    spans = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(ends), spans)


def _assemble_rows(unit: str, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, kept, texts = [], [], [], []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = cut(text, unit) if text else []
                repeated = set(places or ())
                removed: set[int] = set()
                run_places: list[int] = []
                words = 0
                n_units = 0
                # Runs of repeated units; blank ones neither end nor lengthen a run.
                for place, (start, end) in enumerate([*spans, (0, 0)]):
                    last = place == len(spans)
                    blank = not last and not text[start:end].strip()
                    n_units += not last and not blank
                    if place in repeated:
                        run_places.append(place)
                        words += len(text[start:end].split())
                    elif last or not blank:
                        if words >= least_words:
                            removed.update(run_places)
                        run_places, words = [], 0
                stay = [s for p, s in enumerate(spans) if p not in removed]  # blank units too
                counts.append(n_units)
                gone.append([spans[p] for p in sorted(removed)])
                kept.append(stay)
                texts.append(rejoin(text, spans, removed, unit))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(counts, pa.int32()), _span_lists(gone),
                    _span_lists(kept), pa.array(texts, pa.string()),
                ],
                ["doc_id", "n_units", "removed", "kept", "text"],
            )

    return run


def assemble(docs: DataFrame, later: DataFrame, unit: str, least_words: int) -> DataFrame:
    """doc_id, n_units, n_removed, removed, kept (spans of the original text in code points), text."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = (
        docs.select("doc_id", "text", document_key(docs).alias("key"))
        .join(later, "key", "left").select("doc_id", "text", "places")
    )
    return rows.mapInArrow(
        _assemble_rows(unit, least_words),
        f"doc_id {kind}, n_units int, removed {OUTPUT}, kept {OUTPUT}, text string",
    ).select("doc_id", "n_units", F.size("removed").alias("n_removed"), "removed", "kept", "text")
