"""Token files: concatenated ids with Elias-Fano document boundaries.

A set of token files is a Parquet folder of blocks in ascending doc_id order. A block is one binary
value, little-endian: a header, the ids of its documents one after the other (2 or 4 bytes each),
the Elias-Fano code of the documents' end offsets, and that of the documents' ids relative to the
first. No table of 64-bit offsets is kept. Blocks are small and self-contained; the ids before a
block are a running total over the parts and the blocks of a part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .eliasfano import EliasFano
from .package import ship
from .tokenizing import encoder

MAGIC = b"GPTK"
END = 2
#: A block is closed once it has so many ids; one document is never split.
BLOCK_IDS = 1 << 18
ROW_GROUP = 16 << 20
_HEAD = struct.Struct("<4sHHQQQq")
_SCHEMA = "part int, number int, n_docs long, n_ids long, block binary"


def pack(keys: list[int | None], bodies: list[bytes], kind: np.dtype) -> bytes:
    """A block of documents in ascending order, null keys first."""
    ends = np.cumsum([len(b) // kind.itemsize for b in bodies], dtype=np.int64)
    named = [k for k in keys if k is not None]
    first = named[0] if named else 0
    away = np.array([k - first for k in named], dtype=np.uint64)
    head = _HEAD.pack(
        MAGIC, 1, kind.itemsize, len(keys), int(ends[-1]) if len(ends) else 0, len(keys) - len(named), first
    )
    return b"".join(
        [head, *bodies, EliasFano.encode(ends).to_bytes(), EliasFano.encode(away).to_bytes()]
    )


class Block:
    """Random access to a packed block."""

    def __init__(self, raw: bytes) -> None:
        magic, version, width, self.n_docs, self.n_ids, self.nulls, self.first = _HEAD.unpack_from(raw)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token block")
        self.ids = np.frombuffer(raw, f"<u{width}", self.n_ids, _HEAD.size)
        rest = memoryview(raw)[_HEAD.size + width * self.n_ids :]
        self.ends, used = EliasFano.from_bytes(rest)
        self.away, _ = EliasFano.from_bytes(rest[used:])

    def document(self, i: int) -> np.ndarray:
        """ids of document ``i``, by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def keys(self) -> list[int | None]:
        return [None] * self.nulls + [self.first + int(v) for v in self.away.values()]


def _write_blocks(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        kind = tool.kind
        stop = np.array([end], kind).tobytes()
        part, number = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        bodies: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            row = [[part], [number], [len(keys)], [held], [pack(keys, bodies, kind)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, kinds)], ["part", "number", "n_docs", "n_ids", "block"]
            )

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = tool.encode(text.as_py()) + stop
                keys.append(key)
                bodies.append(body)
                held += len(body) // kind.itemsize
                if held >= BLOCK_IDS:
                    yield close()
                    keys, bodies, held, number = [], [], 0, number + 1
        if keys:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encode every whole text and write the blocks under ``path``.

    ``tokenizer`` is the file of a tokenizers vocabulary that every node has at that place. The
    order is ascending doc_id (cast to long), nulls first, then the digest of the text. Null and
    empty texts are the end id alone; repeated rows are documents of their own.
    """
    ship(docs.sparkSession)
    digest = F.xxhash64("text")
    placed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", digest.alias("_digest"))
    ordered = placed.repartitionByRange("doc_id", "_digest").sortWithinPartitions("doc_id", "_digest")
    blocks = ordered.select("doc_id", "text").mapInArrow(_write_blocks(tokenizer, end), _SCHEMA)
    blocks.write.option("parquet.block.size", ROW_GROUP).parquet(path)


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, number, raw in zip(*(batch.column(i) for i in range(3))):
            block = Block(raw.as_py())
            ends = block.ends.values().astype(np.int64)
            starts = np.r_[0, ends[:-1]]
            wide = block.ids.astype("<u4")
            sums = [zlib.crc32(wide[a:b]) for a, b in zip(starts, ends)]
            n = block.n_docs
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.as_py()] * n, pa.int32()), pa.array([number.as_py()] * n, pa.int32()),
                    pa.array(block.keys(), pa.int64()), pa.array(starts), pa.array(ends - starts),
                    pa.array(sums, pa.int64()),
                ],
                ["part", "number", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written blocks alone."""
    ship(spark)
    blocks = spark.read.schema(_SCHEMA).parquet(path)
    index = blocks.select("part", "number", "n_ids")
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("_ids"))  # one row per write task
    before = parts.select(
        "part", (F.sum("_ids").over(Window.orderBy("part")) - F.col("_ids")).alias("_before")
    )
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    offsets = index.withColumn("_inside", inside).join(before, "part").select(
        "part", "number", (F.col("_before") + F.col("_inside")).alias("_offset")
    )
    rows = blocks.select("part", "number", "block").mapInArrow(
        _read_blocks, "part int, number int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    return rows.join(offsets, ["part", "number"]).select(
        "doc_id", (F.col("_offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Write the token files to the shared folder and describe what is read back from them."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end)
    return read_tokens(docs.sparkSession, path)
