"""SentencePiece encoding that keeps offsets.

A text is normalised by the longest prefix that the model's compiled character map holds; each
normalised byte records the source byte it comes from. Pieces are merged on the normalised text
and projected through that record, so every piece has a span of source bytes. Spans follow each
other without gaps; white space that the normalisation drops belongs to no piece.

The normalised text is cut before a space mark that follows another character, since no piece holds
such a mark inside; the merges of one cut are kept in a cache and come from the library.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .package import ship

MARK = "▁"
_MARK = MARK.encode()
#: Cuts kept per worker (about 250 bytes each); when full the cache starts anew.
CACHE = 500_000
LONGEST = 64
#: Texts of so many characters are encoded, and ids of so many bytes decoded, at once.
TEXT_BYTES = 1 << 20


# --- the model file ---------------------------------------------------------------------------


def _number(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, its bytes with the key) of each field of a protobuf message."""
    at = 0
    while at < len(raw):
        start = at
        key, at = _number(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _number(raw, at)
        else:
            size = 8 if kind == 1 else 4
            if kind == 2:
                size, at = _number(raw, at)
            value = raw[at : at + size]
            at += size
        yield key >> 3, value, raw[start:at]


def _field(number: int, value: int | bytes) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


# Fixed numbers of the public model format: fields of the model, of a piece and of the
# normaliser's description; kinds of pieces.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_KIND = 1, 3
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
NAME, CHARSMAP, DUMMY_PREFIX, TRIM_SPACES, MARK_SPACES = 1, 2, 3, 4, 5
SPACE_AS_SUFFIX = 24


def with_normalizer(model: bytes, spec: bytes) -> bytes:
    """The model with another description of its normaliser."""
    kept = b"".join(whole for number, _, whole in fields(model) if number != NORMALIZER)
    return kept + _field(NORMALIZER, spec)


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """All entries of a compiled character map: a double-array trie over source bytes whose values
    point into a block of null-terminated replacements."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
    block = blob[4 + size :]
    jump = (units >> 10) << ((units & 512) >> 6)
    label = units & 0x800000FF
    found: dict[bytes, bytes] = {}
    stack = [(int(jump[0]), b"")]
    every = np.arange(1, 256)
    while stack:
        base, prefix = stack.pop()
        at = base ^ every
        inside = at < len(units)
        good = every[inside][label[at[inside]] == every[inside]]
        for byte in good.tolist():
            unit = base ^ byte
            key = prefix + bytes([byte])
            below = unit ^ int(jump[unit])
            if units[unit] >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                found[key] = block[start : block.index(b"\0", start)]
            stack.append((below, key))
    return found


# --- normalisation ----------------------------------------------------------------------------


class Normalizer:
    """Normalised text and, for each of its bytes and its end, the source byte."""

    def __init__(self, spec: bytes, kept_whole: list[str], suffix: bool) -> None:
        said = {number: value for number, value, _ in fields(spec)}
        entries = character_map(said.get(CHARSMAP, b""))
        self.entries = {k.decode(): v.decode() for k, v in entries.items()}
        self.entries |= {text: text for text in kept_whole}  # user pieces stay as they are
        self.longest = max(map(len, self.entries), default=0)
        firsts = {k[0] for k, v in self.entries.items()}
        self.first = re.compile("[" + "".join(map(re.escape, sorted(firsts))) + "]") if firsts else None
        self.dummy = bool(said.get(DUMMY_PREFIX, 1)) and not suffix
        self.trim = bool(said.get(TRIM_SPACES, 1))
        self.marks = bool(said.get(MARK_SPACES, 1))
        if suffix:
            raise ValueError("models that mark spaces after words are not supported")

    def _mapped(self, text: str) -> tuple[bytes, np.ndarray | None]:
        """Longest entries replaced; None if nothing was."""
        if self.first is None:
            return text.encode(), None
        parts: list[bytes] = []
        origins: list[np.ndarray] = []
        done = source = 0  # characters and bytes of the source that are behind

        def plain(upto: int) -> None:
            nonlocal done, source
            if upto > done:
                raw = text[done:upto].encode()
                parts.append(raw)
                origins.append(source + _starts(raw))
                done, source = upto, source + len(raw)

        match = self.first.search(text)
        while match:
            at = match.start()
            size = next(
                (n for n in range(min(self.longest, len(text) - at), 0, -1) if text[at : at + n] in self.entries), 0
            )
            if size:
                plain(at)
                out = self.entries[text[at : at + size]].encode()
                parts.append(out)
                origins.append(np.full(len(out), source))
                source += len(text[at : at + size].encode())
                done = at + size
            match = self.first.search(text, at + max(size, 1))
        if not parts:
            return text.encode(), None
        plain(len(text))
        return b"".join(parts), np.concatenate([*origins, [source]])

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        if not text:
            return "", np.zeros(1, np.int64)
        raw, origin = self._mapped(text)
        if origin is None:
            origin = np.append(_starts(raw), len(raw))
        data = np.frombuffer(raw, np.uint8)
        if self.trim:
            space = data == 32
            kept = ~(space & np.r_[True, space[:-1]])
            data, origin = data[kept], np.append(origin[:-1][kept], origin[-1])
            if not len(data):
                return "", np.zeros(1, np.int64)
        if not self.marks:
            head = b" " if self.dummy else b""
            out, widths = head + data.tobytes(), np.ones(len(data), np.int64)
        else:
            head = _MARK if self.dummy else b""
            out = head + data.tobytes().replace(b" ", _MARK)
            widths = np.where(data == 32, len(_MARK), 1)
        origin = np.concatenate([np.full(len(head), origin[0]), np.repeat(origin[:-1], widths), origin[-1:]])
        if self.trim:
            tail = _MARK if self.marks else b" "
            while out.endswith(tail):
                out = out[: -len(tail)]
                origin = origin[: len(out) + 1]
        return out.decode(), origin


def _starts(raw: bytes) -> np.ndarray:
    """For each byte the first byte of its character."""
    data = np.frombuffer(raw, np.uint8)
    at = np.arange(len(data))
    return np.maximum.accumulate(np.where(data & 0xC0 != 0x80, at, 0)) if len(at) else at


# --- pieces -----------------------------------------------------------------------------------


class Encoder:
    """ids of whole texts, equal to the library's ``encode``, and their source spans."""

    def __init__(self, model: bytes) -> None:
        pieces, spec, suffix = [], b"", False
        for number, value, _ in fields(model):
            if number == PIECE:
                said = {n: v for n, v, _ in fields(value)}
                pieces.append((said[PIECE_TEXT].decode(), said.get(PIECE_KIND, NORMAL)))
            elif number == TRAINER:
                suffix = any(n == SPACE_AS_SUFFIX and v for n, v, _ in fields(value))
            elif number == NORMALIZER:
                spec = value
        self.normalize = Normalizer(spec, [t for t, kind in pieces if kind == USER_DEFINED], suffix)
        as_it_is = b"".join(_field(n, 0) for n in (DUMMY_PREFIX, TRIM_SPACES, MARK_SPACES))
        self.merges = sentencepiece.SentencePieceProcessor(
            model_proto=with_normalizer(model, _field(NAME, b"identity") + as_it_is)
        )
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        # Bytes of the normalised text that a piece covers; without byte pieces an unknown one has
        # no fixed width.
        self.width = np.array([1 if kind == BYTE else len(t.encode()) for t, kind in pieces], np.int64)
        if not any(kind == BYTE for _, kind in pieces):
            raise ValueError("models without byte pieces are not supported")
        #: Whether every piece has its space marks in front only.
        self.cuts = all(MARK not in text.lstrip(MARK) for text, _ in pieces)
        self._split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, bytes] = {}

    def _learn(self, cuts: set[str]) -> None:
        """Merge the cuts that are not known in one call of the library."""
        new = [c for c in cuts if c not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(cuts)
        for cut, ids in zip(new, self.merges.encode(new, num_threads=1) if new else []):
            self.known[cut] = array("i", ids).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, first source byte, source byte behind) of the pieces of each text; none for null or
        empty. Called for a few texts at a time."""
        normal = [self.normalize(text or "") for text in texts]
        cuts = [self._split.findall(t) if self.cuts else [t] * bool(t) for t, _ in normal]
        distinct = set(chain.from_iterable(cuts))
        self._learn(distinct)
        out = []
        for parts, (_, origin) in zip(cuts, normal):
            ids = np.frombuffer(b"".join(map(self.known.__getitem__, parts)), np.int32)
            edges = np.r_[0, np.cumsum(self.width[ids])]
            if edges[-1] != len(origin) - 1:
                raise ValueError("pieces do not cover the normalised text")
            at = origin[edges].astype(np.int32)
            out.append((ids, at[:-1], at[1:]))
        for cut in distinct:
            if len(cut) > LONGEST:
                del self.known[cut]
        return out

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_all([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and path."""
    if path not in _ENCODERS:
        with open(path, "rb") as file:
            _ENCODERS[path] = Encoder(file.read())
    return _ENCODERS[path]


# --- frames -----------------------------------------------------------------------------------

ADDED = ("ids", "starts", "ends")


def _free(df: DataFrame, *names: str) -> DataFrame:
    """Without columns that the results replace, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def _grouped(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str | None]]]:
    """(first, texts) of neighbours that hold ``most`` characters or one text."""
    first, held, some = 0, 0, []
    for i, text in enumerate(texts):
        some.append(text.as_py())
        held += len(some[-1] or "")
        if held >= most:
            yield first, some
            first, held, some = i + 1, 0, []
    if some:
        yield first, some


def _encode_rows(path: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            texts, names = batch.column(at), [*batch.schema.names, *ADDED]

            def close(first: int, upto: int, found: list) -> pa.RecordBatch:
                lists = []
                for which in zip(*found):
                    ends = np.cumsum([0, *map(len, which)], dtype=np.int32)
                    values = pa.array(np.concatenate(which))
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), values))
                rows = batch.slice(first, upto - first)
                return pa.RecordBatch.from_arrays([*rows.columns, *lists], names)

            for first, some in _grouped(texts, TEXT_BYTES):
                yield close(first, first + len(some), tool.encode_all(some))

    return run


def encode_texts(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ids, starts and ends (arrays of int): the pieces of every whole text and the
    source bytes they span, without begin and end ids.

    ``model`` is a SentencePiece file with byte pieces that every node has at that place. A null or
    empty text has no pieces; repeated rows stay; columns of ``docs`` called ids, starts or ends
    give way; an empty table gives an empty one. A text over 2 GB does not fit a Spark string.
    """
    ship(docs.sparkSession)
    rows = _free(docs, *ADDED)
    schema = StructType([*rows.schema.fields])
    for name in ADDED:
        schema = schema.add(name, ArrayType(IntegerType()))
    return rows.mapInArrow(_encode_rows(model, [c.lower() for c in rows.columns].index(text.lower())), schema)


def _decode_rows(path: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path).library
        for batch in batches:
            lists, names = batch.column(at), [*batch.schema.names, "decoded"]
            edges = lists.offsets.to_numpy() * lists.values.type.byte_width
            first = 0
            while first < len(lists):
                upto = max(int(np.searchsorted(edges, edges[first] + TEXT_BYTES)), first + 1)
                rows = batch.slice(first, min(upto, len(lists)) - first)
                ids = [row.values.to_numpy().tolist() if row.is_valid else [] for row in rows.column(at)]
                texts = pa.array(library.decode(ids), pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns, texts], names)
                first += len(ids)

    return run


def decode_ids(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``rows`` with decoded: the library's text of an array of ids; none or null give an empty one."""
    ship(rows.sparkSession)
    rows = _free(rows, "decoded")
    schema = StructType([*rows.schema.fields]).add("decoded", "string")
    return rows.mapInArrow(_decode_rows(model, [c.lower() for c in rows.columns].index(ids.lower())), schema)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``."""
    found = encode_texts(docs.select("doc_id", "text"), model)
    listed = found.select(
        "doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
    )
    return decode_ids(listed, model).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )
