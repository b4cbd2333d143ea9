"""Byte-level BPE with a cache of space-separated pieces."""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer

#: Pieces kept per worker (about 250 bytes each); when full the cache starts anew.
CACHE = 1_200_000
LONGEST = 64
#: Before a space that follows a non-space every token ends, so texts may be cut there.
_CUT = re.compile(r"(?<=\S)(?= )")
#: A space amid or at the end of other white space, where ``split(" ")`` would cut a token.
_UNSAFE = re.compile(r"\s \s|\s \Z")
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the others
    in order from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class Encoder:
    """ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        self.by_pieces = (
            spec["model"].get("type") == "BPE" and not spec.get("normalizer")
            and split.get("type") == "ByteLevel" and split.get("use_regex", True)
            and not split.get("add_prefix_space")
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.characters = byte_characters()
        self.marks = {m: self._plain(m) for m in ("", ".", ",")}
        self.pieces = _Pieces(self)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def piece(self, text: str) -> bytes:
        """A space and ``text``; words of Latin letters go to the merges at once."""
        word = _WORD.fullmatch(text)
        if word is None:
            return self._plain(" " + text)
        if word[2] and (known := self.pieces.get(word[1])) is not None:
            return known + self.marks[word[2]]
        spelled = (" " + word[1]).encode().decode("latin-1").translate(self.characters)
        ids = [token.id for token in self.model.tokenize(spelled)]
        return np.array(ids, self.kind).tobytes() + self.marks[word[2]]

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids of ``kind``."""
        if not text:
            return b""
        if not self.by_pieces or any(a in text for a in self.added):
            return self._plain(text)
        if _UNSAFE.search(text):
            first, *rest = _CUT.split(text)
            rest = [r[1:] for r in rest]
        else:
            first, *rest = text.split(" ")
        return b"".join([self._plain(first), *map(self.pieces.__getitem__, rest)])


class _Pieces(dict):
    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, text: str) -> bytes:
        ids = self.encoder.piece(text)
        if len(text) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[text] = ids
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
