"""Elias-Fano code of a non-decreasing sequence, with sampled select."""

from __future__ import annotations

import struct

import numpy as np

#: A select sample for every so many ones.
SAMPLE = 256
_HEAD = struct.Struct("<QBQQ")


class EliasFano:
    """Of each value the low bits stand in a packed array, the high ones in unary in a bit vector:
    value i sets bit (value >> low) + i. About 2 + log2(universe / n) bits a value; the i-th value
    is found by select from the nearest sample."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.samples = n, low, lows, highs, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low, dtype=np.uint64)
        bits = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        vector = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        vector[ones] = 1
        return cls(
            n, low, np.packbits(bits.ravel(), bitorder="little"),
            np.packbits(vector, bitorder="little"), ones[::SAMPLE].astype("<u4"),
        )

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.low, len(self.lows), len(self.highs))
        return head + self.lows.tobytes() + self.highs.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview) -> tuple[EliasFano, int]:
        """The code and the number of bytes it took."""
        n, low, a, b = _HEAD.unpack_from(raw)
        at = _HEAD.size
        count = -(-n // SAMPLE)
        lows = np.frombuffer(raw, np.uint8, a, at)
        highs = np.frombuffer(raw, np.uint8, b, at + a)
        samples = np.frombuffer(raw, "<u4", count, at + a + b)
        return cls(n, low, lows, highs, samples), at + a + b + 4 * count

    def _low_parts(self, first: int, last: int) -> np.ndarray:
        begin, end = first * self.low, last * self.low
        bits = np.unpackbits(self.lows[begin // 8 : -(-end // 8)], bitorder="little")
        bits = bits[begin % 8 : begin % 8 + end - begin].reshape(last - first, self.low)
        return (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value i, read from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, need = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        width = 64
        while True:
            window = np.unpackbits(self.highs[byte : byte + width], bitorder="little")
            ones = np.flatnonzero(window[skip:])
            if len(ones) > need:
                high = byte * 8 + skip + int(ones[need]) - i
                return (high << self.low) | int(self._low_parts(i, i + 1)[0])
            width *= 4

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64)
        return (high << np.uint64(self.low)) | self._low_parts(0, self.n)
