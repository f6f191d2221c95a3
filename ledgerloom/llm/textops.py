"""Vectorised work on the bytes of many texts at once (numpy, inside Spark tasks).

A ``TextBatch`` holds the UTF-8 bytes of consecutive documents, ASCII A-Z lower-cased on request.
Words are maximal runs of bytes outside space and tab..carriage return.  Hashes are 64 bits: byte
values drawn from a fixed table, summed by position (so every word's hash comes from one running
sum), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ledgerloom.llm.columns import byte_slices, string_offsets, text_or_empty

#: Bytes of text handled at once (a longer single text is handled whole).
SLICE_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """``base ** i`` for i < n (``down``: of the inverse), grown by doubling and kept per worker."""
    have = _powers[kind]
    base = _BASE if kind == "up" else _INVERSE
    with np.errstate(over="ignore"):
        while len(have) < n:
            step = have[-1] * base
            have = np.concatenate([have, have * step])
    _powers[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(32))
        h = h * _U(0xD6E8FEB86659FD93)
        h = h ^ (h >> _U(29))
        h = h * _U(0xCA5A826395121157)
        return h ^ (h >> _U(32))


class TextBatch:
    """Bytes and document offsets of some consecutive texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._sums: np.ndarray | None = None

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, column: pa.Array, lower: bool = True) -> TextBatch:
        """From an Arrow string array; null is the empty text."""
        column = text_or_empty(column)
        offsets = string_offsets(column)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        return cls(_LOWER[data] if lower else data, offsets - offsets[0])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and each document's first word (rows + 1 numbers)."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.rows + 1, np.int64)
        inside = ~_SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range."""
        if self._sums is None:
            with np.errstate(over="ignore"):
                self._sums = np.zeros(len(self.data) + 1, np.uint64)
                np.cumsum(_BYTE_VALUE[self.data] * _power("up", len(self.data)), out=self._sums[1:])
        with np.errstate(over="ignore"):
            h = (self._sums[ends] - self._sums[starts]) * _power("down", len(self.data) + 1)[starts]
            return mix(h + (ends - starts).astype(np.uint64) * _U(0xA0761D6478BD642F))


def batches(column: pa.Array, lower: bool = True, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, TextBatch]]:
    """(first row, row after the last, batch) over slices of at most ``limit`` bytes."""
    for start, stop in byte_slices(text_or_empty(column), limit):
        yield start, stop, TextBatch.of(column.slice(start, stop - start), lower)


def chain(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words within a document, and each document's first run.

    A document with fewer words has one run of all of them; one without words has none.
    """
    counts = np.diff(first)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(runs)])
    total = int(begin[-1])
    doc = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(total) - begin[:-1][doc] + first[:-1][doc]
    stop = first[1:][doc]
    with np.errstate(over="ignore"):
        out = np.zeros(total, np.uint64)
        for j in range(width):
            has = at + j < stop
            nxt = mix(out * _U(0x9E3779B97F4A7C15) + hashes[np.minimum(at + j, max(len(hashes) - 1, 0))] + _U(j + 1)) if len(hashes) else out
            out = np.where(has, nxt, out)
    return out, begin
