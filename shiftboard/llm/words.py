"""Words of whole Arrow text columns as numpy arrays.

A text column is one run of UTF-8 bytes.  Splitting and hashing run over those bytes at once,
so Python touches batches, not words.  Work is cut into slices of whole texts, which bounds
memory by ``SLICE_BYTES`` and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
SLICE_ROWS = 1 << 14
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _table(keep: str) -> np.ndarray:
    """Which bytes belong to words; bytes from 0x80 on are parts of non-ASCII characters."""
    if keep == "alnum":  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
        return np.array([c >= 128 or 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 for c in range(256)])
    if keep == "graphic":  # [^\x20\x09-\x0D]
        return np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
    raise ValueError(keep)


WORD_BYTES = {k: _table(k) for k in ("alnum", "graphic")}
LOWER = np.array([c + 32 if 65 <= c < 91 else c for c in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            run = np.full(n, base, np.uint64)
            run[0] = 1
            _POWERS[key] = np.cumprod(run, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def clear_powers() -> None:
    _POWERS.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and len + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, kind = len(column), np.int64 if wide else np.int32
    _, ends, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes and ``rows`` rows, or one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), first + rows, n)
        yield first, last
        first = last


@dataclass
class Words:
    """Words of some texts: byte spans, 64-bit hashes, and each text's range of words."""

    data: np.ndarray  # folded bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # rows + 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def text(self, first: int, last: int) -> str:
        """Words first..last-1 joined by one space."""
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(first, last)).decode()


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running sum over all bytes."""
    n = len(data)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def split(data: np.ndarray, offsets: np.ndarray, keep: str, lower: bool) -> Words:
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = WORD_BYTES[keep][data]
    cut = np.zeros(n + 1, bool)  # a text begins or ends before this byte
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    bounds = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, hash_spans(data, starts, ends), bounds)


def split_column(column: pa.Array, keep: str, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row, words) for slices of a column."""
    data, offsets = text_bytes(column)
    for a, b in slices(offsets):
        part = offsets[a : b + 1]
        yield a, b, split(data[part[0] : part[-1]], part - part[0], keep, lower)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words by its first word; runs that pass the end are left out."""
    n = max(len(hashes) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _BASE
        out += hashes[j : j + n]
    return mix(out + np.uint64(k))


def gram_bounds(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last gram of each text, in the numbering of ``grams``."""
    return bounds[:-1], np.maximum(bounds[1:] - k + 1, bounds[:-1])


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit values as Spark's bigint."""
    return x.astype(np.uint64).view(np.int64)
