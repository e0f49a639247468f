"""Hashes of all byte strings of a buffer from prefix sums, whole columns at a time.

A string's hash is a polynomial in an odd base over random 64-bit values of its bytes,
modulo 2**64; two bases give 128 bits. Texts are handled as one buffer of bytes with
offsets, which is how Arrow holds a column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
BUFFER_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (one round of a known finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[0])) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
        filled += step
    return out


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _cache.get(which)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        base = _BASES[which]
        held = _cache[which] = (_powers(base, size), _powers(pow(base, -1, 1 << 64), size))
    return held


class PrefixHash:
    """Hashes of ``data[start:end]`` for arrays of starts and ends."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.up, self.down = _tables(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * self.up[: len(data)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray, then: int | None = None) -> np.ndarray:
        """Hashes of the strings, or of the strings followed by the byte ``then``."""
        own = (self.sums[end] - self.sums[start]) * self.down[start]
        return own if then is None else own + _VALUES[then] * self.up[end - start]

    def all_of(self, k: int) -> np.ndarray:
        """Hash of every string of ``k`` bytes, by start."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and its offsets; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(sizes: np.ndarray, most: int = BUFFER_BYTES) -> list[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes each; a longer row is a run of its own."""
    cuts, start, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            cuts.append((start, i))
            start, held = i, 0
        held += n
    if start < len(sizes):
        cuts.append((start, len(sizes)))
    return cuts
