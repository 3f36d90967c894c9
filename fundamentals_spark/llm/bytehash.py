"""Arrow string columns as one byte array, with polynomial prefix hashes over it (numpy, modulo 2**64).

The prefix hash of position i is the sum of table[byte j] * B**j for j < i, so a substring's hash is a difference of two of
them times B**-start: equal substrings have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229)
TABLE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
BASE = int(_RANDOM.integers(1, 2**62, dtype=np.uint64)) * 4 + 3
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the process and grown when needed."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        size = max(n, 1 << 16)
        p = np.full(size, np.uint64(base), dtype=np.uint64)
        p[0] = 1
        p = np.cumprod(p, dtype=np.uint64)
        _powers[base] = p
    return p[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes: low bits of a polynomial modulo 2**64 are weak."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, one after the other, and offsets (rows + 1); a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes each; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def prefix_hash(buf: np.ndarray, table: np.ndarray = TABLE, base: int = BASE) -> np.ndarray:
    out = np.empty(len(buf) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(table[buf] * powers(base, len(buf)), out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int = INVERSE) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(inverse, len(prefix))[start]


def word_spans(buf: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes with ``word_byte`` true, none across rows, and the row of each."""
    inside = word_byte[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    if len(buf):
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0] = edge[-1] = True
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = inside[starts] if len(starts) else np.zeros(0, dtype=bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def spaces_table() -> np.ndarray:
    """True for bytes of words: all but space and tab to carriage return."""
    t = np.ones(256, dtype=bool)
    t[[32, 9, 10, 11, 12, 13]] = False
    return t


def lower_table() -> np.ndarray:
    """Hash table that takes A-Z as a-z."""
    t = TABLE.copy()
    t[65:91] = TABLE[97:123]
    return t
