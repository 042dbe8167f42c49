"""Vectorised words: spans and 64-bit hashes of ``[^\\x20\\x09-\\x0D]+`` in packed UTF-8.

A packed batch of texts is one byte array and ``n + 1`` offsets. No Python object is made per
word; the cost is a few numpy passes over the bytes, in chunks that stay in cache.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = 1 << 19
_P, _M = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _letters() -> np.ndarray:
    """A-Z as a-z, ASCII punctuation as space."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    for a, b in ((33, 48), (58, 65), (91, 97), (123, 127)):
        out[a:b] = 32
    return out


LETTERS = _letters()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place where it can be."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * U(_P))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_P, -1, 1 << 64)
    up, down = np.full(n, U(_P)), np.full(n, U(inverse))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def pack(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = offsets[1:-1]
    at = at[(at > 0) & (at < len(data))]  # a text's end also ends its last word
    starts[at] = inside[at]
    ends[at - 1] = inside[at - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True, letters: np.ndarray | None = None):
    """(starts, ends, first, hashes): byte spans of all words, the index of each text's first
    word (``n + 1`` of them), and each word's hash (of its A-Z-lowered bytes if ``lower``).

    ``letters``: a table of 256 bytes put in place of ``data`` before words are cut.
    """
    s_all, e_all, h_all, first = [], [], [], [np.zeros(1, np.int64)]
    n, i, seen = len(offsets) - 1, 0, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        part, own = data[lo:hi], offsets[i : j + 1] - lo
        if letters is not None:
            part = letters[part]
        if len(part):
            s, e = _spans(part, own)
        else:
            s = e = np.zeros(0, np.int64)
        if hashes and len(s):
            if lower:
                part = _LOWER[part]
            up, down = _powers(max(_CHUNK, 1 << (len(part) - 1).bit_length()))
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_TABLE[part] * up[: len(part)], out=sums[1:])
            h = (sums[e] - sums[s]) * down[s]
            h_all.append(mix(h + (e - s).astype(np.uint64) * U(_M)))
        s_all.append(s + lo)
        e_all.append(e + lo)
        first.append(np.searchsorted(s, own[1:]) + seen)
        seen += len(s)
        i = j
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(s_all, np.int64), cat(e_all, np.int64), np.concatenate(first), cat(h_all, np.uint64)


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a text, and the index of each run's first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        acc *= U(_P)
        acc += h[k : len(h) - n + 1 + k]
    left = np.repeat(first[1:], np.diff(first))[: len(acc)] - np.arange(len(acc))
    at = np.flatnonzero(left >= n)
    return mix(acc[at] + U(n)), at


def to_plane(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes under zstd: leading zero bytes cost next to nothing."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize
    return pa.compress(values.view(np.uint8).reshape(-1, width).T.tobytes(), codec="zstd", asbytes=True)


def from_plane(data: bytes, n: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    raw = pa.decompress(data, decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def to_gaps(ascending: np.ndarray) -> bytes:
    """Ascending uint64 numbers as planes of their gaps: about log2(range / n) + 1.5 bits each."""
    gaps = np.empty(len(ascending), np.uint64)
    gaps[:1] = ascending[:1]
    np.subtract(ascending[1:], ascending[:-1], out=gaps[1:])
    return to_plane(gaps)


def from_gaps(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(from_plane(data, n, np.uint64), dtype=np.uint64)
