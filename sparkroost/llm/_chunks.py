"""Runs of bytes between ASCII white space, each different run of a batch once.

A run of up to ``SHORT`` bytes is compared as two words of 64 bits and its length, so equal classes
mean equal bytes; longer runs are compared as Python objects. What is worked out for a class (ids,
words) is then gathered for all its runs, without a Python object for each of them.
"""

from __future__ import annotations

import numpy as np

from ._words import U, _P, mix, words

SHORT = 16
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def spans(data: np.ndarray, offsets: np.ndarray, lead: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first): the runs, and the number of each text's first one (``n + 1`` of them).
    ``lead``: a run begins with the white space before it, and white space at a text's end is a run."""
    begin, end, first, _ = words(data, offsets, hashes=False)
    if not lead:
        return begin, end, first
    some = np.diff(first) > 0
    last = offsets[:-1].copy()
    last[some] = end[first[1:][some] - 1]
    begin = np.concatenate([begin[:1], end[:-1]])
    begin[first[:-1][some]] = offsets[:-1][some]
    tail = last < offsets[1:]
    at = first[1:][tail]
    first = first + np.concatenate([[0], np.cumsum(tail)])
    return np.insert(begin, at, last[tail]), np.insert(end, at, offsets[1:][tail]), first


def different(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of, head): the class of each run, and a run of each class."""
    n = len(begin)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = end - begin
    padded = np.concatenate([data, np.zeros(2 * SHORT, np.uint8)])
    word = np.ndarray((len(data) + SHORT,), "<u8", padded, 0, (1,))
    short = np.flatnonzero(size <= SHORT)
    b, k = begin[short], size[short]
    low, high = word[b] & _MASK[np.minimum(k, 8)], word[b + 8] & _MASK[np.clip(k - 8, 0, 8)]
    key = mix(low + mix(high ^ (k.astype(np.uint64) * U(_P))))
    order = np.argsort(key, kind="stable")
    differs = lambda x: x[order][1:] != x[order][:-1]
    new = differs(low) | differs(high) | differs(k)
    if (new & ~differs(key)).any():  # two keys met by chance
        order = np.lexsort((low, high, k))
        new = differs(low) | differs(high) | differs(k)
    new = np.append(True, new)[: len(order)]
    of = np.empty(n, np.int64)
    of[short[order]] = np.cumsum(new) - 1
    head = short[order[new]].tolist()
    if len(short) < n:
        raw, seen = data.tobytes(), {}
        long = np.flatnonzero(size > SHORT)
        for i, x, y in zip(long.tolist(), begin[long].tolist(), end[long].tolist(), strict=True):
            own = raw[x:y]
            if own not in seen:
                seen[own] = len(head)
                head.append(i)
            of[i] = seen[own]
    return of, np.array(head, np.int64)


def gather(of: np.ndarray, parts: list[bytes], first: np.ndarray, kind=np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """What the classes' parts give for all runs in order, and where each text's begins (``n + 1`` of them)."""
    flat = np.frombuffer(b"".join(parts), kind)
    lens = np.fromiter(map(len, parts), np.int64, len(parts)) // flat.itemsize
    starts = np.cumsum(lens) - lens
    count = lens[of]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    place = np.repeat(starts[of] - (ends - count), count) + np.arange(total)
    return flat[place], np.concatenate([[0], ends])[first]


def any_of(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, whether one of its bytes is marked."""
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return sums[offsets[1:]] > sums[offsets[:-1]]
