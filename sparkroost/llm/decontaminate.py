"""Benchmark decontamination by latent semantic retrieval with sequence and answer checks.

1. Benchmark items are cut into passages of at most ``PASSAGE`` words; their words are the
   vocabulary. Texts are written once as codes of that vocabulary (other words: 0), padded to units
   of ``UNIT`` words. Words are lower-cased (A-Z) and stripped of ASCII punctuation.
2. The units of *all* texts that hold a word are counted for each word. Of every passage the
   ``TERMS`` rarest words that the texts have are TF-IDF columns.
3. Randomised SVD, distributed: the test matrix lies in the span of the benchmark's own TF-IDF
   rows; one pass over all units multiplies it by A'A, a second one projects A on the orthonormal
   basis of that and sums the Gram matrix, whose eigenvectors turn the basis into the singular
   vectors. A has the units of all texts and the benchmark's passages. Partial products are summed
   by row blocks in the shuffle; the driver gets a matrix of the vocabulary's size.
4. Windows of ``SPAN`` units, one unit apart, hold every region of one and a half times a passage. Of each
   window the passages with a cosine of ``NEAR`` or more in the latent space are the first candidates: they find almost
   all matches, the paraphrases too (README: the measured share). With more passages than dimensions a verbatim item
   can fall under any threshold, so the pairs that the cosine leaves out are candidates if the window has as many of the
   passage's words as step 5 asks for in order: a bound that no match falls below.
5. A candidate must have a longest common subsequence of
   ``SHARE`` of the passage within a region of one and a half times its length (eight words at
   least, or all words of a shorter passage), and half of the passage's answer (its last sentence)
   as a subsequence of the region. Every region of that length is tried. So paraphrases that keep the order of most words
   are found, with other words between them too.

A benchmark over ``SLICE_BYTES`` of text is worked off in slices, each with passes of its own.

Defined results: null or empty texts and items, and items with a null item_id (no row could name them), match nothing; repeated items give a row for each
different item_id; repeated doc_ids give one row for each item; a null doc_id is reported as null;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _shared
from ._words import LETTERS, pack, words

PASSAGE, UNIT, TERMS, RANK, SHARE, ANSWER = 64, 32, 12, 128, 0.7, 0.5
LEAST_WORDS = 8
#: Units of a window: a region of 96 words that begins anywhere in the first unit ends in it.
SPAN, NEAR = 4, 0.5
SLICE_BYTES = 1 << 20
_CHUNK = 64
_BLOCK = 256


class Passage:
    """A passage of an item, its codes, and those of its answer."""

    def __init__(self, item: int, h: np.ndarray, answer: np.ndarray):
        self.item, self.h, self.answer_h = item, h, answer

    def code(self, vocabulary: np.ndarray) -> None:
        self.codes = (np.searchsorted(vocabulary, self.h) + 1).tolist()
        self.answer = (np.searchsorted(vocabulary, self.answer_h) + 1).tolist()
        self.masks, self.answer_masks = _masks(self.codes), _masks(self.answer)
        self.need = max(math.ceil(SHARE * len(self.codes)), min(len(self.codes), LEAST_WORDS))


def _masks(codes: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(codes):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common(masks: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence, all columns of a row at once in one integer."""
    full = (1 << n) - 1
    row = full
    for c in other:
        m = masks.get(c)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def _hashes(text: str) -> np.ndarray:
    return words(*pack(pa.array([text], pa.string())), letters=LETTERS)[3]


def passages_of(items: list[tuple[int, str]]) -> list[Passage]:
    out = []
    for item, text in items:
        sentences = [h for s in re.split(r"(?<=[.!?])\s+", text or "") if len(h := _hashes(s))]
        h = np.concatenate(sentences) if sentences else np.zeros(0, np.uint64)
        if not len(h):
            continue
        last = len(h) - (len(sentences[-1]) if len(sentences) > 1 else max(1, len(h) // 3))
        n = math.ceil(len(h) / PASSAGE)
        for a, b in zip(*[iter(np.linspace(0, len(h), n + 1).astype(int).repeat(2)[1:-1].tolist())] * 2, strict=True):
            out.append(Passage(item, h[a:b], h[max(a, last) : b]))
    return out


def _encode(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        kind = np.uint16 if len(vocabulary) < 1 << 16 else np.uint32
        for batch in batches:
            _, _, first, h = words(*pack(batch.column(1)), letters=LETTERS)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            codes = np.where(vocabulary[at] == h, at + 1, 0).astype(kind)
            units = -(-np.diff(first) // UNIT)
            begin = np.concatenate([[0], np.cumsum(units * UNIT)])
            out = np.zeros(begin[-1], kind)
            out[np.arange(len(h)) + np.repeat(begin[:-1] - first[:-1], np.diff(first))] = codes
            raw, width = out.tobytes(), out.itemsize
            body = [raw[a * width : b * width] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first), pa.int64()), pa.array(body, pa.binary())], ["doc_id", "n", "codes"])

    return run


_CODES = "doc_id long, n long, codes binary"


def _read(batch: pa.RecordBatch, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """The units of a batch, and the number of units of each text."""
    column = batch.column(2).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    kind = np.dtype(np.uint32 if wide else np.uint16)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(raw.tobytes(), kind).reshape(-1, UNIT), np.diff(offsets) // (UNIT * kind.itemsize)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _frequency(size: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size + 1, np.int64)
        for batch in _parts(batches):
            u = np.sort(_read(batch, wide)[0], axis=1)
            u[:, 1:][u[:, 1:] == u[:, :-1]] = 0
            own = np.bincount(u.ravel(), minlength=size + 1)
            own[0] = len(u)
            count += own
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(count[at], pa.int64())], ["code", "n"])

    return run


def _entries(units: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, column) of all entries of the TF-IDF rows; a word that repeats has as many."""
    c = column[units.ravel()]
    at = np.flatnonzero(c >= 0)
    return at // UNIT, c[at]


def _project(u: np.ndarray, c: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """Rows of A times ``basis`` (already weighted by idf): dense (n, rank)."""
    out = np.zeros((n, basis.shape[1]), np.float32)
    step = 1 << 10
    for a in range(0, len(u), step):
        part = u[a : a + step]
        heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        out[part[heads]] += np.add.reduceat(basis[c[a : a + step]], heads, axis=0)
    return out


def _rows_out(matrix: np.ndarray) -> pa.RecordBatch:
    at = range(0, len(matrix), _CHUNK)
    return pa.RecordBatch.from_arrays([pa.array([a // _CHUNK for a in at], pa.int32()), pa.array([matrix[a : a + _CHUNK].tobytes() for a in at], pa.binary())], ["chunk", "body"])


def _add(table: pa.Table) -> pa.Table:
    bodies = table.column("body").to_pylist()
    total = np.zeros(len(bodies[0]) // 8)
    for b in bodies:
        total += np.frombuffer(b, np.float64)
    return pa.table({"chunk": table.column("chunk")[:1].cast(pa.int32()), "body": pa.array([total.tobytes()], pa.binary())})


def _summed(df: DataFrame, width: int) -> np.ndarray:
    """The sum of the matrices that tasks sent in row blocks."""
    rows = sorted(df.groupBy("chunk").applyInArrow(_add, "chunk int, body binary").collect(), key=lambda r: r[0])
    return np.concatenate([np.frombuffer(r[1], np.float64) for r in rows]).reshape(-1, width)


def _multiply(held, wide: bool):
    """Tasks' parts of A'(A basis)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, idf, basis = held.value
        weighted = (basis * idf[:, None]).astype(np.float32)
        total = np.zeros(basis.shape)
        for batch in _parts(batches):
            units, _ = _read(batch, wide)
            u, c = _entries(units, column)
            y = _project(u, c, weighted, len(units))
            order = np.argsort(c.astype(np.uint16) if len(idf) < 1 << 16 else c, kind="stable")
            step = 1 << 10
            for a in range(0, len(order), step):
                o = order[a : a + step]
                own = c[o]
                heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                total[own[heads]] += np.add.reduceat(y[u[o]], heads, axis=0)
        yield _rows_out(total * idf[:, None])

    return run


def _gram(held, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, idf, basis = held.value
        weighted = (basis * idf[:, None]).astype(np.float32)
        total = np.zeros((basis.shape[1],) * 2)
        for batch in _parts(batches):
            units, _ = _read(batch, wide)
            u, c = _entries(units, column)
            z = _project(u, c, weighted, len(units))
            z = z[np.unique(u)]
            total += z.T @ z
        yield _rows_out(total)

    return run


def latent_space(codes: DataFrame, wide: bool, column: np.ndarray, idf: np.ndarray, bench: np.ndarray, rank: int = RANK, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors, singular values) of the TF-IDF rows of all units and of ``bench``."""
    context = codes.sparkSession.sparkContext
    width = min(rank, bench.shape[0] + 16, bench.shape[1])
    start = bench.T @ np.random.default_rng(seed).standard_normal((bench.shape[0], width))
    basis = np.linalg.qr(start)[0]
    held = context.broadcast((column, idf, basis))
    kind = "chunk int, body binary"
    w = _summed(codes.mapInArrow(_multiply(held, wide), kind), basis.shape[1]) + bench.T @ (bench @ basis)
    basis = np.linalg.qr(w)[0]
    held = context.broadcast((column, idf, basis))
    z = bench @ basis
    value, turn = np.linalg.eigh(_summed(codes.mapInArrow(_gram(held, wide), kind), basis.shape[1]) + z.T @ z)
    keep = np.flatnonzero(value > value.max() * 1e-9)[::-1]
    return basis @ turn[:, keep], np.sqrt(value[keep])


class _Bound:
    """For blocks of passages: how many words a window shares with a passage, repeats counted. No
    common subsequence is longer."""

    def __init__(self, passages: list[Passage], size: int):
        self.need = np.array([p.need for p in passages], np.uint8)
        self.blocks = []
        for a in range(0, len(passages), _BLOCK):
            own = passages[a : a + _BLOCK]
            counts = [np.unique(p.codes, return_counts=True) for p in own]
            most = np.zeros(size + 1, np.int64)
            for c, n in counts:
                most[c] = np.maximum(most[c], n)
            first = np.cumsum(most) - most  # a row for each occurrence of a word
            shares = np.zeros((int(most.sum()), len(own)), np.uint8)
            for j, (c, n) in enumerate(counts):
                for r in range(int(n.max())):
                    shares[first[c[n > r]] + r, j] = 1
            self.blocks.append((a, most.astype(np.int32), first.astype(np.int32), shares))

    def candidates(self, units: np.ndarray, end: np.ndarray, live: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, passage) pairs whose window shares ``need`` words."""
        for lo in range(0, len(live), 4096):
            part = live[lo : lo + 4096]
            u = np.zeros((len(part), SPAN * UNIT), units.dtype)
            for k in range(SPAN):
                ok = part + k < end[part]
                u[ok, k * UNIT : (k + 1) * UNIT] = units[part[ok] + k]
            u.sort(axis=1)
            row, at = np.nonzero(u)
            code = u[row, at]
            heads = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))[: len(code)])
            nth = np.arange(len(code)) - np.repeat(heads, np.diff(np.append(heads, len(code))))
            for first, most, begin, shares in self.blocks:
                keep = np.flatnonzero(nth < most[code])
                r, c = row[keep], begin[code[keep]] + nth[keep]
                held, step = np.zeros((len(part), shares.shape[1]), np.uint8), 1 << 10
                for a in range(0, len(r), step):
                    own = r[a : a + step]
                    cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    held[own[cut]] += np.add.reduceat(shares[c[a : a + step]], cut, axis=0, dtype=np.uint8)
                i, j = np.nonzero(held >= self.need[first : first + shares.shape[1]])
                yield part[i], j + first


def _tight(p: Passage, window: list[int]) -> tuple[int, int, int] | None:
    """(length, start, end) of the first region of the window that holds the passage."""
    n = len(p.codes)
    if common(p.masks, n, window) < p.need:
        return None
    size = math.ceil(1.5 * n)
    last = max(0, len(window) - size)
    for a in range(last + 1):
        if a < last and window[a] not in p.masks:
            continue  # a region that begins at a word of the passage holds as much
        part = window[a : a + size]
        got = common(p.masks, n, part)
        if got >= p.need and common(p.answer_masks, len(p.answer), part) >= ANSWER * len(p.answer):
            return got, a, a + len(part)
    return None


def _matches(units: np.ndarray, end: np.ndarray, windows: np.ndarray, ks: np.ndarray, own: list[Passage]) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
    """The candidates whose window holds the passage, and where."""
    seen = None
    for w, k in zip(windows.tolist(), ks.tolist(), strict=True):
        if w != seen:
            window = units[w : min(w + SPAN, int(end[w]))].ravel().tolist()
            seen = w
        if got := _tight(own[k], window):
            yield w, k, got


def _nearest(units: np.ndarray, end: np.ndarray, live: np.ndarray, column: np.ndarray, weighted: np.ndarray, bench: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, passage) pairs with a cosine of ``NEAR`` or more in the latent space. A pair is judged by the best
    of its window's halves too, since an item is half of a window."""
    u, c = _entries(units, column)
    z = np.concatenate([_project(u, c, weighted, len(units)), np.zeros((1, weighted.shape[1]), np.float32)])
    none = len(units)
    for lo in range(0, len(live), 4096):
        part = live[lo : lo + 4096]
        at = np.stack([np.where(part + d < end[part], part + d, none) for d in range(SPAN)])
        pairs = [z[at[d]] + z[at[d + 1]] for d in range(SPAN - 1)]
        best = np.zeros((len(part), len(bench)), np.float32)
        for x in (*pairs, *(p + z[at[d + 2]] for d, p in enumerate(pairs[:-1]))):
            norm = np.linalg.norm(x, axis=1)
            some = np.flatnonzero(norm > 0)
            best[some] = np.maximum(best[some], (x[some] / norm[some, None]) @ bench.T)
        i, j = np.nonzero(best >= NEAR)
        yield part[i], j


def _cosines(units: np.ndarray, end: np.ndarray, met: list[tuple], column: np.ndarray, weighted: np.ndarray, bench: np.ndarray) -> list[float]:
    """Of each window and passage that matched, their cosine in the latent space."""
    if not met:
        return []
    w, k = np.array([m[0] for m in met]), np.array([m[1] for m in met])
    used = np.unique(np.concatenate([np.minimum(w + d, end[w] - 1) for d in range(SPAN)]))
    u, c = _entries(units[used], column)
    z = _project(u, c, weighted, len(used))
    win = np.zeros((len(w), z.shape[1]), np.float32)
    for d in range(SPAN):
        ok = w + d < end[w]
        win[ok] += z[np.searchsorted(used, w[ok] + d)]
    win /= np.maximum(np.linalg.norm(win, axis=1, keepdims=True), 1e-12)
    return [float(x) for x in np.einsum("ij,ij->i", win, bench[k])]


def _search(held, passages, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, weighted, bench = held.value
        own = passages.value
        bound = _Bound(own, len(column) - 1)
        for batch in _parts(batches, 256):
            units, per = _read(batch, wide)
            begin = np.concatenate([[0], np.cumsum(per)])
            end = np.repeat(begin[1:], per)
            at = np.arange(len(units))
            live = np.flatnonzero((at == np.repeat(begin[:-1], per)) | (at + SPAN <= end))
            met, near = [], set()
            for windows, ks in _nearest(units, end, live, column, weighted, bench):
                near.update(zip(windows.tolist(), ks.tolist(), strict=True))
                met += _matches(units, end, windows, ks, own)
            found_near = len(met)
            for windows, ks in bound.candidates(units, end, live):
                left = np.array([x not in near for x in zip(windows.tolist(), ks.tolist(), strict=True)], bool)
                met += _matches(units, end, windows[left], ks[left], own)
            best: dict[tuple[int, int], tuple] = {}
            cosine = _cosines(units, end, met, column, weighted, bench)
            for i, ((w, k, got), score) in enumerate(zip(met, cosine, strict=True)):
                row = int(np.searchsorted(begin, w, "right") - 1)
                at_word = (w - int(begin[row])) * UNIT
                found = (got[0] / len(own[k].codes), score, at_word + got[1], at_word + got[2], got[0], i < found_near)
                key = (row, own[k].item)
                best[key] = max(best.get(key, found), found)
            ids = batch.column(0).to_pylist()
            rows = [(ids[r], item, *x) for (r, item), x in sorted(best.items())]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], [x.split()[0] for x in _FOUND.split(", ")])

    return run


_FOUND = "doc_id long, item_id long, share double, cosine double, start long, end long, matched long, by_cosine boolean"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, share, cosine, start, end, matched, by_cosine): the texts that hold an item, where
    (words), and how many of the passage's words in order; the best match of each pair, and whether the cosine search
    came upon it."""
    spark = docs.sparkSession
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = size // SLICE_BYTES + 1
    out = [_slice(own, items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)) for k in range(slices)]
    found = [x for x in out if x is not None]
    if not found:
        return spark.createDataFrame([], _FOUND)
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    best = every.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "cosine", "start", "end", "matched", "by_cosine")).alias("m"))
    return best.select("doc_id", "item_id", "m.*")


def _slice(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    spark = docs.sparkSession
    passages = passages_of(sorted((r[0], r[1]) for r in items.collect()))  # at most about SLICE_BYTES
    if not passages:
        return None
    vocabulary = np.unique(np.concatenate([p.h for p in passages]))
    for p in passages:
        p.code(vocabulary)
    wide, context = len(vocabulary) >= 1 << 16, spark.sparkContext
    coded = _shared.write(docs.mapInArrow(_encode(context.broadcast(vocabulary)), _CODES), _shared.scratch(spark, "codes"))
    codes = spark.read.schema(_CODES).parquet(coded)
    counted = dict(map(tuple, codes.mapInArrow(_frequency(len(vocabulary), wide), "code long, n long").groupBy("code").agg(F.sum("n")).collect()))  # the vocabulary
    frequency = np.array([counted.get(c, 0) for c in range(len(vocabulary) + 1)], float)
    terms = [sorted(set(p.codes), key=lambda c: (frequency[c] == 0, frequency[c], c))[:TERMS] for p in passages]
    chosen = np.unique(np.concatenate(terms))
    column = np.full(len(vocabulary) + 1, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    idf = np.log((frequency[0] + 1) / (frequency[chosen] + 1)) + 1
    bench = np.zeros((len(passages), len(chosen)))
    for i, p in enumerate(passages):
        for c in p.codes:
            if column[c] >= 0:
                bench[i, column[c]] += idf[column[c]]
    vectors, _ = latent_space(codes, wide, column, idf, bench)
    latent = bench @ vectors
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    held = context.broadcast((column, (vectors * idf[:, None]).astype(np.float32), latent.astype(np.float32)))
    return _shared.keep(codes.mapInArrow(_search(held, context.broadcast(passages), wide), _FOUND), "found", coded)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "matched", "start", "end", F.round("share", 6).alias("share"), F.round("cosine", 4).alias("cosine"))
