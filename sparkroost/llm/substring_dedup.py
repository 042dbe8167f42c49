"""Substring dedup with prefix-partitioned suffix trees over words.

A suffix of the corpus begins at each word of each text. A run of ``min_words`` words that
occurs more than once is a node of the suffix tree at that depth or deeper. The tree is too
large for one machine, so it is built as many subtrees, each of all suffixes with one prefix.

1. *Screen.* Each block of texts sends the 40-bit fingerprints of its distinct windows of
   ``min_words`` words, as gaps of a sorted set (under three bytes a window), to the partition of
   the fingerprint's range. Back comes a bit for each: does any other block hold it? A suffix
   whose window occurs once is a leaf above the wanted depth and enters no subtree. Fingerprints
   only ever let too much through; what they let through is compared by 128 bits in 3.
2. *Prefixes.* In the same pass blocks count the prefixes of their windows. A prefix of one word
   with more suffixes than a group may hold is extended by one word, and so on: variable-length
   prefixes, so that each group of suffixes is of a size that fits into memory.
3. *Subtrees.* Each block sends its distinct surviving suffixes (spelled as four symbols of 32 bits, each
   of three or four words; the smallest doc_id and the count) to the group of their prefix. There the
   suffixes are sorted and the symbols that neighbours share give the internal nodes. Deep nodes (``min_words``
   and deeper) are the repeats: all suffixes below one share its words. Back goes a bit for each
   suffix: does a smaller doc_id lie below its node?
4. *Removal.* Each block marks the words that a flagged window covers; neighbouring windows join
   into the maximal removed spans.

A passage that a third of all texts share is sent once by each block, so no group grows with the
copies. Defined results: null ids count as the smallest long; a null or empty text has no words;
texts shorter than a window lose nothing; rows that repeat a doc_id are one document for the
comparison ("smaller doc_id" is strict) and keep a row each; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _blocks, _shared
from ._exchange import FAN, RUN_ITEMS, exchange, parts
from ._words import U, _P, from_gaps, from_plane, grams, mix, to_gaps, to_plane, words

MIN_WORDS = 13
#: Bytes of text in a block; a task's arrays take about twenty times that.
BLOCK_BYTES = 5 << 20
#: Suffixes that one group may hold, about 100 MB while its subtree is built.
GROUP_SUFFIXES = 500_000
#: Symbols of 32 bits that spell a suffix.
SYMBOLS = 4
#: Windows in one range of fingerprints.
RANGE_WINDOWS = 2_000_000
_NULL = np.iinfo(np.int64).min


class _Windows:
    """Distinct windows of a block by fingerprint."""

    def __init__(self, block: _blocks.Block, n: int):
        self.starts, self.ends, self.first, self.h = words(block.data, block.offsets)
        fp, self.at = grams(self.h, self.first, n)
        self.doc = (np.searchsorted(self.first, self.at, "right") - 1).astype(np.int32)
        ids = np.where(block.nulls, _NULL, block.ids)
        self.id = ids[self.doc]
        order = np.argsort(fp, kind="stable")
        fp = fp[order]
        new = np.ones(len(fp), bool)
        new[1:] = fp[1:] != fp[:-1]
        self.cls = np.empty(len(fp), np.int32)
        self.cls[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        self.fp = fp[heads]
        self.count = np.diff(np.append(heads, len(fp)))
        by_id = self.id[order]
        self.low = np.minimum.reduceat(by_id, heads) if len(heads) else by_id
        self.high = np.maximum.reduceat(by_id, heads) if len(heads) else by_id
        self.where = self.at[order[heads]] if len(heads) else order  # a first word of each distinct window


def _bits_for(windows: int) -> int:
    """Fingerprint bits at which about one window in 8,000 passes the screen by chance."""
    return int(min(64, max(40, np.ceil(np.log2(max(windows, 2))) + 13)))


def _prefix_counts(win: _Windows, n: int, least: int) -> tuple[list[int], list[int], list[int]]:
    """Prefixes with at least ``least`` distinct windows of this block: depth, hash, count."""
    depths, keys, counts = [], [], []
    at, acc = win.where, np.zeros(len(win.where), np.uint64)
    for depth in range(1, n):
        acc = acc * U(_P) + win.h[at + depth - 1]
        key, inverse, count = np.unique(mix(acc + U(depth)), return_inverse=True, return_counts=True)
        hot = count >= least
        if not hot.any():
            break
        depths += [depth] * int(hot.sum())
        keys += key[hot].view(np.int64).tolist()
        counts += count[hot].tolist()
        stay = hot[inverse]
        at, acc = at[stay], acc[stay]
    return depths, keys, counts


def _send_windows(n: int, bits: int, ranges: int, least: int):
    step = 64 - bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks.blocks(batches):
            win = _Windows(block, n)
            t = win.fp >> U(step)
            t = t[np.append(True, t[1:] != t[:-1])] if len(t) else t
            edges = np.searchsorted(t, _edges(bits, ranges))
            rows = [(r, int(b - a), to_gaps(t[a:b])) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            depths, keys, counts = _prefix_counts(win, n, least)
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([x[0] for x in rows] + [-1] * len(keys), pa.int32()),
                    "block": pa.array([block.block] * len(rows) + depths, pa.int64()),
                    "n": pa.array([x[1] for x in rows] + counts, pa.int64()),
                    "key": pa.array([0] * len(rows) + keys, pa.int64()),
                    "body": pa.array([x[2] for x in rows] + [None] * len(keys), pa.binary()),
                }
            )

    return run


@functools.lru_cache(maxsize=2)
def _edges(bits: int, ranges: int) -> np.ndarray:
    return np.array([(r << bits) // ranges for r in range(ranges)] + [(1 << bits) - 1], np.uint64) + np.array([0] * ranges + [1 if bits < 64 else 0], np.uint64)


def _screen(table: pa.Table) -> pa.Table:
    """For each block's fingerprints of one range: does another block hold them?"""
    blocks, ns, bodies = (table.column(c).to_pylist() for c in ("block", "n", "body"))
    sets = [from_gaps(b, k) for b, k in zip(bodies, ns, strict=True)]
    both = np.sort(np.concatenate(sets))
    twice = both[1:][both[1:] == both[:-1]]
    twice = twice[np.append(True, twice[1:] != twice[:-1])] if len(twice) else twice
    out = []
    for x in sets:
        at = np.minimum(np.searchsorted(twice, x), max(len(twice) - 1, 0))
        out.append(np.packbits(twice[at] == x if len(twice) else np.zeros(len(x), bool)).tobytes())
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": table.column("bucket"), "n": pa.array(ns, pa.int64()), "bits": pa.array(out, pa.binary())})


class _Prints:
    """Packed fingerprints of windows, for the exchange."""

    sent = "bucket int, block long, n long, body binary"
    reply = "block long, bucket int, n long, bits binary"
    resolve = staticmethod(_screen)

    def __init__(self, bits: int, ranges: int):
        self.bits, self.ranges = bits, ranges

    def merge(self, rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, of, many = np.unique(np.concatenate([from_gaps(r["body"], r["n"]) for r in rows]), return_inverse=True, return_counts=True)
        return keys, of, many

    def split(self, merged: tuple, bucket: int, wide: int) -> Iterator[tuple[int, dict]]:
        keys, every = merged[0], self.ranges * wide
        inner = np.array([(r << self.bits) // every for r in range(bucket * wide + 1, (bucket + 1) * wide)], np.uint64)
        cut = np.concatenate([[0], np.searchsorted(keys, inner), [len(keys)]]).tolist()
        for sub, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a:
                yield sub, {"n": pa.array([b - a], pa.int64()), "body": pa.array([to_gaps(keys[a:b])], pa.binary())}

    def answer(self, merged: tuple, rows: list[dict], replies: list[dict]) -> pa.Table:
        _, of, many = merged
        return _bits_back(rows, (_flags(replies) | (many > 1))[of])


def _flags(rows: list[dict]) -> np.ndarray:
    """The bits of replies, in their order."""
    return np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool) for r in rows]) if rows else np.zeros(0, bool)


def _bits_back(rows: list[dict], flag: np.ndarray) -> pa.Table:
    out, at = [], 0
    for r in rows:
        out.append(np.packbits(flag[at : at + r["n"]]).tobytes())
        at += r["n"]
    return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "n": pa.array([r["n"] for r in rows], pa.int64()), "bits": pa.array(out, pa.binary())})


def _groups_of(win: _Windows, at: np.ndarray, hot: list[np.ndarray], groups: int) -> np.ndarray:
    """The group of each suffix: by the shortest prefix that is not hot."""
    group = np.zeros(len(at), np.int64)
    left, acc = np.arange(len(at)), np.zeros(len(at), np.uint64)
    for depth in range(1, len(hot) + 2):
        acc = acc * U(_P) + win.h[at[left] + depth - 1]
        key = mix(acc + U(depth))
        group[left] = (mix(key) % U(groups)).astype(np.int64)
        if depth > len(hot) or not len(hot[depth - 1]):
            break
        on = hot[depth - 1]
        stay = on[np.minimum(np.searchsorted(on, key), len(on) - 1)] == key
        left, acc = left[stay], acc[stay]
        if not len(left):
            break
    return group


def _survivors(win: _Windows, block: int, path: str, bits: int) -> np.ndarray:
    """Distinct windows of a block that occur again, here or in another block."""
    rows = _blocks.table_of(path, block)
    kept = win.high > win.low
    if rows:
        back = _flags(rows)
        t = win.fp >> U(64 - bits)
        kept |= back[np.cumsum(np.append(0, t[1:] != t[:-1]))]
    return np.flatnonzero(kept)


def _symbols(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Suffixes by symbol (symbols, suffixes): the ``n`` words from each place, in order, as at most
    ``SYMBOLS`` hashes of 32 bits, so a path of ``n`` words has 128 bits."""
    cuts = np.linspace(0, n, min(SYMBOLS, n) + 1).astype(int).tolist()
    out = np.zeros((max(2, len(cuts) - 1), len(at)), np.uint32)
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        acc = np.zeros(len(at), np.uint64)
        for j in range(a, b):
            acc = mix(acc * U(_P) + h[at + j])
        out[k] = (acc >> U(32)).astype(np.uint32)
    return out


def _dealt(win: _Windows, at: np.ndarray, hot: list[np.ndarray], groups: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, edges, symbols): a block's suffixes by group and, within it, by their first two symbols."""
    group, text = _groups_of(win, at, hot, groups), _symbols(win.h, at, n)
    order = np.lexsort((text[1], text[0], group))
    return order, np.searchsorted(group[order], np.arange(groups + 1)), text


def _send_suffixes(n: int, bits: int, screen: str, hot, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = hot.value
        for block in _blocks.blocks(batches):
            win = _Windows(block, n)
            kept = _survivors(win, block.block, screen, bits)
            order, edges, text = _dealt(win, win.where[kept], prefixes, groups, n)
            for g in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[g] : edges[g + 1]]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([g], pa.int32()), "block": pa.array([block.block], pa.int64()), **_suffix_row(text[:, own], win.low[kept[own]], win.count[kept[own]])})

    return run


def _read_suffixes(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, low, count) of the suffixes of all rows."""
    columns, low, count = [], [], []
    for r in rows:
        head = from_gaps(r["head"], r["n"])
        rest = np.frombuffer(r["rest"], np.uint32).reshape(-1, r["n"])
        columns.append(np.concatenate([[(head >> U(32)).astype(np.uint32), head.astype(np.uint32)], rest]))
        low.append(from_plane(r["low"], r["n"], np.int64))
        count.append(from_plane(r["count"], r["n"], np.uint32))
    return np.concatenate(columns, axis=1), np.concatenate(low), np.concatenate(count)


def _suffix_row(text: np.ndarray, low: np.ndarray, count: np.ndarray) -> dict:
    """Suffixes in order of their first two symbols as columns of one row."""
    head = (text[0].astype(np.uint64) << U(32)) | text[1]
    return {
        "n": pa.array([len(low)], pa.int64()),
        "head": pa.array([to_gaps(head)], pa.binary()),
        "rest": pa.array([np.ascontiguousarray(text[2:]).tobytes()], pa.binary()),
        "low": pa.array([to_plane(low)], pa.binary()),
        "count": pa.array([to_plane(count.astype(np.uint32))], pa.binary()),
    }


class _Subtree:
    """Sorted suffixes of one group, cut at the wanted depth, and the symbols that neighbours share."""

    def __init__(self, table: pa.Table):
        rows = table.to_pylist()
        self.sizes = [(r["block"], r["n"]) for r in rows]
        self.text, self.low, self.count = _read_suffixes(rows)
        self.order = np.lexsort(self.text[::-1])
        same = np.ones(self.text.shape[1] - 1, bool)
        self.lcp = np.zeros(self.text.shape[1], np.int64)  # of a suffix and the one before it
        for row in self.text:
            row = row[self.order]
            same &= row[1:] == row[:-1]
            self.lcp[1:] += same

    def nodes(self, depth: int) -> np.ndarray:
        """Heads, in sorted order, of the internal nodes and leaves under the cut at ``depth`` symbols."""
        return np.flatnonzero(self.lcp < depth)


def _resolve(table: pa.Table) -> pa.Table:
    tree = _Subtree(table)
    heads = tree.nodes(len(tree.text))
    low = tree.low[tree.order]
    least = np.minimum.reduceat(low, heads)
    flag = np.empty(len(low), bool)
    flag[tree.order] = np.repeat(least, np.diff(np.append(heads, len(low)))) < low
    out, at = [], 0
    for _, k in tree.sizes:
        out.append(np.packbits(flag[at : at + k]).tobytes())
        at += k
    return pa.table({"block": pa.array([b for b, _ in tree.sizes], pa.int64()), "bucket": table.column("bucket"), "n": pa.array([k for _, k in tree.sizes], pa.int64()), "bits": pa.array(out, pa.binary())})


class _Suffixes:
    """Packed suffixes, for the exchange. A bucket's parts hold longer prefixes: the first two symbols."""

    sent = "bucket int, block long, n long, head binary, rest binary, low binary, count binary"
    reply = "block long, bucket int, n long, bits binary"
    resolve = staticmethod(_resolve)

    def merge(self, rows: list[dict]) -> tuple[np.ndarray, ...]:
        text, low, count = _read_suffixes(rows)
        order = np.lexsort(text[::-1])
        ranked = text[:, order]
        new = np.append(True, (ranked[:, 1:] != ranked[:, :-1]).any(axis=0))
        heads, of = np.flatnonzero(new), np.empty(len(low), np.int64)
        of[order] = np.cumsum(new) - 1
        return ranked[:, heads], np.minimum.reduceat(low[order], heads), np.add.reduceat(count[order].astype(np.int64), heads), of, low

    def _dealt(self, text: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        sub = (mix((text[0].astype(np.uint64) << U(32)) | text[1]) % U(wide)).astype(np.int64)
        order = np.lexsort((text[1], text[0], sub))
        return order, np.searchsorted(sub[order], np.arange(wide + 1))

    def split(self, merged: tuple, bucket: int, wide: int) -> Iterator[tuple[int, dict]]:
        text, low, count, *_ = merged
        order, edges = self._dealt(text, wide)
        for sub in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[sub] : edges[sub + 1]]
            yield sub, _suffix_row(text[:, own], low[own], np.minimum(count[own], np.iinfo(np.uint32).max))

    def answer(self, merged: tuple, rows: list[dict], replies: list[dict]) -> pa.Table:
        text, low, _, of, own = merged
        order, _ = self._dealt(text, self.wide)
        below = np.empty(len(low), bool)
        below[order] = _flags(replies)
        return _bits_back(rows, below[of] | (own > low[of]))

    def __init__(self, wide: int):
        self.wide = wide


def _cut(n: int, bits: int, screen: str, marks: str, hot, groups: int, names: list[str] | None, at_text: int):
    """Removal. ``names``: give the rows of the input with these columns, else the report."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = hot.value
        for block in _blocks.blocks(batches):
            win = _Windows(block, n)
            kept = _survivors(win, block.block, screen, bits)
            below = np.zeros(len(win.fp), bool)  # a smaller doc_id elsewhere
            rows = _blocks.table_of(marks, block.block)
            if rows:
                order, _, _ = _dealt(win, win.where[kept], prefixes, groups, n)
                below[kept[order]] = _flags(rows)
            hit = below[win.cls] | (win.low[win.cls] < win.id)
            delta = np.zeros(len(win.h) + 1, np.int32)
            at = win.at[hit]
            np.add.at(delta, at, 1)
            np.add.at(delta, at + n, -1)
            gone = np.cumsum(delta[:-1]) > 0
            removed = np.add.reduceat(np.append(gone, 0).astype(np.int64), win.first[:-1]) * (np.diff(win.first) > 0)
            raw = block.data.tobytes()
            others = block.carried() if names else None
            for lo in range(0, block.n, 512):
                hi = min(lo + 512, block.n)
                texts, spans = [], []
                for i in range(lo, hi):
                    own = raw[block.offsets[i] : block.offsets[i + 1]]
                    spans.append([])
                    if removed[i]:
                        mask = gone[win.first[i] : win.first[i + 1]]
                        own = b" ".join([w for w, x in zip(own.split(), mask.tolist(), strict=True) if not x])
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                        spans[-1] = [{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]
                    elif not names:
                        own = b" ".join(own.split())
                    texts.append(own)
                if names:
                    part = others.slice(lo, hi - lo).combine_chunks()
                    text = pa.array(texts, pa.binary(), mask=part.column("no_text").to_numpy()).cast(pa.string())
                    columns = part.drop_columns("no_text").columns
                    yield pa.Table.from_arrays([*columns[:at_text], text, *columns[at_text:], pa.array(removed[lo:hi], pa.int64())], names).combine_chunks().to_batches()[0]
                else:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": block.id_column(slice(lo, hi)),
                            "n_words": pa.array(np.diff(win.first)[lo:hi], pa.int64()),
                            "n_removed": pa.array(removed[lo:hi], pa.int64()),
                            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                            "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
                        }
                    )

    return run


_REPORT = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, group_suffixes: int = GROUP_SUFFIXES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row of ``docs``: doc_id, n_words, n_removed, removed (spans of words, end excluded) and
    kept_text (kept words joined by one space). See the module's text for the method."""
    return _run(docs, id_col, text_col, min_words, group_suffixes, block_bytes, False)


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, group_suffixes: int = GROUP_SUFFIXES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` with all their columns and n_removed. A text that loses words is its
    kept words joined by one space; other texts stay as they are."""
    return _run(docs, id_col, text_col, min_words, group_suffixes, block_bytes, True)


def _run(docs: DataFrame, id_col: str, text_col: str, min_words: int, group_suffixes: int, block_bytes: int, whole: bool, fan: int = FAN, range_windows: int = RANGE_WINDOWS, run_items: int = RUN_ITEMS) -> DataFrame:
    spark = docs.sparkSession
    staged = _blocks.stage(docs, id_col, text_col, block_bytes, whole)
    table = _blocks.read(spark, staged)
    total, n_blocks = table.select(F.coalesce(F.sum(F.length("data")), F.lit(0)), F.count(F.lit(1))).first()
    upper = total // 2 + 1  # a word and a space at least
    ranges, bits = fan, _bits_for(upper)
    least = max(2, group_suffixes // (2 * max(1, n_blocks)))  # all that blocks leave out of a prefix is half a group at most
    bare = table.drop("carry")
    sent = _shared.write(bare.mapInArrow(_send_windows(min_words, bits, ranges, least), "bucket int, block long, n long, key long, body binary"), _shared.scratch(spark, "windows"), large_rows=True)
    rows = spark.read.schema("bucket int, block long, n long, key long, body binary").parquet(sent)
    found = rows.where("bucket = -1").groupBy(F.col("block").alias("depth"), "key").agg(F.sum("n").alias("n")).where(F.col("n") > group_suffixes // 2).collect()  # at most 2 * min_words * windows / group_suffixes
    hot = [np.sort(np.array([r["key"] for r in found if r["depth"] == d], np.int64).view(np.uint64)) for d in range(1, max([0, *(r["depth"] for r in found)]) + 1)]
    prefixes = spark.sparkContext.broadcast(hot)
    screen = exchange(rows.where("bucket >= 0").drop("key"), _Prints(bits, ranges), parts(upper, range_windows, fan), "screen", run_items)
    _shared.drop(spark, sent)
    alive = rows_alive(spark, screen, _Prints.reply)
    groups, wide = fan, parts(alive, group_suffixes, fan)
    suffixes = bare.mapInArrow(_send_suffixes(min_words, bits, screen, prefixes, groups), _Suffixes.sent)
    marks = exchange(suffixes, _Suffixes(wide), wide, "marks", run_items)
    names, at_text, schema = None, 0, _REPORT
    if whole:
        at_text = docs.columns.index(text_col)
        names = [f"c{i}" for i in range(len(docs.columns))] + ["n_removed"]
        schema = ", ".join([*(f"c{i} {'string' if i == at_text else kind}" for i, (_, kind) in enumerate(docs.dtypes)), "n_removed long"])
    out = (table if whole else bare).mapInArrow(_cut(min_words, bits, screen, marks, prefixes, groups, names, at_text), schema)
    if whole:
        out = out.toDF(*docs.columns, "n_removed")
    return _shared.keep(out, "kept", staged, screen, marks, large_rows=True)


def rows_alive(spark, screen: str, schema: str) -> int:
    """Windows that passed the screen, over all blocks."""
    rows = spark.read.schema(schema).parquet(screen)
    count = lambda it: (pa.RecordBatch.from_pydict({"n": pa.array([sum(int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in b.column(0).to_pylist())], pa.int64())}) for b in it)
    return rows.select("bits").mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def removed_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, **sizes) -> DataFrame:
    """The removed passages with their places: doc_id, start, end (in words), n_words. A passage is a
    run of removed words; two repeats that touch or overlap are one passage."""
    kept = remove_repeats(docs, id_col, text_col, min_words, **sizes)
    return kept.select("doc_id", F.explode("removed").alias("r")).select("doc_id", F.col("r.start").alias("start"), F.col("r.end").alias("end"), (F.col("r.end") - F.col("r.start")).alias("n_words"))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
win AS (SELECT doc_id, p, array_to_string(a[p:p + 12], ' ') AS g
        FROM (SELECT doc_id, a, unnest(range(1, len(a) - 11)) AS p FROM w WHERE len(a) >= 13)),
low AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT win.doc_id, p + d AS q
        FROM win JOIN low USING (g) CROSS JOIN (SELECT unnest(range(0, 13)) AS d) WHERE least < win.doc_id),
word AS (SELECT doc_id, unnest(a) AS word, unnest(range(1, len(a) + 1)) AS q FROM w),
kept AS (SELECT word.doc_id, string_agg(word.word, ' ' ORDER BY word.q) AS t, count(*) AS n
         FROM word ANTI JOIN hit ON word.doc_id = hit.doc_id AND word.q = hit.q GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(w.a) AS BIGINT) AS n_words,
       CAST(len(w.a) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
