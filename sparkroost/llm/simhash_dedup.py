"""SimHash near-dedup through an inverted index on byte positions with count filtering.

Texts are lower-cased (A-Z only), cut into words and shingles; a fingerprint bit is 1 if more than
half of the shingles' XXH64 have it. Fingerprints link at ``MAX_BITS`` (2) differing bits or fewer.

Two linked fingerprints differ in at most two of their eight bytes, so they agree in at least six
(byte, position) pairs: the guaranteed minimum. The index has a posting list for each pair of
two-byte fields with their bytes (six lists for a fingerprint); of two fields pairs that agree in
six bytes, at least one is whole. Candidates of a list are tallied: shared positional bytes are
counted for each pair, pairs below six go, the rest are verified by their differing bits.

Equal fingerprints are one entry from the start (a group of copies is one row however large it
is). A posting list over ``LIST_ROWS`` entries is not tallied pair by pair: its entries move to
lists on six whole bytes, of which one holds at most 65,536 different fingerprints, and each entry
looks up its 136 neighbours there. Only a spanning forest of each task's links leaves it.

Defined results: a null or empty text has fingerprint zero, linked like any other; a text of fewer
words than a shingle is one shingle; a null id takes no part in naming a component, and rows with
null id alone form a component with a null id; repeated ids keep a row each; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import _shared
from .components import components

SHINGLE, SEED, MAX_BITS, LIST_ROWS = 3, 42, 2, 512
#: Entries of the index for each task.
TASK_ROWS = 2_000_000
#: Positions (of 8) that make a key of the first index: pairs of two-byte fields.
FIELDS = [(2 * i, 2 * i + 1, 2 * j, 2 * j + 1) for i, j in combinations(range(4), 2)]
#: And of the second index, for entries of long lists: any six bytes.
SIXES = list(combinations(range(8), 6))
_NEAR = np.array([0] + [1 << i for i in range(16)] + [(1 << i) | (1 << j) for i, j in combinations(range(16), 2)], np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    own = text.lower().split()  # bytes: A-Z, and the six white-space bytes
    if not own:
        return 0
    k, digest = min(shingle, len(own)), xxhash.xxh64_intdigest
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.append(0, ends[: len(own) - k] + 1)
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            fp = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in text], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): each row's fingerprint, as a signed long with the same 64 bits."""
    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _bytes_key(fp: Column, at: tuple[int, ...]) -> Column:
    mask = sum(255 << (8 * i) for i in at)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _index(prints: DataFrame, keys: list[tuple[int, ...]]) -> DataFrame:
    lists = F.array(*[F.struct(F.lit(i).alias("list"), _bytes_key(F.col("fp"), at).alias("key")) for i, at in enumerate(keys)])
    return prints.select("fp", "low", F.explode(lists).alias("x")).select("x.list", "x.key", "fp", "low")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _bytes_shared(x: np.ndarray) -> np.ndarray:
    """Positional bytes that agree, of two fingerprints whose exclusive or is ``x``."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


class _Forest:
    """Links within a task; only the links of a spanning forest are passed on."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.root(x), self.root(y)
            if i != j:
                self.up[max(i, j)] = min(i, j)
                self.links.append((x, y))


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    held = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("list", "key", "fp", "low")) for b in batches]
    if not held:
        return (np.zeros(0, np.int64),) * 4
    which, key, fp, low = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((low, key, which))
    return which[order], key[order], fp[order].view(np.uint64), low[order]


def _emit(forest: _Forest) -> Iterator[pa.RecordBatch]:
    a, b = zip(*forest.links, strict=True) if forest.links else ((), ())
    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    which, key, fp, low = _read(batches)
    forest, step = _Forest(), 1
    at = np.arange(len(fp) - 1) if len(fp) else np.zeros(0, np.int64)
    while len(at):  # pairs `step` apart in one list
        at = at[at + step < len(fp)]
        at = at[(which[at] == which[at + step]) & (key[at] == key[at + step])]
        x = fp[at] ^ fp[at + step]
        met = np.flatnonzero(_bytes_shared(x) >= 8 - MAX_BITS)
        met = met[_bits(x[met]) <= MAX_BITS]
        forest.add(low[at[met]], low[at[met] + step])
        step += 1
    yield from _emit(forest)


def _squeeze(fp: np.ndarray, at: tuple[int, ...]) -> np.ndarray:
    i, j = (k for k in range(8) if k not in at)
    own = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)
    return own[:, i].astype(np.int64) | (own[:, j].astype(np.int64) << 8)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    which, key, fp, low = _read(batches)
    forest = _Forest()
    edge = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (key[1:] != key[:-1]))) if len(fp) else np.zeros(0, int)
    place = np.full(1 << 16, -1, np.int64)
    for a, b in zip(edge.tolist(), np.append(edge[1:], len(fp)).tolist(), strict=True):
        if b - a > 1:
            rest = _squeeze(fp[a:b], SIXES[which[a]])
            place[rest] = np.arange(a, b)
            for near in _NEAR[1:]:
                met = place[rest ^ near]
                ok = met > np.arange(a, b)
                forest.add(low[a:b][ok], low[met[ok]])
            place[rest] = -1
    yield from _emit(forest)


def links(prints: DataFrame, list_rows: int = LIST_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``MAX_BITS`` bits.

    ``prints``: (fp, low), each fingerprint once, ``low`` being its representative id.
    """
    conf = prints.sparkSession.conf
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), len(FIELDS) * prints.count() // task_rows)
    index = _index(prints, FIELDS)
    size = index.groupBy("list", "key").agg(F.count(F.lit(1)).alias("size"))
    busy = size.where(F.col("size") > list_rows).select("list", "key")
    short = index.join(busy, ["list", "key"], "left_anti")
    again = _index(index.join(busy, ["list", "key"], "left_semi").select("fp", "low").distinct(), SIXES)
    kind = "a long, b long"
    met = short.repartition(parts, "list", "key").mapInArrow(_tally, kind)
    return met.union(again.repartition(parts, "list", "key").mapInArrow(_probe, kind))


def candidates(prints: DataFrame) -> DataFrame:
    """(centre, other): pairs of ids that connect all rows of ``prints`` (doc_id, fp) whose fingerprints link."""
    once = _shared.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    same = prints.join(once, "fp").where("doc_id <> low").select(F.col("low").alias("centre"), F.col("doc_id").alias("other"))
    return links(once).select(F.least("a", "b").alias("centre"), F.greatest("a", "b").alias("other")).union(same)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_rows: int = LIST_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``. component_id is the
    smallest id that the row's fingerprint reaches through links; rows without an id link like others, and have
    null only where no row that they reach has one."""
    prints = _shared.keep(fingerprints(docs, id_col, text_col), "prints")
    once = _shared.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    held = _shared.keep(components(links(once.select("fp", F.col("fp").alias("low")), list_rows)), "components")
    classes = once.join(held, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(lowest, "root").select(F.col("fp").alias("of"), "component_id")
    out = prints.join(named, F.col("fp") == F.col("of"), "left")
    out = out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return _shared.keep(out, "near", *_shared.paths(prints, once, held))


def op3_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
