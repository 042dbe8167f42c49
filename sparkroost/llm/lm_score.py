"""Language-model scoring: stupid backoff over relational n-gram counts.

Count tables of all n-grams (orders 1 to 3) of all texts are partitioned by hash; every block of
texts joins its exploded n-grams to them, and the scores are summed for each document:

    S(w | u v) = c(u v w) / c(u v)             if c(u v w) >= MIN_COUNT
               = 0.4 c(v w) / c(v)             else, if c(v w) >= MIN_COUNT
               = 0.16 c(w) / N                 else

A document's first word has the unigram score c / N, its second begins at the bigram. N: words of
all texts. Rows of the tables are packed: a block sends its distinct n-grams of one range of hashes
with their counts as one row (gaps of a sorted set), so an n-gram that is a tenth of the corpus
comes once from each block, and counts are summed before and after the shuffle. Back comes the total
of each n-gram that the block sent, with those below ``MIN_COUNT`` as a bit alone. Words and word pairs
go first. A triple occurs ``MIN_COUNT`` times only if both of its pairs do, so the other triples, which
can't be scored at their order, need not be sent.

n-grams are identified by 64 bits of hash. Defined results: a null or empty text has no words and
score 0 with a null mean; repeated and null ids keep a row each; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _blocks, _shared
from ._exchange import FAN, RUN_ITEMS, exchange, parts
from ._words import U, from_gaps, from_plane, grams, to_gaps, to_plane, words

ORDER, MIN_COUNT, BACKOFF, BITS = 3, 2, 0.4, 64
#: Orders that are counted together, each set after the one before it.
TRIPS = ((1, 2), (3,))
#: Words of the corpus in one range of hashes, about.
RANGE_WORDS = 2_000_000


class _Grams:
    """Distinct n-grams of a block: hashes, counts and, for each place, its n-gram's number."""

    def __init__(self, h: np.ndarray, first: np.ndarray, n: int):
        fp, self.at = grams(h, first, n)
        order = np.argsort(fp, kind="stable")
        ranked = fp[order]
        new = np.append(True, ranked[1:] != ranked[:-1]) if len(fp) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        self.fp, self.count = ranked[heads], np.diff(np.append(heads, len(fp)))
        self.of = np.empty(len(fp), np.int64)
        self.of[order] = np.cumsum(new) - 1


    def often(self, counts: np.ndarray) -> np.ndarray:
        """Which n-grams can occur ``MIN_COUNT`` times; ``counts``: of the (n - 1)-gram at each word."""
        out = np.zeros(len(self.fp), bool)
        out[self.of[(counts[self.at] >= MIN_COUNT) & (counts[self.at + 1] >= MIN_COUNT)]] = True
        return out


@functools.lru_cache(maxsize=8)
def _edges(ranges: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Where the ranges of hashes from ``first`` to ``last`` end, but for the last one's end."""
    return np.array([(r << BITS) // ranges for r in range(first + 1, ranges if last is None else last)], np.uint64)


def _send(ranges: int, orders: tuple[int, ...], before: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks.blocks(batches):
            _, _, first, h = words(block.data, block.offsets)
            for n in orders:
                own = _Grams(h, first, n)
                fp, count = own.fp, own.count
                if before:
                    sent = own.often(_counts(h, first, n - 1, _blocks.table_of(before, block.block), ranges))
                    fp, count = fp[sent], count[sent]
                cut = np.concatenate([[0], np.searchsorted(fp, _edges(ranges)), [len(fp)]])
                rows = [(n * ranges + r, int(b - a), to_gaps(fp[a:b]), to_plane(count[a:b].astype(np.int64))) for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                bucket, k, keys, counts = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "block": pa.array([block.block] * len(rows), pa.int64()), "n": pa.array(k, pa.int64()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


def _join(table: pa.Table) -> pa.Table:
    """One range of a count table, joined to the n-grams that each block sent of it."""
    ns = table.column("n").to_pylist()
    sets = [from_gaps(b, n) for b, n in zip(table.column("keys").to_pylist(), ns, strict=True)]
    counts = np.concatenate([from_plane(b, n, np.int64) for b, n in zip(table.column("counts").to_pylist(), ns, strict=True)])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    total = np.empty(len(every), np.int64)
    total[order] = np.repeat(np.add.reduceat(counts[order], heads), np.diff(np.append(heads, len(every))))
    return _reply(table.column("block"), table.column("bucket"), ns, total)


def _reply(block, bucket, ns: list[int], total: np.ndarray) -> pa.Table:
    bits, totals, at = [], [], 0
    for n in ns:
        own = total[at : at + n]
        bits.append(np.packbits(own >= MIN_COUNT).tobytes())
        totals.append(to_plane(own[own >= MIN_COUNT]))
        at += n
    return pa.table({"block": block, "bucket": bucket, "n": pa.array(ns, pa.int64()), "bits": pa.array(bits, pa.binary()), "totals": pa.array(totals, pa.binary())})


class _Counts:
    """Packed n-grams with their counts, for the exchange."""

    sent = "bucket int, block long, n long, keys binary, counts binary"
    reply = "block long, bucket int, n long, bits binary, totals binary"

    def __init__(self, ranges: int):
        self.ranges = ranges

    resolve = staticmethod(_join)

    def merge(self, rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, of = np.unique(np.concatenate([from_gaps(r["keys"], r["n"]) for r in rows]), return_inverse=True)
        counts = np.concatenate([from_plane(r["counts"], r["n"], np.int64) for r in rows])
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, of, counts)
        return keys, total, of

    def split(self, merged: tuple, bucket: int, wide: int) -> Iterator[tuple[int, dict]]:
        keys, total, _ = merged
        first = bucket % self.ranges * wide
        cut = np.concatenate([[0], np.searchsorted(keys, _edges(self.ranges * wide, first, first + wide)), [len(keys)]]).tolist()
        for sub, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a:
                yield sub, {"n": pa.array([b - a], pa.int64()), "keys": pa.array([to_gaps(keys[a:b])], pa.binary()), "counts": pa.array([to_plane(total[a:b])], pa.binary())}

    def answer(self, merged: tuple, rows: list[dict], replies: list[dict]) -> pa.Table:
        total = _unpack(replies)[merged[2]]
        return _reply(pa.array([r["block"] for r in rows], pa.int64()), pa.array([r["bucket"] for r in rows], pa.int32()), [r["n"] for r in rows], total)


def _totals(rows: list[dict], n: int, ranges: int) -> np.ndarray:
    """Totals of a block's distinct n-grams of order ``n``, in the order sent; 1 where below 2."""
    return _unpack([r for r in rows if r["bucket"] // ranges == n])


def _unpack(rows: list[dict]) -> np.ndarray:
    out = []
    for r in rows:
        part = np.ones(r["n"], np.int64)
        often = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool)
        part[often] = from_plane(r["totals"], int(often.sum()), np.int64)
        out.append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _counts(h: np.ndarray, first: np.ndarray, n: int, rows: list[dict], ranges: int, sent: np.ndarray | None = None) -> np.ndarray:
    """The total of the n-gram that begins at each word; 0 where none does or it wasn't sent.
    ``sent``: the totals of the order below, by which n-grams were left out."""
    own, out = _Grams(h, first, n), np.zeros(len(h), np.int64)
    totals = _totals(rows, n, ranges)
    if sent is not None:
        some = np.flatnonzero(own.often(sent))
        every = np.zeros(len(own.fp), np.int64)
        every[some] = totals
        totals = every
    out[own.at] = totals[own.of]
    return out


def _score(joined: list[str], ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks.blocks(batches):
            _, _, first, h = words(block.data, block.offsets)
            count = np.zeros((ORDER + 1, len(h)), np.int64)  # of the n-gram that begins at each word
            for path, orders in zip(joined, TRIPS, strict=True):
                rows = _blocks.table_of(path, block.block)
                for n in orders:
                    count[n] = _counts(h, first, n, rows, ranges, count[n - 1] if path != joined[0] else None)
            place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
            log, level = np.zeros(len(h)), np.zeros(len(h), np.int64)
            for n in range(ORDER, 1, -1):
                at = np.flatnonzero((level == 0) & (place >= n - 1))
                at = at[count[n][at - n + 1] >= MIN_COUNT]
                top = np.minimum(place[at] + 1, ORDER)
                log[at] = np.log10(count[n][at - n + 1] / count[n - 1][at - n + 1]) + (top - n) * np.log10(BACKOFF)
                level[at] = n
            at = np.flatnonzero(level == 0)
            log[at] = np.log10(count[1][at]) + (np.minimum(place[at] + 1, ORDER) - 1) * np.log10(BACKOFF)  # less log10 N
            sums = lambda x: np.add.reduceat(np.append(x, 0), first[:-1]) * (np.diff(first) > 0)
            yield pa.RecordBatch.from_pydict({"doc_id": block.id_column(), "n_words": pa.array(np.diff(first), pa.int64()), "log": pa.array(sums(log), pa.float64()), "n_single": pa.array(sums((level == 0).astype(np.int64)), pa.int64()), "n_full": pa.array(sums((level == ORDER).astype(np.int64)), pa.int64())})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = _blocks.BLOCK_BYTES, fan: int = FAN, range_words: int = RANGE_WORDS, run_items: int = RUN_ITEMS) -> DataFrame:
    """(doc_id, n_words, n_full, log10_score, mean_log10) for each row: n_full counts words scored
    at the highest order, log10_score is the sum of the words' log10 S."""
    spark = docs.sparkSession
    staged = _blocks.stage(docs, id_col, text_col, block_bytes)
    table = _blocks.read(spark, staged)
    total = table.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    joined: list[str] = []
    for orders in TRIPS:
        sent = table.mapInArrow(_send(fan, orders, joined[-1] if joined else None), _Counts.sent)
        joined.append(exchange(sent, _Counts(fan), parts(total // 2, range_words, fan), "counts", run_items))
    out = _shared.keep(table.mapInArrow(_score(joined, fan), "doc_id long, n_words long, log double, n_single long, n_full long"), "scores", staged, *joined, large_rows=True)
    n = out.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    whole = F.col("log") - F.col("n_single") * F.lit(float(np.log10(max(n, 1))))
    return out.select("doc_id", "n_words", "n_full", whole.alias("log10_score"), F.when(F.col("n_words") > 0, whole / F.col("n_words")).alias("mean_log10"))


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_full", F.round("log10_score", 4).alias("log10_score"), F.round("mean_log10", 6).alias("mean_log10"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
t AS (SELECT doc_id, a[i] AS w, CASE WHEN i > 1 THEN a[i - 1] END AS v, CASE WHEN i > 2 THEN a[i - 2] END AS u, i
      FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM d)),
c1 AS (SELECT w, count(*) AS n FROM t GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, count(*) AS n FROM t WHERE u IS NOT NULL GROUP BY u, v, w),
total AS (SELECT count(*) AS n FROM t),
s AS (SELECT t.doc_id,
        CASE WHEN c3.n >= 2 THEN 3 WHEN b.n >= 2 THEN 2 ELSE 1 END AS lvl,
        CASE WHEN c3.n >= 2 THEN log10(c3.n / p2.n)
             WHEN b.n >= 2 THEN log10(b.n / p1.n) + (least(t.i, 3) - 2) * log10(0.4)
             ELSE log10(c1.n / total.n) + (least(t.i, 3) - 1) * log10(0.4) END AS l
      FROM t CROSS JOIN total JOIN c1 ON c1.w = t.w
      LEFT JOIN c2 b ON b.v = t.v AND b.w = t.w LEFT JOIN c1 p1 ON p1.w = t.v
      LEFT JOIN c3 ON c3.u = t.u AND c3.v = t.v AND c3.w = t.w LEFT JOIN c2 p2 ON p2.v = t.u AND p2.w = t.v)
SELECT d.doc_id, CAST(len(d.a) AS BIGINT) AS n_words, CAST(count(*) FILTER (s.lvl = 3) AS BIGINT) AS n_full,
       round(coalesce(sum(s.l), 0), 4) AS log10_score, round(sum(s.l) / nullif(len(d.a), 0), 6) AS mean_log10
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, d.a
"""
