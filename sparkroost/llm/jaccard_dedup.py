"""Near-dedup by exact Jaccard similarity of five-word shingles, through an index on set prefixes.

A text (A-Z lower-cased, cut at white space) is the set of its shingles' 64-bit hashes. Texts link
if their sets have a Jaccard similarity of ``SIMILARITY`` or more. Links are complete and exact:

1. All shingles are counted in ``SLOTS`` counters, which give one order of all hashes: rare slots
   first. (Any order gives the same links; this one keeps common lines out of the prefixes.)
2. Two sets of similarity t share an element among the first n - ceil(t n) + 1 of each, in that
   order. Texts are posted under those; lists of one text go. A pair is a candidate in the list
   of its first common element only if sizes and what follows there leave room for t.
3. In each list the text that shares most postings with others (the likely original of a group) is
   compared with the rest, and so are neighbours in a random order. What links is joined to
   components. Then all candidates of a list that lie in different components are compared: a large
   group of copies isn't compared pair by pair. A pair whose parity sketches (``SKETCH`` bits, of the
   whole sets) differ in more bits than two linked sets may have elements apart is left out before
   the comparison; the sketch never differs in more bits than the sets do in elements.
4. Comparison: one set of each pair is a centre. Its members are sent to it, a centre of more than
   ``SALT`` members is sent to several tasks, and a task holds one centre's set at a time.

Equal sets are one entry. Defined results: null and empty texts have the empty set and are one
group; a text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _shared, simhash_dedup
from ._words import U, _P, grams, mix, pack, words
from .components import components

SHINGLE, SIMILARITY, SLOTS, SKETCH, SALT = 5, (4, 5), 1 << 18, 512, 2048
#: Shingles of the corpus for each task that reads lists; about a fifth of them are posted.
TASK_SHINGLES = 1 << 24
_CHUNK = 1 << 14


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's set: its shingles' hashes, ascending, each once."""
    _, _, first, h = words(*pack(column), lower=True)
    g, at = grams(h, first, SHINGLE)
    cut = np.searchsorted(at, first)
    for i in range(len(first) - 1):
        n = int(first[i + 1] - first[i])
        if 0 < n < SHINGLE:
            yield grams(h[first[i] : first[i + 1]], np.array([0, n]), n)[0]
        else:
            yield np.unique(g[cut[i] : cut[i + 1]])


def signature(own: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int((mix(mix(own + U(_P)).sum(dtype=np.uint64) + U(len(own)))).view(np.int64)) if len(own) else 0


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    up, down = SIMILARITY
    both = len(np.intersect1d(a, b, assume_unique=True))
    return down * both >= up * (len(a) + len(b) - both)


def sketch(own: np.ndarray) -> bytes:
    """For each of ``SKETCH`` bins, whether the set has an odd number of elements in it."""
    at = (mix(own ^ U(_P)) % U(SKETCH)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=SKETCH).astype(np.uint8) & 1).tobytes()


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sig, sketch) of each row; at the end the task's counters, with a null key."""
    count = np.zeros(SLOTS, np.int64)
    names = ["key", "sig", "sketch", "chunk", "body"]
    for batch in _shared.parts(batches):
        sig, drawn = [], []
        for own in sets(batch.column(1)):
            sig.append(signature(own))
            drawn.append(sketch(own))
            np.add.at(count, (own % U(SLOTS)).astype(np.int64), 1)
        n = len(sig)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.int64()), pa.array(drawn, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
    at = [a for a in range(0, SLOTS, _CHUNK) if count[a : a + _CHUNK].any()]
    none = pa.nulls(len(at), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(at), pa.binary()), pa.array([a // _CHUNK for a in at], pa.int32()), pa.array([count[a : a + _CHUNK].tobytes() for a in at], pa.binary())], names)


def _add(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b, np.int64) for b in table.column("body").to_pylist()], axis=0)
    return pa.table({"chunk": table.column("chunk")[:1].cast(pa.int32()), "body": pa.array([total.tobytes()], pa.binary())})


def _post(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, (up, down) = held.value, SIMILARITY
        for batch in _shared.parts(batches):
            out = []
            for own in sets(batch.column(0)):
                n = len(own)
                take = n - -(-up * n // down) + 1 if n else 0
                order = np.lexsort((own, count[(own % U(SLOTS)).astype(np.int64)]))[:take]
                out.append((own[order], np.full(take, signature(own), np.int64), np.full(take, n, np.int32), np.arange(take, dtype=np.int32)))
            h, sig, n, pos = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sig), pa.array(n, pa.int32()), pa.array(pos, pa.int32())], ["h", "sig", "n", "pos"])

    return run


_POSTING = "h long, sig long, n int, pos int"
_LISTED = "h long, sig long, n int, pos int, size int"


def _read(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    held = [[b.column(c).to_numpy(zero_copy_only=False) for c in names] for b in batches]
    return [np.concatenate(x) for x in zip(*held, strict=True)] if held else [np.zeros(0, np.int64)] * len(names)


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of at least two different sets, equal sets once, and how many sets each list has."""
    h, sig, n, pos = _read(batches, ["h", "sig", "n", "pos"])
    order = np.lexsort((sig, h))
    h, sig = h[order], sig[order]
    once = np.append(True, (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]))[: len(h)]
    h, sig, order = h[once], sig[once], order[once]
    heads = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
    many = np.diff(np.append(heads, len(h)))
    size = np.repeat(many, many)
    at = np.flatnonzero(size > 1)
    for a in range(0, len(at), 1 << 16):
        o = at[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(h[o]), pa.array(sig[o]), pa.array(n[order[o]].astype(np.int32)), pa.array(pos[order[o]].astype(np.int32)), pa.array(size[o].astype(np.int32))], ["h", "sig", "n", "pos", "size"])


def _room(n: np.ndarray, pos: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """May x and y be similar, if this list's element is the first that they share?"""
    up, down = SIMILARITY
    most = np.minimum(n[x] - pos[x], n[y] - pos[y])
    return (down * np.minimum(n[x], n[y]) >= up * np.maximum(n[x], n[y])) & ((up + down) * most >= up * (n[x] + n[y]))


def _pairs_out(centre: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    """Pairs without those that repeat in this batch."""
    order = np.lexsort((other, centre))
    a, b = centre[order], other[order]
    once = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], ["centre", "other"])


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each list: the set of the highest degree with all others, and neighbours in a random order."""
    h, sig, n, pos, degree = _read(batches, ["h", "sig", "n", "pos", "degree"])
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    order = np.lexsort((sig, -degree, h))
    heads = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1])[: len(h)])
    centre = np.repeat(order[heads], np.diff(np.append(heads, len(h))))
    ok = (centre != order) & _room(n, pos, centre, order)
    seed = mix(sig.view(np.uint64) ^ U(_P))
    near = np.lexsort((seed, np.log2(np.maximum(n, 1)) // 0.3, h))
    x, y = near[:-1], near[1:]
    by = (h[x] == h[y]) & _room(n, pos, x, y)
    x, y = x[by], y[by]
    swap = degree[x] < degree[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    yield _pairs_out(sig[np.append(centre[ok], x)], sig[np.append(order[ok], y)])


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists with more than one component."""
    names = ["h", "sig", "n", "pos", "degree", "of"]
    held = _read(batches, names)
    order = np.lexsort((held[5], held[0]))
    h, of = held[0][order], held[5][order]
    if len(h):
        heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        last = np.append(heads[1:], len(h)) - 1
        order = order[np.repeat(of[heads] != of[last], last - heads + 1)]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    for a in range(0, len(order), 1 << 16):
        o = order[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(x[o], k) for x, k in zip(held, kinds, strict=True)], names)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All candidates of a list that lie in different components and whose sketches leave room."""
    up, down = SIMILARITY
    held = list(batches)
    if not held:
        return
    h, sig, n, pos, degree, of = _read(iter(held), ["h", "sig", "n", "pos", "degree", "of"])
    drawn = np.concatenate([np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint64).reshape(b.num_rows, SKETCH // 64) for b in held])
    order = np.lexsort((sig, n, h))
    h, sig, n, pos, degree, of, drawn = h[order], sig[order], n[order].astype(np.int64), pos[order].astype(np.int64), degree[order], of[order], drawn[order]
    at, step = np.arange(max(len(h) - 1, 0)), 1
    out, many = [], 0
    while len(at):  # pairs `step` apart in one list, which is in order of size
        at = at[at + step < len(h)]
        at = at[(h[at] == h[at + step]) & (down * n[at] >= up * n[at + step])]
        met = at[(of[at] != of[at + step]) & _room(n, pos, at, at + step)]
        apart = np.bitwise_count(drawn[met] ^ drawn[met + step]).sum(axis=1, dtype=np.int64)
        met = met[(up + down) * apart <= (down - up) * (n[met] + n[met + step])]
        if len(met):
            swap = degree[met] < degree[met + step]
            out.append((sig[np.where(swap, met + step, met)], sig[np.where(swap, met, met + step)]))
            many += len(met)
        if many >= 1 << 18:
            yield _pairs_out(*(np.concatenate(x) for x in zip(*out, strict=True)))
            out, many = [], 0
        step += 1
    if out:
        yield _pairs_out(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets(batch.column(1))], pa.binary())], ["sig", "body"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (centre, salt), the centre's own first: the pairs that link."""
    at, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b = [], []
        bodies = batch.column("body")
        for i, (centre, other) in enumerate(zip(batch.column("centre").to_pylist(), batch.column("other").to_pylist(), strict=True)):
            body = np.frombuffer(bodies[i].as_buffer(), np.uint64)
            if other is None:
                at, own = centre, body.copy()
            elif at == centre and linked(own, body):
                a.append(centre)
                b.append(other)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class _Texts:
    """The texts by signature, one of each."""

    def __init__(self, docs: DataFrame, marks: DataFrame):
        self.docs = docs
        self.low = marks.groupBy("sig").agg(F.min("key").alias("key"))

    def links(self, pairs: DataFrame) -> DataFrame:
        pairs = _shared.keep(pairs.distinct(), "pairs")
        ends = pairs.select(F.col("centre").alias("sig")).union(pairs.select("other")).distinct()
        few = _shared.keep(self.low.join(ends, "sig", "left_semi").select("key", "sig"), "ends")
        own = _shared.small(few)
        text = self.docs.join(own, "key").select("sig", "text")
        body = _shared.keep(text.mapInArrow(_bodies, "sig long, body binary"), "bodies", rows=512)
        centres = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"))
        members = pairs.join(centres, "centre").select("centre", "other", F.pmod(F.xxhash64("other"), "salts").cast("int").alias("salt"))
        heads = centres.select("centre", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        sent = body.join(_shared.small(members), F.col("sig") == F.col("other")).select("centre", "salt", "other", "body")
        heads = body.join(_shared.small(heads), F.col("sig") == F.col("centre")).select("centre", "salt", F.lit(None).cast("long").alias("other"), "body")
        dealt = heads.union(sent).repartition("centre", "salt").sortWithinPartitions("centre", "salt", F.col("other").asc_nulls_first())
        return _shared.keep(dealt.mapInArrow(_verify, "a long, b long").distinct(), "links", *_shared.paths(pairs, few, body), rows=512)


def groups(docs: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """(key, component) of each row of ``docs`` (key long, text string): rows that are joined by
    links have the same component. Rows with equal keys must have equal texts. ``prints`` (doc_id: the key, fp): pairs that
    link by SimHash are compared first, with the first pairs of the lists; what they join isn't compared again."""
    spark = docs.sparkSession
    marked = _shared.keep(docs.select("key", "text").mapInArrow(_mark, "key long, sig long, sketch binary, chunk int, body binary"), "marks")
    marks = marked.where("chunk is null").select("key", "sig", "sketch")
    count = np.zeros(SLOTS, np.int64)
    for chunk, body in marked.where("chunk is not null").select("chunk", "body").groupBy("chunk").applyInArrow(_add, "chunk int, body binary").collect():  # SLOTS counters
        count[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(body, np.int64)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(count.sum()) // TASK_SHINGLES)
    posted = docs.select("text").mapInArrow(_post(spark.sparkContext.broadcast(count)), _POSTING)
    found = _shared.keep(posted.repartition(parts, "h").mapInArrow(_shared_lists, _LISTED), "lists")
    degree = found.groupBy("sig").agg(F.sum("size").alias("degree"))
    lists = _shared.keep(found.join(degree, "sig").select("h", "sig", "n", "pos", "degree"), "lists", *_shared.paths(found))
    texts, kind = _Texts(docs, marks), "centre long, other long"
    first = lists.repartition(parts, "h").mapInArrow(_first_pairs, kind)
    spent: list = []
    if prints is not None:
        by_sig = _shared.keep(texts.low.join(prints, F.col("key") == F.col("doc_id")).select(F.col("sig").alias("doc_id"), "fp").distinct(), "prints")
        near = simhash_dedup.candidates(by_sig)
        first, spent = first.union(near), _shared.paths(near)
    links = texts.links(first)
    held = _shared.keep(components(links), "components")
    own = lists.join(held, F.col("sig") == F.col("node"), "left").select(*lists.columns, F.coalesce("component", "sig").alias("of"))
    mixed = own.repartition(parts, "h").mapInArrow(_mixed, "h long, sig long, n int, pos int, degree long, of long")
    drawn = marks.groupBy("sig").agg(F.first("sketch").alias("sketch"))
    rest = texts.links(mixed.join(drawn, "sig").repartition(parts, "h").mapInArrow(_across, kind))
    joined = held.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest)
    held = _shared.keep(components(joined), "components", *_shared.paths(held, lists))
    out = marks.select("key", "sig").join(held, F.col("sig") == F.col("node"), "left").select("key", F.coalesce("component", "sig").alias("component"))
    return _shared.keep(out, "groups", *_shared.paths(marked, held, links, rest), *spent)
