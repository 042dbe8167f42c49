"""Toxicity: a classifier chain over hashed words.

Categories are predicted one after the other. Each category's linear model sees the hashed words of
the text and the probabilities of the categories before it. In training those are out-of-fold
predictions, so that a later model learns how far an earlier one can be trusted; in use they are the
earlier models' own.

The models are fitted on a bounded sample of labelled rows (``FIT_ROWS``, by hash of the id; all
positive and as many negative rows take part up to the bound). Words are lower-cased (A-Z) and
stripped of ASCII punctuation; a word counts once in a text. The features that tell a category apart
(standardised difference of their rates, ``LEAST_Z`` and more) are kept, ``FEATURES`` for each category.

Defined results: a null or empty text has the models' bias alone; null labels count as negative;
labels of unknown ids are not used; an id with several label rows takes their largest; repeated ids
in the texts keep a row each; without positive labels of a category its probability is its rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import _shared
from ._words import LETTERS, U, pack, words
from .linear import Rows, fit, sigmoid

FIT_ROWS, FEATURES, FOLDS, THRESHOLD, BITS, LEAST_Z, L2 = 8000, 2000, 5, 0.5, 22, 6.0, 2e-5


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, bucket): each text's different words, hashed to ``BITS`` bits, ascending."""
    _, _, first, h = words(data, offsets, letters=LETTERS)
    key = (np.repeat(np.arange(len(offsets) - 1), np.diff(first)).astype(np.uint64) << U(BITS)) | (h >> U(64 - BITS))
    key = np.unique(key)
    row = (key >> U(BITS)).astype(np.int64)
    return np.searchsorted(row, np.arange(len(offsets))), (key & U((1 << BITS) - 1)).astype(np.int64)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _shared.parts(batches):
        begin, index = buckets(*pack(batch.column(1)))
        cut = zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([index[a:b].astype(np.int32).tobytes() for a, b in cut], pa.binary()), *batch.columns[2:]], ["doc_id", "buckets", *batch.schema.names[2:]])


class Chain:
    """Fitted categories, in order: (name, kept buckets, weights)."""

    def __init__(self, links: list[tuple[str, np.ndarray, np.ndarray]]):
        self.links = links

    @property
    def categories(self) -> list[str]:
        return [c for c, _, _ in self.links]

    def predict(self, begin: np.ndarray, index: np.ndarray) -> np.ndarray:
        out = np.zeros((len(begin) - 1, 0))
        for _, kept, w in self.links:
            out = np.column_stack([out, sigmoid(_margin(_select(begin, index, kept), out, w))])
        return out

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, p_<category>...) for each row."""
        held = docs.sparkSession.sparkContext.broadcast(self.links)
        names = [f"p_{c}" for c in self.categories]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chain = Chain(held.value)
            for batch in _shared.parts(batches):
                p = chain.predict(*buckets(*pack(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, j]) for j in range(p.shape[1]))], ["doc_id", *names])

        own = docs.select(docs[id_col].cast("long"), docs[text_col].cast("string"))
        return own.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} double" for n in names)]))


def _select(begin: np.ndarray, index: np.ndarray, kept: np.ndarray) -> Rows:
    if not len(kept):
        return Rows(np.zeros(len(begin), np.int64), np.zeros(0, np.int64), np.zeros(0), 0)
    at = np.minimum(np.searchsorted(kept, index), len(kept) - 1)
    ok = kept[at] == index
    return Rows(np.concatenate([[0], np.cumsum(ok)])[begin], at[ok], np.ones(int(ok.sum())), len(kept))


def _margin(x: Rows, extra: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (x.dot(w[: x.width]) if x.width else 0) + extra @ w[x.width : -1] + w[-1]


def _telling(begin: np.ndarray, index: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Buckets whose rates differ most between the classes, in standard errors."""
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    names, inverse = np.unique(index, return_inverse=True)
    pos, neg = y.sum(), len(y) - y.sum()
    a, b = np.bincount(inverse, y[row], len(names)), np.bincount(inverse, 1 - y[row], len(names))
    rate = (a + b) / len(y)
    z = np.abs(a / max(pos, 1) - b / max(neg, 1)) / np.sqrt(rate * (1 - rate) * (1 / max(pos, 1) + 1 / max(neg, 1)) + 1e-9)
    z[a + b < 6] = 0
    best = np.argsort(-z, kind="stable")[:n]
    return np.sort(names[best[z[best] >= LEAST_Z]])


def fit_chain(begin: np.ndarray, index: np.ndarray, labels: dict[str, np.ndarray], features: int = FEATURES, folds: int = FOLDS, weight: np.ndarray | None = None) -> Chain:
    """Fit the categories of ``labels`` in their order; ``weight``: of each row."""
    n = len(begin) - 1
    weight = np.ones(n) if weight is None else weight * n / max(weight.sum(), 1e-9)
    fold, extra, links = np.arange(n) % folds, np.zeros((n, 0)), []
    for name, y in labels.items():
        y = y.astype(float)
        share = ((y * weight).sum() + 0.5) / (n + 1)
        if y.sum() < folds or y.sum() > n - folds:
            links.append((name, np.zeros(0, np.int64), np.append(np.zeros(extra.shape[1]), np.log(share / (1 - share)))))
            extra = np.column_stack([extra, np.full(n, share)])
            continue
        own = _telling(begin, index, y, features)
        x = _select(begin, index, own)
        out = np.zeros(n)
        for k in range(folds):
            a, b = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            # a fold chooses its features without the rows that it is held against
            part = Rows(begin, index, np.ones(len(index)), 1 << BITS).take(a)
            seen = _telling(part.begin, part.index, y[a], features)
            sub = _select(begin, index, seen)
            out[b] = sigmoid(_margin(sub.take(b), extra[b], fit(sub.take(a), extra[a], y[a], weight[a], l2=L2, rounds=100)))
        links.append((name, own, fit(x, extra, y, weight, l2=L2)))
        extra = np.column_stack([extra, out])
    return Chain(links)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Chain:
    """Fit a chain. ``categories``: name to a 0/1 expression over the label columns and ``text``, in
    the chain's order; the first is over label columns alone, and rows are chosen by it."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marks = [c for c in labels.columns if c not in (id_col, "doc_id", "text")]
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(*[F.max(c).alias(c) for c in marks])
    known = known.join(own.select("doc_id").distinct(), "doc_id")
    first = F.coalesce(next(iter(categories.values())).cast("int"), F.lit(0))
    known = known.withColumn("drawn_as", first)
    every = dict(map(tuple, known.groupBy("drawn_as").count().collect()))
    chosen = [_shared.bounded_sample(known.where(F.col("drawn_as") == k), fit_rows // 2, "doc_id").collect() for k in (1, 0)]
    # each class weighs as much as its share of all labelled rows, whatever share of it was drawn
    weight = {k: every.get(k, 0) / max(1, len(part)) for k, part in zip((1, 0), chosen, strict=True)}
    picked = docs.sparkSession.createDataFrame([r for part in chosen for r in part], known.schema)  # at most fit_rows
    texts = own.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    joined = texts.join(F.broadcast(picked), "doc_id")
    sample = joined.select("doc_id", "text", "drawn_as", *[F.coalesce(c.cast("int"), F.lit(0)).alias(n) for n, c in categories.items()])
    rows = sample.mapInArrow(_sample, ", ".join(["doc_id long", "buckets binary", "drawn_as int", *(f"{n} int" for n in categories)])).collect()  # at most fit_rows
    rows.sort(key=lambda r: (r["doc_id"] * 0x9E3779B1 % 0x100000000, r["doc_id"]))
    held = [np.frombuffer(r["buckets"], np.int32).astype(np.int64) for r in rows]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
    return fit_chain(begin, np.concatenate(held) if held else np.zeros(0, np.int64), {n: np.array([r[n] for r in rows], float) for n in categories}, weight=np.array([weight[r["drawn_as"]] for r in rows]))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    toxic, quality = F.col("toxic") == 1, F.col("quality")
    chain = train(docs, labels.select("doc_id", "toxic", "quality"), {"toxic": toxic, "toxic_poor": toxic & (quality == 0), "toxic_good": toxic & (quality == 1)})
    out = chain.score(docs)
    return out.select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in chain.categories], (F.col("p_toxic") >= THRESHOLD).alias("toxic"))
