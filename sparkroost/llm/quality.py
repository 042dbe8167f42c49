"""Quality classifier: weak labels, an expectation-maximisation label model, a hashed linear scorer.

1. Overlapping heuristic labellers vote good (1), bad (0) or abstain (2) on each text.
2. The votes of *all* texts are counted by pattern (at most 3^11 rows, whatever the corpus). On these
   counts expectation-maximisation estimates each labeller's accuracy and the share of good texts,
   and gives each pattern's posterior.
3. Posterior labels train a linear scorer on hashed shape features of a bounded sample
   (``FIT_ROWS`` texts, by hash of their content, and as many of the texts that seem bad, so that a rare
   class is learnt): runs of four signs of the text in which every run of letters is one sign, and a word that repeats
   the one before it begins with a sign of its own.
4. The scorer rates whole texts; below ``THRESHOLD`` a text is rejected.

Defined results: a null or empty text has no features; it is rated by the posterior of its votes
(all labellers abstain). Repeated and null ids keep a row each; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _shared
from ._words import U, _P, mix, pack, words
from .linear import Rows, fit, sigmoid

FIT_ROWS, THRESHOLD, WIDTH, GRAM = 6000, 0.5, 4096, 4
#: Runs of signs below which a text says little by its shape.
SHORT = 24
GOOD, BAD, ABSTAIN, LABELLERS = 1, 0, 2, 11
#: Function words of the four languages, the labeller's fixed list.
FUNCTION_WORDS = frozenset(b"the of and to in is that for it as was with be by on are this from at an a der die das und den von zu mit des im ist nicht ein eine auch auf werden es le la les de des et en un une du que qui dans pour est sur par au el los las del y se por con una para".split())
_ENDS = b".,;:!?\"')"


def _signs() -> np.ndarray:
    """A byte's sign: letters of any script one sign, digits one, white space two, others their own."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    out[[9, 11, 12, 32]] = 32
    out[[10, 13]] = 10
    out[128:] = ord("a")
    return out


_SIGN = _signs()


def votes(text: bytes) -> tuple[int, ...]:
    """The labellers' votes on one text."""
    own = text.split()
    n = len(own)
    if not n:
        return (ABSTAIN,) * LABELLERS
    signs = np.bincount(_SIGN[np.frombuffer(text, np.uint8)], minlength=256)
    lower, upper, digit = (int(signs[ord(c)]) for c in "aA0")
    space = int(signs[32] + signs[10])
    seen = max(1, len(text) - space)
    symbols = (len(text) - lower - upper - digit - space) / seen
    shout = upper / max(1, lower + upper)
    bars = text.count(b"|") / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines)
    function = sum(w.strip(_ENDS).lower() in FUNCTION_WORDS for w in own) / n
    clean = sum(w.rstrip(_ENDS)[-1:].isalnum() or w.rstrip(_ENDS)[-1:] > b"\x7f" for w in own) / n
    odd = sum(w[-1] in b"%&$*#|!@^~" for w in own) / n
    few = n < 8
    twin = bytes(map(bytes.__eq__, own[1:], own))
    stutter, run = twin.count(1) / n, 1 + max(map(len, twin.split(b"\0")))
    thrice = sum(max(0, len(x) - 1) for x in twin.split(b"\0")) / n
    doubled = len(set(itertools.compress(own[1:], twin))) / len(set(own))
    vote = lambda good, bad: GOOD if good else BAD if bad else ABSTAIN
    return (
        vote(symbols < 0.06, symbols > 0.12 and not few),
        vote(shout < 0.12, shout > 0.4 and not few),
        vote(bars < 0.01, bars > 0.15),
        vote(False, again > 0.3 and len(lines) > 3),
        vote(function > 0.12 and not few, function < 0.03 and not few),
        vote(clean > 0.93, clean < 0.75),
        vote(odd < 0.05, odd > 0.25),
        vote(stutter < 0.05, stutter > 0.2),
        vote(run < 3, run > 3),
        vote(doubled < 0.05, doubled > 0.3),
        vote(thrice < 0.02, thrice > 0.15),
    )


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pattern = [sum(v * 3**i for i, v in enumerate(votes(x.as_buffer().to_pybytes() if x.is_valid else b""))) for x in batch.column(0).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int32()), batch.column(1)], ["pattern", "key"])


def label_model(patterns: np.ndarray, counts: np.ndarray, n_labellers: int = LABELLERS, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, the vote tables (labeller, class, vote; an abstention
    counts for neither class), and the share of
    good texts: expectation-maximisation from "no bad vote" as the first guess, since the labellers
    that look for one defect vote good on every other defect."""
    v = np.stack([patterns // 3**i % 3 for i in range(n_labellers)], 1)
    post = np.where((v == BAD).any(1), 0.1, 0.9)
    total = max(counts.sum(), 1)
    table, share = np.zeros((n_labellers, 2, 3)), 0.5
    for _ in range(rounds):
        share = float(np.clip((counts * post).sum() / total, 1e-3, 1 - 1e-3))
        for k, p in ((1, post), (0, 1 - post)):
            for j in range(n_labellers):
                table[j, k] = np.bincount(v[:, j], counts * p, 3) + 0.5
            table[:, k] /= table[:, k, :ABSTAIN].sum(1, keepdims=True)
            table[:, k, ABSTAIN] = 1  # says nothing
        log = [np.log(s) + sum(np.log(table[j, k][v[:, j]]) for j in range(n_labellers)) for k, s in ((0, 1 - share), (1, share))]
        new = sigmoid(log[1] - log[0])
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post, table, share


def features(data: np.ndarray, offsets: np.ndarray) -> Rows:
    """Hashed runs of ``GRAM`` signs, by the root of their share in the text."""
    begin, index, value = [0], [], []
    signs = _SIGN[data]
    starts, _, first, h = words(data, offsets)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < len(h)]] = False
    signs[starts[same]] = 1
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        s = signs[a:b]
        s = s[np.append(True, (s[1:] != s[:-1]) | (s[1:] < 48) & (s[1:] != 32))] if len(s) else s
        k = len(s) - GRAM + 1
        if k > 0:
            code = s[:k].astype(np.uint64)
            for i in range(1, GRAM):
                code = (code << U(8)) | s[i : i + k]
            code = (mix(code * U(_P)) % U(WIDTH)).astype(np.int64)
            count = np.bincount(code, minlength=WIDTH)
            own = np.flatnonzero(count)
            index.append(own)
            value.append(np.sqrt(count[own] / (k + SHORT)))
            begin.append(begin[-1] + len(own))
        else:
            begin.append(begin[-1])
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return Rows(np.array(begin), cat(index, np.int64), cat(value, np.float64), WIDTH)


def _rate(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, empty = model.value
        for batch in _shared.parts(batches):
            x = features(*pack(batch.column(1)))
            p = sigmoid(x.dot(w[:-1]) + w[-1])
            p[np.diff(x.begin) == 0] = empty
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "quality"])

    return run


class QualityModel:
    """A fitted scorer, with the label model that it was trained on."""

    def __init__(self, weights: np.ndarray, empty: float, table: np.ndarray, share: float):
        self.weights, self.empty, self.table, self.share = weights, empty, table, share

    def rate(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, quality): each row's probability of being good."""
        held = docs.sparkSession.sparkContext.broadcast((self.weights, self.empty))
        return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(_rate(held), "doc_id long, quality double")

    def keep(self, docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
        """The rows of ``docs`` that are not rejected, with their own columns."""
        names, held = docs.columns, docs.sparkSession.sparkContext.broadcast((self.weights, self.empty))
        at = names.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, empty = held.value
            for batch in _shared.parts(batches):
                x = features(*pack(batch.column(at).cast(pa.string())))
                p = sigmoid(x.dot(w[:-1]) + w[-1])
                p[np.diff(x.begin) == 0] = empty
                yield batch.filter(pa.array(p >= threshold))

        return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS) -> QualityModel:
    """Vote on all texts, estimate the labellers, and fit the scorer on the bounded sample."""
    text = docs[text_col].cast("string")
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("key"))
    voted = _shared.keep(rows.mapInArrow(_vote_batches, "pattern int, key long"), "votes")
    counted = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3^11 rows
    patterns, counts = np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], float)
    if not len(patterns):
        return QualityModel(np.zeros(WIDTH + 1), 0.5, np.zeros((LABELLERS, 2, 3)), 0.5)
    post, table, share = label_model(patterns, counts)
    bad = [int(p) for p, x in zip(patterns, post, strict=True) if x < 0.5]
    once = voted.select("key", "pattern").distinct()
    marked = F.broadcast(docs.sparkSession.createDataFrame([(p,) for p in bad], "pattern int"))  # at most 3^11 ints
    drawn = [_shared.bounded_sample(part, fit_rows, "key").collect() for part in (once, once.join(marked, "pattern", "left_semi").select("key", "pattern"))]
    keys = {r[0]: r[1] for part in drawn for r in part}
    texts = dict(map(tuple, once.groupBy("pattern").count().collect()))  # at most 3^11 rows
    _shared.drop(docs.sparkSession, *_shared.paths(voted))
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame([(k,) for k in keys], "key long"))  # 2 * fit_rows longs
    sample = rows.join(picked, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    wire = sample.mapInArrow(_features_out, "key long, index binary, value binary").collect()
    wire.sort(key=lambda r: r[0])
    index, value = [np.frombuffer(r[1], np.int16).astype(np.int64) for r in wire], [np.frombuffer(r[2], np.float32).astype(float) for r in wire]
    x = Rows(np.concatenate([[0], np.cumsum([len(i) for i in index])]), np.concatenate(index), np.concatenate(value), WIDTH)
    of = dict(zip(patterns.tolist(), post.tolist(), strict=True))
    y = np.array([of[keys[r[0]]] for r in wire])
    some = np.diff(x.begin) > 0
    x, y = x.take(np.flatnonzero(some)), y[some]
    # both classes at their share of all different texts, whatever share of them was drawn
    low = np.array([of[keys[r[0]]] < 0.5 for r in wire])[some]
    of_bad = sum(n for p, n in texts.items() if of[p] < 0.5)
    weight = np.where(low, of_bad / max(1, low.sum()), (sum(texts.values()) - of_bad) / max(1, (~low).sum()))
    w = fit(x, np.zeros((len(y), 0)), y, weight) if len(y) else np.zeros(WIDTH + 1)
    none = sum(ABSTAIN * 3**i for i in range(LABELLERS))
    empty = float(of.get(none, label_model(np.append(patterns, none), np.append(counts, 0.0))[0][-1]))
    return QualityModel(w, empty, table, share)


def _features_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _shared.parts(batches):
        x = features(*pack(batch.column(1)))
        cut = list(zip(x.begin[:-1].tolist(), x.begin[1:].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.index[a:b].astype(np.int16).tobytes() for a, b in cut], pa.binary()), pa.array([x.value[a:b].astype(np.float32).tobytes() for a, b in cut], pa.binary())], ["key", "index", "value"])


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rated = train(docs).rate(docs)
    return rated.select("doc_id", F.round("quality", 6).alias("quality"), (F.col("quality") >= THRESHOLD).alias("kept"))
