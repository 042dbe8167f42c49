"""Language identification: averaged hashed subword embeddings under a linear softmax.

1. A text is cut into words (ASCII punctuation counts as space, A-Z as a-z); a word's subwords are its runs of
   ``GRAMS`` bytes, with a mark before and after it, hashed to ``BUCKETS`` embeddings of ``DIMS`` numbers.
2. The mean embedding of all subwords of the text, times a matrix, gives the languages' odds. Embeddings and
   matrix are trained by stochastic gradient descent in numpy, on a bounded sample of labelled rows: ``FIT_ROWS``
   different texts, as many of each language, chosen by hash; each takes part whole and by one run of
   ``SHORT_WORDS`` words, so that short texts are known too.
3. A fifth of the sample is kept from the descent. On it a temperature is fitted, so that the best language's
   probability is the share of right answers, and the least probability above which at most ``ERROR`` of the
   answers are wrong: below it a prediction is rejected (``accepted`` false).
4. A mean of embeddings times a matrix is a mean of products, so executors get one table of ``BUCKETS`` rows of
   odds, and each different word of a batch is rated once.

Defined results: a text that is null or has no letter (Unicode categories L*) is ``und`` with score 0, and so is every
text if there is no labelled row. A null id is not held out and is not learned from. Languages of equal odds: the
smallest. Repeated rows each have a row; an empty table gives an empty table; other columns take no part. The
languages are the model's own columns, so their list is held by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared
from ._chunks import any_of
from ._words import LETTERS, U, _TABLE, grams, mix, pack, words

UNKNOWN = "und"
GRAMS, BUCKETS, DIMS = (1, 2, 3, 4, 5), 1 << 16, 16
FIT_ROWS, SHORT_WORDS, EPOCHS, RATE, ERROR = 6000, 16, 4, 0.5, 0.001
_LATIN = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])


def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, whether it has a letter."""
    out = any_of(_LATIN[data], offsets)
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")))
    return out


def subwords(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word): the hashed subwords of the words at ``begin`` to ``end``, of all words together."""
    size = end - begin
    cut = np.concatenate([[0], np.cumsum(size + 2)])
    framed = np.full(cut[-1], 32, np.uint8)  # a space stands before and after
    to = np.arange(size.sum()) + np.repeat(cut[:-1] + 1 - (np.cumsum(size) - size), size)
    framed[to] = LETTERS[data[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)]]
    of = np.repeat(np.arange(len(size)), size + 2)
    bucket, word = [], []
    for n in GRAMS:
        h, at = grams(_TABLE[framed], cut, n)
        bucket.append((mix(h) % U(BUCKETS)).astype(np.int64))
        word.append(of[at])
    return np.concatenate(bucket), np.concatenate(word)


def rate(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mean of ``table``'s rows over all subwords of each text (0 for a text without any)."""
    n = len(offsets) - 1
    begin, end, first, h = words(data, offsets, letters=LETTERS)
    _, head, of = np.unique(h, return_index=True, return_inverse=True)
    bucket, word = subwords(data, begin[head], end[head])
    text = np.repeat(np.arange(n), np.diff(first))
    count = np.bincount(text, np.bincount(word, minlength=len(head))[of], n)
    sums = [np.bincount(text, np.bincount(word, column[bucket], len(head))[of], n) for column in table.T]
    return np.stack(sums, 1) / np.maximum(count, 1)[:, None] if sums else np.zeros((n, 0))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lang, text) to the texts' buckets and counts: whole, and a run of words."""
    for batch in _shared.parts(batches, 64):
        data, offsets = pack(batch.column(2))
        begin, end, first, _ = words(data, offsets, letters=LETTERS, hashes=False)
        keys, out = batch.column(0).to_pylist(), {"row": [], "key": [], "short": [], "index": [], "count": []}
        for i, key in enumerate(keys):
            a, b = int(first[i]), int(first[i + 1])
            at = a + (key % (b - a - SHORT_WORDS) if b - a > SHORT_WORDS else 0)
            for short, lo, hi in ((False, a, b), (True, at, min(b, at + SHORT_WORDS))):
                bucket, _ = subwords(data, begin[lo:hi], end[lo:hi])
                count = np.bincount(bucket, minlength=BUCKETS)
                own = np.flatnonzero(count)
                for name, value in zip(out, (i, key, short, own.astype(np.uint16).tobytes(), np.minimum(count[own], 65535).astype(np.uint16).tobytes()), strict=True):
                    out[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["key"], pa.int64()), batch.column(1).take(pa.array(out["row"], pa.int64())), pa.array(out["short"], pa.bool_()), pa.array(out["index"], pa.binary()), pa.array(out["count"], pa.binary())],
            ["key", "lang", "short", "index", "count"],
        )


def descend(index: list[np.ndarray], share: list[np.ndarray], label: np.ndarray, n_labels: int, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings (BUCKETS, DIMS) and matrix (DIMS, labels), one example a step, the rate falling to 0."""
    dice = np.random.default_rng(seed)
    table, matrix = dice.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32), np.zeros((DIMS, n_labels), np.float32)
    step, steps = 0, max(1, epochs * len(index))
    for _ in range(epochs):
        for i in dice.permutation(len(index)):
            speed = RATE * (1 - step / steps)
            step += 1
            mean = share[i] @ table[index[i]]
            slope = softmax(mean @ matrix)
            slope[label[i]] -= 1
            table[index[i]] -= np.outer(share[i], speed * (matrix @ slope))
            matrix -= np.outer(mean, speed * slope)
    return table, matrix


def calibrated(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(temperature, least score): the likeliest temperature of a fixed grid, and the smallest score from which
    on at most ``ERROR`` of the answers are wrong."""
    if not len(z):
        return 1.0, 0.0
    grid = np.geomspace(0.05, 20, 121)
    own = np.arange(len(z))
    temperature = float(min(grid, key=lambda t: -np.log(softmax(z / t)[own, label] + 1e-12).mean()))
    p = softmax(z / temperature)
    score, right = p.max(1), p.argmax(1) == label
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(z) + 1)
    last = np.flatnonzero(wrong <= ERROR)
    return temperature, float(score[order][last[-1]]) if len(last) else 1.0


class LanguageModel:
    """``languages`` in order, the table of odds of each bucket, and the least score that is accepted."""

    def __init__(self, languages: list[str], odds: np.ndarray, least: float):
        self.languages, self.odds, self.least = languages, odds, least

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
        """(doc_id, lang_pred, score, accepted) for each row, and the columns ``more``."""
        held = docs.sparkSession.sparkContext.broadcast((self.languages, self.odds, self.least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            languages, odds, least = held.value
            names = np.array([*languages, UNKNOWN], object)
            for batch in _shared.parts(batches):
                data, offsets = pack(batch.column(1))
                best, score = np.full(batch.num_rows, len(languages)), np.zeros(batch.num_rows)
                if languages:
                    some = lettered(data, offsets)
                    p = softmax(rate(odds, data, offsets))
                    best[some], score[some] = p.argmax(1)[some], p.max(1)[some]
                found = [pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array((score >= least) & (best < len(languages)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *found, *batch.columns[2:]], ["doc_id", "lang_pred", "score", "accepted", *batch.schema.names[2:]])

        rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *(c.alias(k) for k, c in more.items()))
        kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
        return rows.mapInArrow(run, f"doc_id long, lang_pred string, score double, accepted boolean{kinds}")


def _sample(labelled: DataFrame, fit_rows: int) -> DataFrame:
    """(key, lang, text): at most ``fit_rows`` different texts, as many of each language where there are."""
    spark = labelled.sparkSession
    keyed = labelled.select(F.xxhash64("text", "lang").alias("key"), "lang", "text")
    once = _shared.keep(keyed.select("key", "lang").distinct(), "keys")
    sizes = once.groupBy("lang").count().collect()  # a row for each language
    each = max(1, fit_rows // max(1, len(sizes)))
    share = spark.createDataFrame([(r["lang"], min(1 << 30, int((1 << 30) * 0.95 * each / r["count"]) if r["count"] > each else 1 << 30)) for r in sizes], "lang string, share long")
    drawn = once.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.col("share")).select("key").limit(fit_rows)
    picked = [tuple(r) for r in drawn.collect()]
    _shared.drop(spark, *_shared.paths(once))
    few = F.broadcast(spark.createDataFrame(picked, "key long"))  # fit_rows longs
    return keyed.join(few, "key", "left_semi").groupBy("key").agg(F.min("lang").alias("lang"), F.min("text").alias("text"))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from rows with a text and a language; others are left out."""
    rows = labelled.select(labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    wire = _sample(rows, fit_rows).select("key", "lang", "text").mapInArrow(_examples, "key long, lang string, short boolean, index binary, count binary").collect()
    wire = sorted((r for r in wire if len(r["index"])), key=lambda r: (r["key"], r["short"]))
    languages = sorted({r["lang"] for r in wire})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), 0.0)
    label = np.array([languages.index(r["lang"]) for r in wire])
    index = [np.frombuffer(r["index"], np.uint16).astype(np.int64) for r in wire]
    share = [(c / c.sum()).astype(np.float32) for c in (np.frombuffer(r["count"], np.uint16).astype(np.float64) for r in wire)]
    fold = np.array([r["key"] % 5 == 0 for r in wire])
    learn, test = np.flatnonzero(~fold), np.flatnonzero(fold)
    if not set(label[learn]) >= set(label):  # too few rows to spare some
        learn, test = np.arange(len(wire)), test[:0]
    table, matrix = descend([index[i] for i in learn], [share[i] for i in learn], label[learn], len(languages))
    z = np.array([share[i] @ table[index[i]] @ matrix for i in test], float).reshape(len(test), len(languages))
    temperature, least = calibrated(z, label[test])
    return LanguageModel(languages, (table @ matrix).astype(np.float64) / temperature, least)


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4
    model = train(docs.where(fold != 2))
    return model.predict(docs, held_out=F.coalesce(fold == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "accepted")
