"""Words of texts without spaces: the most probable path through a lattice of dictionary words.

The dictionary is counted from a corpus: every run of up to ``LONGEST`` ideographs is a word with its number of occurrences.
A text's runs of ideographs are cut where the product of the words' shares is greatest; other runs between
white space are words of their own. Weights are logarithms in millionths, as whole numbers, so that sums are exact
and ties are real: of equal paths the one whose first word is longer, then its second, and so on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Letters of a word at most, occurrences of a word of several letters at least, and words that a dictionary keeps (the most
#: frequent): the bound of what is broadcast.
LONGEST, LEAST, MOST = 4, 2, 1 << 20
IDEOGRAPHS = "\\u4e00-\\u9fff"
_RUNS = re.compile("[一-鿿]+|[^\\s一-鿿]+")


def dictionary(corpus: DataFrame, column: str = "text", longest: int = LONGEST, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(word, n, weight): the runs of 1 to ``longest`` ideographs of all texts, with how often they occur. Single letters are
    always words; longer ones from ``least`` occurrences on."""
    runs = corpus.select(F.explode(F.regexp_extract_all(column, F.lit(f"([{IDEOGRAPHS}]+)"), F.lit(1))).alias("run"))
    counted = runs.groupBy("run").agg(F.count(F.lit(1)).alias("times"))  # equal runs are cut once
    sizes = F.sequence(F.lit(1), F.lit(longest))
    words = F.flatten(F.transform(sizes, lambda k: F.when(F.length("run") >= k, F.transform(F.sequence(F.lit(1), F.length("run") - k + 1), lambda i: F.substring("run", i, k))).otherwise(F.array().cast("array<string>"))))
    found = counted.select("times", F.explode(words).alias("word")).groupBy("word").agg(F.sum("times").alias("n"))
    kept = found.where((F.col("n") >= least) | (F.length("word") == 1)).orderBy(F.desc("n"), "word").limit(most)
    letters = counted.agg(F.sum(F.col("times") * F.length("run"))).first()[0] or 1
    return kept.select("word", "n", F.round(F.log(F.col("n") / F.lit(letters)) * 1_000_000).cast("long").alias("weight"))


def trie(words: list[tuple[str, int]]) -> dict[str, int | None]:
    """A trie laid flat: every prefix of a word, with the weight of the word that it is, if it is one."""
    out: dict[str, int | None] = {}
    for word, weight in words:
        for k in range(1, len(word)):
            out.setdefault(word[:k], None)
        out[word] = weight
    return out


def best_path(run: str, own: dict[str, int | None], unknown: int) -> list[str]:
    """The words of the most probable path; a letter that the dictionary lacks is a word of weight ``unknown``."""
    n = len(run)
    best: list[tuple[int, int]] = [(0, 0)] * (n + 1)
    for i in range(n - 1, -1, -1):
        found = (own.get(run[i]) if own.get(run[i]) is not None else unknown) + best[i + 1][0], 1
        k = 2
        while i + k <= n and run[i : i + k] in own:
            weight = own[run[i : i + k]]
            if weight is not None:
                found = max(found, (weight + best[i + k][0], k))
            k += 1
        best[i] = found
    out, i = [], 0
    while i < n:
        out.append(run[i : i + best[i][1]])
        i += best[i][1]
    return out


def segmented(rows: DataFrame, words: DataFrame, column: str = "text", name: str = "words") -> DataFrame:
    """``rows`` with the array of a text column's words; null: null. The dictionary, which its ``most`` bounds, is broadcast."""
    spark = rows.sparkSession
    held = [tuple(r) for r in words.select("word", "weight").collect()]
    lowest = min((w for _, w in held), default=0)
    sent = spark.sparkContext.broadcast((trie(held), lowest - 1_000_000))
    at = rows.columns.index(column)

    def cut(text: str) -> list[str]:
        own, unknown = sent.value
        out = []
        for run in _RUNS.findall(text):
            out += best_path(run, own, unknown) if "一" <= run[0] <= "鿿" else [run]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            different = batch.column(at).dictionary_encode()  # equal texts of a batch are cut once
            own = pa.array([None if t is None else cut(t) for t in different.dictionary.to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, own.take(different.indices)], [*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, ArrayType(StringType()))]))
