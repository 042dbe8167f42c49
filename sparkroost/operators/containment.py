"""Which texts hold which parts, without comparing them pair by pair.

For every length that a part has, the hashes of all windows of that length of all texts are joined with the
parts' hashes on equal values; only what meets is compared as text. The work grows with the texts' characters
times the number of *different* lengths of the parts (one, for heads of 100 characters), never with texts times parts. A
window is 24 bytes in the shuffle, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLACE = "array<struct<n:int,at:int,hash:bigint>>"


def _hashed(letters: Column) -> Column:
    return F.xxhash64(F.size(letters), letters)


def _letters(c: Column) -> Column:
    return F.split(c, "")


def holders(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(text_id, part): once for every pair of a row of ``texts`` (a unique text_id, text) and a different
    ``part`` of ``parts`` (part) that its text holds. Nulls hold nothing and are in nothing; an empty part
    is in every text that isn't null."""
    own = parts.select("part").where("part is not null").distinct()
    lengths = [r[0] for r in own.select(F.length("part")).distinct().collect()]  # at most as many as the longest part has letters
    held = texts.select("text_id", "text").where("text is not null")
    everywhere = held.select("text_id", F.lit("").alias("part"))
    some = sorted(n for n in lengths if n)
    if not some:
        return everywhere if lengths else everywhere.limit(0)
    cut = lambda letters, n: F.transform(F.sequence(F.lit(1), F.size(letters) - n + 1), lambda i: F.struct(n.alias("n"), i.alias("at"), _hashed(F.slice(letters, i, n)).alias("hash")))
    windows = F.flatten(F.transform(F.array(*map(F.lit, some)), lambda n: F.when(F.size("letters") >= n, cut(F.col("letters"), n)).otherwise(F.array().cast(_PLACE))))
    index = held.select("text_id", _letters(F.col("text")).alias("letters")).select("text_id", F.inline(windows))
    keyed = own.where("part <> ''").withColumn("hash", _hashed(_letters(F.col("part"))))
    met = index.join(keyed, "hash").where(F.length("part") == F.col("n")).select("text_id", "at", "n", "part")
    found = met.join(held, "text_id").where(F.substring("text", F.col("at"), F.col("n")) == F.col("part")).select("text_id", "part").distinct()
    return found.unionByName(everywhere) if len(some) < len(lengths) else found


def either_way(names: DataFrame, others: DataFrame) -> DataFrame:
    """(name, other): the different pairs of a ``name`` of ``names`` and an ``other`` of ``others`` of which one
    holds the other."""
    left, right = names.select("name").where("name is not null").distinct(), others.select("other").where("other is not null").distinct()
    down = holders(left.select(F.col("name").alias("text_id"), F.col("name").alias("text")), right.select(F.col("other").alias("part")))
    up = holders(right.select(F.col("other").alias("text_id"), F.col("other").alias("text")), left.select(F.col("name").alias("part")))
    return down.select(F.col("text_id").alias("name"), F.col("part").alias("other")).unionByName(up.select(F.col("part").alias("name"), F.col("text_id").alias("other"))).distinct()
