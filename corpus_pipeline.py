"""A training corpus from raw documents: five stages, each one operator.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and reread as the next stage's documents. Near-dedup and decontamination
decide by row (a hash of id and text), so repeated and null ids are no exception.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkroost.llm import _shared
from sparkroost.llm.decontaminate import contaminated
from sparkroost.llm.jaccard_dedup import SHINGLE, groups
from sparkroost.llm.quality import train
from sparkroost.llm.simhash_dedup import fingerprints
from sparkroost.llm.substring_dedup import rewrite
from sparkroost.llm.word_lexicon import encode_decode

#: Later stages include ones that SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def own_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, whatever the case of its names."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return train(docs).keep(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of five-word shingles find near copies, which an exact Jaccard similarity of 0.8 or more has to
    confirm; an exact index adds the links that fingerprints miss at that similarity. Of each group of linked texts one
    row stays: that of the smallest id, then of the smallest hash of id and text; null ids come last."""
    key = own_name(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    own = keyed.select(F.col(key).alias("key"), "text")
    held = groups(own, fingerprints(own, "key", shingle=SHINGLE))
    ids = keyed.select(F.col(key).alias("key"), "doc_id").distinct()
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = held.distinct().join(ids, "key").groupBy("component").agg(F.min(rank).alias("first")).select(F.col("first.key").alias("key"))
    gone = _shared.keep(held.select("key").distinct().join(first, "key", "left_anti"), "gone")
    twice = _shared.keep(held.groupBy("key").count().where("count > 1").select("key").join(gone, "key", "left_anti"), "twice", *_shared.paths(held))
    left = keyed.join(_shared.small(gone.select(F.col("key").alias(key))), key, "left_anti")
    if twice.isEmpty():
        return left.select(*docs.columns)
    again = _shared.small(twice.select(F.col("key").alias(key)))
    once = left.join(again, key, "left_semi").dropDuplicates([key, "doc_id", "text"])
    return left.join(again, key, "left_anti").unionByName(once).select(*docs.columns)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds go; other texts stay as they are."""
    other = own_name(docs, "cut_words")
    kept = docs.withColumnRenamed("n_removed", other) if "n_removed" in docs.columns else docs
    out = rewrite(kept)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    if "n_removed" in docs.columns:
        out = out.drop("n_removed").withColumnRenamed(other, "n_removed")
    return out.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    key = own_name(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    gone = _shared.keep(found.select(F.col("doc_id").alias(key)).distinct(), "gone")
    return keyed.join(_shared.small(gone), key, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian uint32) and the digest of what they decode to."""
    import public_tokenizers

    out = encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicate),
    ("substring dedup", substring),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, used = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES):
        docs = _shared.keep(stage(spark, docs, sf_dir), f"stage{i}", *used)
        used = _shared.paths(docs)
    return docs
