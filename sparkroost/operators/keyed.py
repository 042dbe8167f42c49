"""Keyed operators: first and last of a key, upsert, resume, assignment, ranking, joins with defaults.

Order is always an explicit column (``pos``); rows of equal key and order are repeated rows and one of
them stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


def _pick(rows: DataFrame, keys: list[str], pos: str, best) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(best(F.struct(*others), F.col(pos)).alias("x")).select(*keys, *[F.col(f"x.{c}") for c in others]).select(*rows.columns)


def keep_last(rows: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """A dictionary's overwrite: the last row of each key (pre-aggregated before the shuffle)."""
    return _pick(rows, keys, pos, F.max_by)


def keep_first(rows: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    return _pick(rows, keys, pos, F.min_by)


def first_success(cache: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """The result cache's probe: the first successful row of each key."""
    return keep_first(cache.where("success"), keys, pos)


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows take the place of base rows of their key; others are added."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merge_keep(base: DataFrame, new: DataFrame, keys: list[str], kept: str) -> DataFrame:
    """Upsert in which a new row without ``kept`` takes it from the row that it replaces."""
    b, n = base.withColumn("has_base", F.lit(True)).alias("b"), new.withColumn("has_new", F.lit(True)).alias("n")
    on = [F.col(f"b.{k}") == F.col(f"n.{k}") for k in keys]
    both = b.join(n, on, "full_outer")
    cell = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"b.{c}")) if c in keys or c == kept else F.when(F.col("has_new"), F.col(f"n.{c}")).otherwise(F.col(f"b.{c}"))
    return both.select(*[cell(c).alias(c) for c in base.columns])


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not done: what a resumed run has left."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def argmax(values: Column) -> Column:
    """Index (from 0) of the first greatest value; nulls are ignored."""
    return F.array_position(values, F.array_max(values)) - 1


def confidence_map(models: Column, confidence: Column, prices: Column) -> Column:
    """Model-keyed confidences by position, up to the shorter array, without unpriced models."""
    n = F.least(F.size(models), F.size(confidence))
    zipped = F.slice(F.arrays_zip(models.alias("m"), confidence.alias("c"), prices.alias("p")), F.lit(1), n)
    kept = F.filter(zipped, lambda x: x["p"].isNotNull())
    return F.map_from_arrays(F.transform(kept, lambda x: x["m"]), F.transform(kept, lambda x: x["c"]))


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Row numbers over a whole table in a stated order without sending it through one task: range
    partitions, numbers within them, their sizes' prefix sums. The numbered partitions are written
    once to the scratch folder, so that sizes and rows are of the same partitions however either is
    planned, and after a lost executor too."""
    spark = rows.sparkSession
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    here = F.monotonically_increasing_id()
    path = scratch(spark, f"numbered-{uuid.uuid4().hex}")
    numbers = parts.withColumns({"part_": F.shiftright(here, 33), "at_": here.bitwiseAND(F.lit((1 << 33) - 1))})
    numbers.write.parquet(path)
    own = spark.read.schema(numbers.schema).parquet(path)
    sizes = own.groupBy("part_").agg(F.count(F.lit(1)).alias("size_"))
    bases = sizes.select("part_", F.coalesce(F.sum("size_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    return own.join(F.broadcast(bases), "part_").select(*rows.columns, (F.col("base_") + F.col("at_") + start).alias(name))


def round_robin(rows: DataFrame, models: list[str], order: list[str]) -> DataFrame:
    """``models[i % n]`` in row order."""
    named = F.array(*[F.lit(m) for m in models])
    return numbered(rows, order, "i").withColumn("model", F.element_at(named, (F.col("i") % len(models) + 1).cast("int"))).drop("i")


def ranked(rows: DataFrame, score: str, tie: str) -> DataFrame:
    """Ranks 1..n, the best first; equal scores get different ranks. For tables with a row per
    router."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), tie)))


def against_cube(choices: DataFrame, cube: DataFrame) -> DataFrame:
    """Choices with accuracy and cost of (model, global_index); a missing pair is (0, 0) and marked. A model of which the
    cube has no pair at all is an error."""
    unknown = choices.select("model").distinct().join(cube.select("model").distinct(), "model", "left_anti").limit(10).collect()
    if unknown:
        raise ValueError(f"models that the cube lacks: {sorted(str(r[0]) for r in unknown)}")
    joined = choices.join(cube.select("model", "global_index", "accuracy", "cost").withColumn("found", F.lit(True)), ["model", "global_index"], "left")
    return joined.withColumns({"accuracy": F.coalesce("accuracy", F.lit(0.0)), "cost": F.coalesce("cost", F.lit(0.0)), "missing": F.col("found").isNull()}).drop("found")


def match_code_rows(rows: DataFrame, problems: DataFrame) -> DataFrame:
    """Three-level lookup of a code problem: by global index, by the key's last part, by the first 120
    characters of the prompt; the last duplicate of a level wins."""
    by = lambda key, name: keep_last(problems.select(key.alias(name), F.col("task_id").alias(f"{name}_task"), "pos").where(F.col(name).isNotNull()), [name]).drop("pos")
    out = rows.join(by(F.col("global_idx"), "k1"), F.col("global_index") == F.col("k1"), "left")
    out = out.join(by(F.col("_index"), "k2"), F.substring_index("global_index", "_", -1) == F.col("k2"), "left")
    out = out.join(by(F.left("prompt", F.lit(120)), "k3"), F.left(F.col("question"), F.lit(120)) == F.col("k3"), "left")
    return out.withColumn("task_id", F.coalesce("k1_task", "k2_task", "k3_task")).select(*rows.columns, "task_id")
