"""A router's submission from files to its summary: generate, check, score, and the whole chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import costs, evaluate, keyed, validate
from .sources import readers


def _models(spark: SparkSession, config: str) -> DataFrame:
    readers.check_router_config(spark, config)
    return readers.router_config(spark, config)


def generate(spark: SparkSession, config: str, datasets: str, split: str, folder: str) -> None:
    """Predictions of the example router (its models in turn) for a split, as a file of its name."""
    held = _models(spark, config)
    models = [r.model for r in held.orderBy("pos").collect()]  # a configuration's few models
    rows = keyed.numbered(readers.dataset(spark, datasets, split), ["global_index"], "pos").withColumnRenamed("prompt_formatted", "prompt")
    chosen = evaluate.generate(rows, F.get(F.array(*map(F.lit, models)), (F.col("pos") % len(models)).cast("int")), held)
    back = rows.select("global_index", "pos").join(chosen, "global_index")
    out = back.crossJoin(F.broadcast(held.select(F.col("router_name").alias("router")).limit(1)))
    readers.write_predictions(out.withColumnRenamed("global_index", "global index"), folder)


def check(spark: SparkSession, predictions: str, config: str, datasets: str, split: str, aliases: DataFrame | None = None, generated: bool = False, registry: DataFrame | None = None, prices: str | None = None) -> DataFrame:
    """(global_index, code) of each error of a prediction file: rows, the number of rows (a null key)
    and, with ``generated``, the generated results. With ``registry`` the configured models must be
    known, with ``prices`` (a price file) all used models must have a price (null keys too)."""
    rows = readers.predictions(spark, predictions).withColumn("pos", F.monotonically_increasing_id())  # a label of rows, of no order
    data = readers.dataset(spark, datasets, split).withColumnRenamed("prompt_formatted", "prompt")
    models = _models(spark, config).select("model")
    by_pos = validate.row_errors(rows, data, models, aliases)
    if generated:
        raw = rows.select("pos", validate.payload_error(F.to_json("generated_result", {"ignoreNullFields": "false"})).alias("code"))
        by_pos = by_pos.unionByName(raw.where("code is not null"))
    codes = [validate.size_ok(rows, data.count()).where(~F.col("ok")).select(F.lit("wrong_size").alias("code"))]
    if registry is not None:
        known = costs.canonical(models, registry, spark.createDataFrame([], "alias string, model string") if aliases is None else aliases)
        codes.append(known.where(~F.col("known")).select(F.concat(F.lit("unregistered_model "), "model").alias("code")))
    if prices is not None:
        used = validate.used_models(rows.select(F.col("prediction").alias("model")), models).where("model <> ''")
        codes.append(costs.with_prices(used, readers.prices(spark, prices)).where("in_price is null").select(F.concat(F.lit("no_price "), "model").alias("code")))
    out = by_pos.join(rows.select("pos", "global_index"), "pos").select("global_index", "code")
    for c in codes:
        out = out.unionByName(c.select(F.lit(None).cast("string").alias("global_index"), "code"))
    return out


def score(spark: SparkSession, predictions: str, router: str) -> DataFrame:
    """One row: the router's accuracy, costs and combined score; an empty file is an error."""
    rows = readers.predictions(spark, predictions).select(F.lit(router).alias("router"), "cost", "accuracy")
    out = costs.router_summary(evaluate.require_rows(rows, "router"))
    known = F.coalesce("accuracy", F.lit(0.0))
    return out.withColumn("accuracy", known).withColumn("arena_score", costs.arena(F.col("avg_cost_per_1000"), known, "zero"))


def process(spark: SparkSession, predictions: str, config: str, datasets: str, split: str, router: str, runs: str, run_id: str) -> DataFrame:
    """Check and score a submission and write its summary; errors end it before it is scored."""
    found, more = evaluate.preview(check(spark, predictions, config, datasets, split), ["global_index", "code"])
    lines = [f"{r.global_index}: {r.code}" for r in found.collect()]
    if lines:
        raise ValueError("; ".join(lines) + (f"; and {more} more" if more else ""))
    summary = score(spark, predictions, router)
    readers.write_summary(summary, runs, run_id)
    return summary
