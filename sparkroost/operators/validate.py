"""Submission checks: one row for each error, in the checks' order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .costs import dimension


def row_errors(rows: DataFrame, dataset: DataFrame, models: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(pos, code) of each error. A row without key, with an unknown key or without prompt is not
    looked at further; another prompt than the data set's does not stop the later checks. Of a repeated
    key of the data set the greatest prompt counts. A model is known by its own name or, with
    ``aliases``, by its canonical one."""
    known = dataset.groupBy(F.col("global_index").alias("k")).agg(F.max("prompt").alias("wanted"))
    allowed = models.select(F.col("model").alias("m"))
    if aliases is not None:
        same = aliases.select(F.col("alias").alias("m"), F.col("model").alias("to"))
        allowed = allowed.union(same.join(allowed.withColumnRenamed("m", "to"), "to").select("m"))
    names = dimension(allowed.distinct())
    j = rows.join(known, rows["global_index"] == F.col("k"), "left").join(names, rows["prediction"] == F.col("m"), "left")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    stop = F.when(blank(F.col("global_index")), "missing_key").when(F.col("k").isNull(), "unknown_key").when(blank(F.col("prompt")), "missing_prompt")
    later = F.array_compact(
        F.array(
            F.when(~F.col("prompt").eqNullSafe(F.col("wanted")), "prompt_mismatch"),
            F.when(blank(F.col("prediction")), "missing_prediction").when(F.col("m").isNull(), "unknown_model"),
        )
    )
    return j.select("pos", F.explode(F.when(stop.isNotNull(), F.array(stop)).otherwise(later)).alias("code"))


#: Fields that a generated result must have.
RESULT_FIELDS = ("generated_answer", "success", "token_usage")


def payload_error(raw: Column) -> Column:
    """The first fault of a generated result in JSON, by the ladder; null if none. A ``success`` that
    is no boolean counts as Python reads it: empty texts and lists, 0 and null are false."""
    v = F.try_parse_json(raw)
    kind = lambda field: F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
    text, success = F.try_variant_get(v, "$.generated_answer", "string"), F.try_variant_get(v, "$.success", "string")
    lacks = F.lit(False)
    for field in RESULT_FIELDS:
        lacks = lacks | kind(field).isNull()
    truthy = F.when(kind("success") == "VOID", False).when(kind("success") == "STRING", success != "").otherwise(~success.isin("false", "[]", "{}") & (F.coalesce(success.try_cast("double"), F.lit(1.0)) != 0))
    return (
        F.when(v.isNull() | (F.schema_of_variant(v) == "VOID"), "null_result")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "not_object")
        .when(lacks, "missing_field")
        .when(kind("generated_answer") != "STRING", "answer_not_text")
        .when(truthy & (strip(text) == ""), "success_without_answer")
        .when(kind("success") != "BOOLEAN", "success_not_boolean")
    )


def size_ok(rows: DataFrame, expected: int) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("ok", F.col("n") == expected)


def used_models(predictions: DataFrame, config: DataFrame) -> DataFrame:
    """Distinct models of predictions and config."""
    return predictions.select("model").union(config.select("model")).where("model is not null").distinct()
