"""Model names, prices, inference cost and the combined score."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .containment import either_way

# Fixed values of the combined score.
BETA, COST_MAX, COST_MIN = 0.1, 200.0, 0.0044


#: Rows of a table that is broadcast, at most.
DIMENSION_ROWS = 1 << 20


def dimension(table: DataFrame, most: int = DIMENSION_ROWS) -> DataFrame:
    """``table`` with a broadcast hint if it has at most ``most`` rows; else the join is Spark's choice."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def base_name(model: Column) -> Column:
    return F.regexp_replace(model, "_batch$", "")


def with_prices(rows: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """``rows`` with in_price and out_price: exact by name, else the first price row (by ``pos``)
    whose name contains the model's or is contained in it; null if none. Different models without
    an exact price meet the prices by hashes of their parts (:func:`containment.either_way`)."""
    names = rows.select(F.col(model).alias("m"), base_name(F.col(model)).alias("key")).distinct()
    one = prices.groupBy("model").agg(F.max_by(F.struct("in_price", "out_price"), "pos").alias("x"), F.min("pos").alias("pos"))  # a repeated name: the last price
    dim = dimension(one.select("pos", F.col("model").alias("p"), "x"))
    exact = names.join(dim, F.col("key") == F.col("p"), "left")
    left = exact.where("p is null").select("m", "key")
    met = either_way(left.select(F.col("key").alias("name")), dim.select(F.col("p").alias("other")))
    near = met.join(dim, F.col("other") == F.col("p")).groupBy(F.col("name").alias("key")).agg(F.min_by("x", "pos").alias("x"))
    found = exact.where("p is not null").select("m", "x.*").unionByName(left.join(near, "key").select("m", "x.*"))
    return rows.join(found, rows[model].eqNullSafe(found["m"]), "left").drop("m")


def inference_cost(in_tokens: Column, out_tokens: Column, in_price: Column, out_price: Column) -> Column:
    """Price of a call; no usage or no price is 0."""
    return F.coalesce(in_tokens / 1e6 * in_price + out_tokens / 1e6 * out_price, F.lit(0.0))


def cost_backfill(cost: Column, in_tokens: Column, out_tokens: Column, in_price: Column, out_price: Column) -> Column:
    """A stored cost of 0 is recomputed from the counts, only if both are not zero."""
    again = F.when((in_tokens != 0) & (out_tokens != 0), inference_cost(in_tokens, out_tokens, in_price, out_price)).otherwise(cost)
    return F.when(cost == 0.0, again).otherwise(cost)


def arena(cost: Column, accuracy: Column, mode: str = "clamped") -> Column:
    """The combined score. ``clamped``: null for a cost of 0 and less or an accuracy outside 0..1,
    cost held within its bounds; ``raw``: no guard (null where undefined); ``zero``: 0 for a cost of 0
    and less, or where undefined."""
    top, low = math.log2(COST_MAX), math.log2(COST_MIN)
    held = F.greatest(F.lit(COST_MIN), F.least(cost, F.lit(COST_MAX))) if mode == "clamped" else cost
    c = (F.lit(top) - F.log2(F.when(held > 0, held))) / (top - low)
    score = F.try_divide((1 + BETA) * accuracy * c, BETA * accuracy + c)
    if mode == "clamped":
        return F.when((cost > 0) & accuracy.between(0, 1), score)
    return score if mode == "raw" else F.when(cost <= 0, 0.0).otherwise(F.coalesce(score, F.lit(0.0)))


def router_summary(rows: DataFrame, by: str = "router", signed: bool = False) -> DataFrame:
    """Accuracy over rows that have one, total cost over costs above 0 (``signed``: other than 0),
    cost per query and per thousand over all rows."""
    counted = F.col("cost") != 0 if signed else F.col("cost") > 0
    total = F.coalesce(F.sum(F.when(counted, F.col("cost"))), F.lit(0.0))
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("num_queries"), F.avg("accuracy").alias("accuracy"), total.alias("total_cost"))
    per = F.col("total_cost") / F.col("num_queries")
    return out.withColumn("avg_cost_per_query", per).withColumn("avg_cost_per_1000", per * 1000)


def canonical(rows: DataFrame, registry: DataFrame, aliases: DataFrame, model: str = "model") -> DataFrame:
    """``rows`` with canonical (null if unknown) and known: registered names are themselves, others
    go through the alias table (of a repeated alias the greatest name counts)."""
    names = dimension(registry.select(F.col("model").alias("r")).distinct())
    other = dimension(aliases.groupBy(F.col("alias").alias("a")).agg(F.max("model").alias("am")))
    joined = rows.join(names, rows[model] == F.col("r"), "left").join(other, rows[model] == F.col("a"), "left")
    return joined.withColumn("canonical", F.coalesce("r", "am")).withColumn("known", F.col("canonical").isNotNull()).drop("r", "a", "am")


def lenient(rows: DataFrame, registry: DataFrame, aliases: DataFrame, model: str = "model") -> tuple[DataFrame, DataFrame]:
    """``rows`` with canonical, which is the name itself where none is known, and the distinct names
    that are not known."""
    named = canonical(rows, registry, aliases, model)
    missing = named.where(~F.col("known")).select(model).distinct()
    return named.withColumn("canonical", F.coalesce("canonical", model)).drop("known"), missing
