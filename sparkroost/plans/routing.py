"""Queries on routing: costs, scores, caches, joins, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import costs, evaluate, keyed, validate
from .views import MODELS, tables, view, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql)
        return f

    return add


#: Prices of distinct models: exact by base name, else the first price in part.
PRICED = """priced AS (SELECT m.model, coalesce(e.in_price, p.in_price) AS in_price, coalesce(e.out_price, p.out_price) AS out_price, e.pos IS NOT NULL AS exact
 FROM (SELECT DISTINCT model, regexp_replace(model, '_batch$', '') AS b FROM predictions) m
 LEFT JOIN prices e ON e.model = m.b
 LEFT JOIN (SELECT b, min(pos) AS pos FROM (SELECT DISTINCT regexp_replace(model, '_batch$', '') AS b FROM predictions) x
            JOIN prices q ON contains(x.b, q.model) OR contains(q.model, x.b) GROUP BY b) f ON f.b = m.b
 LEFT JOIN prices p ON p.pos = f.pos),
costed AS (SELECT predictions.*, coalesce(in_tok / 1e6 * in_price + out_tok / 1e6 * out_price, 0.0) AS cost FROM predictions JOIN priced USING (model))"""
ARENA = "CASE WHEN {c} > 0 AND {a} BETWEEN 0 AND 1 THEN 1.1 * {a} * {v} / nullif(0.1 * {a} + {v}, 0) END"


def _arena(c: str, a: str) -> str:
    v = f"((log2(200.0) - log2(greatest(0.0044, least({c}, 200.0)))) / (log2(200.0) - log2(0.0044)))"
    return ARENA.format(c=c, a=a, v=v)


def costed(spark, sf_dir: str) -> DataFrame:
    rows = costs.with_prices(view(spark, sf_dir, "predictions"), view(spark, sf_dir, "prices"))
    return rows.withColumn("cost", costs.inference_cost(F.col("in_tok"), F.col("out_tok"), F.col("in_price"), F.col("out_price")))


def _r(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


SUMMARY = """s AS (SELECT router, count(*) AS num_queries, avg(accuracy) AS accuracy, coalesce(sum(CASE WHEN {w} THEN cost END), 0.0) AS total_cost FROM costed GROUP BY router)"""


@query(f"""WITH {PRICED}, {SUMMARY.format(w='cost > 0')},
a AS (SELECT *, total_cost / num_queries * 1000 AS per_1000 FROM s)
SELECT router, num_queries, round(accuracy, 6) AS accuracy, round(total_cost, 8) AS total_cost, round(total_cost / num_queries, 6) AS avg_cost_per_query,
 round(per_1000, 6) AS avg_cost_per_1000, round({_arena('per_1000', 'accuracy')}, 6) AS arena_score,
 row_number() OVER (ORDER BY round({_arena('per_1000', 'accuracy')}, 9) DESC NULLS LAST, router) AS rank FROM a""")
def router_scores(spark, sf_dir: str) -> DataFrame:
    """Routers ranked by the combined score."""
    s = costs.router_summary(costed(spark, sf_dir))
    s = s.withColumn("arena_score", costs.arena(F.col("avg_cost_per_1000"), F.col("accuracy"))).withColumn("key", F.round("arena_score", 9))
    return keyed.ranked(s, "key", "router").drop("key").withColumns({"total_cost": F.round("total_cost", 8)} | _r("accuracy", "avg_cost_per_query", "avg_cost_per_1000", "arena_score")).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {PRICED}, signed AS (SELECT router, accuracy, CASE WHEN pos % 10 = 0 THEN -cost ELSE cost END AS cost FROM costed),
s AS (SELECT router, count(*) AS num_queries, avg(accuracy) AS accuracy, coalesce(sum(CASE WHEN cost <> 0 THEN cost END), 0.0) AS total_cost FROM signed GROUP BY router)
SELECT router, num_queries, round(accuracy, 6) AS accuracy, round(total_cost, 8) AS total_cost FROM s""")
def router_scores_signed_cost(spark, sf_dir: str) -> DataFrame:
    rows = costed(spark, sf_dir).withColumn("cost", F.when(F.col("pos") % 10 == 0, -F.col("cost")).otherwise(F.col("cost")))
    return costs.router_summary(rows, signed=True).select("router", "num_queries", F.round("accuracy", 6).alias("accuracy"), F.round("total_cost", 8).alias("total_cost"))


#: Costs below, within and above the bounds, and accuracies from 0 to 1, by supplier.
_GRID = "SELECT s_suppkey, CAST(s_suppkey % 311 - 5 AS DOUBLE) * CASE WHEN s_suppkey % 4 = 0 THEN 0.001 ELSE 1.0 END AS cost, CAST(s_nationkey AS DOUBLE) / 24 AS accuracy FROM supplier"
_V = "((log2(200.0) - log2(nullif(greatest({c}, 0), 0))) / (log2(200.0) - log2(0.0044)))"


@query(f"""WITH g AS ({_GRID}) SELECT s_suppkey, round(accuracy, 6) AS accuracy, round({_arena('cost', 'accuracy')}, 6) AS clamped,
 round(1.1 * accuracy * {_V.format(c='cost')} / nullif(0.1 * accuracy + {_V.format(c='cost')}, 0), 6) AS raw,
 round(CASE WHEN cost <= 0 THEN 0 ELSE coalesce(1.1 * accuracy * {_V.format(c='cost')} / nullif(0.1 * accuracy + {_V.format(c='cost')}, 0), 0) END, 6) AS zero FROM g""")
def arena_curve(spark, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "supplier")
    g = spark.sql(_GRID)
    return g.select("s_suppkey", F.round("accuracy", 6).alias("accuracy"), *[F.round(costs.arena(F.col("cost"), F.col("accuracy"), m), 6).alias(m) for m in ("clamped", "raw", "zero")])


@query(f"WITH {PRICED} SELECT pos, model, in_tok, out_tok, round(cost, 10) AS cost FROM costed")
def query_cost(spark, sf_dir: str) -> DataFrame:
    return costed(spark, sf_dir).select("pos", "model", "in_tok", "out_tok", F.round("cost", 10).alias("cost"))


@query(f"""WITH {PRICED}, z AS (SELECT c.*, p.in_price, p.out_price, CASE WHEN pos % 3 = 0 THEN 0.0 ELSE cost END AS held FROM costed c JOIN priced p USING (model))
SELECT pos, round(CASE WHEN held = 0 AND in_tok <> 0 AND out_tok <> 0 THEN coalesce(in_tok / 1e6 * in_price + out_tok / 1e6 * out_price, 0) ELSE held END, 10) AS cost FROM z WHERE in_tok IS NOT NULL""")
def cost_backfill(spark, sf_dir: str) -> DataFrame:
    rows = costed(spark, sf_dir).where("in_tok is not null").withColumn("held", F.when(F.col("pos") % 3 == 0, 0.0).otherwise(F.col("cost")))
    return rows.select("pos", F.round(costs.cost_backfill(F.col("held"), F.col("in_tok"), F.col("out_tok"), F.col("in_price"), F.col("out_price")), 10).alias("cost"))


@query("SELECT p.model, coalesce(r.model, a.model) AS canonical, coalesce(r.model, a.model) IS NOT NULL AS known, count(*) AS n FROM predictions p LEFT JOIN registry r ON r.model = p.model LEFT JOIN aliases a ON a.alias = p.model GROUP BY ALL")
def model_registry_check(spark, sf_dir: str) -> DataFrame:
    rows = costs.canonical(view(spark, sf_dir, "predictions"), view(spark, sf_dir, "registry"), view(spark, sf_dir, "aliases"))
    return rows.groupBy("model", "canonical", "known").agg(F.count(F.lit(1)).alias("n"))


_DS = "CASE split_part(global_index, '_', 1) WHEN 'ArcMMLU' THEN 'MMLUPro' WHEN 'Ethics' THEN 'Ethics_commonsense' WHEN 'GeoGraphyData' THEN 'GeoGraphyData_100k' WHEN 'SuperGLUE' THEN 'SuperGLUE-RC' WHEN 'WMT19' THEN 'WMT19-cs-en' ELSE split_part(global_index, '_', 1) END"


@query(f"WITH {PRICED} SELECT {_DS} AS dataset, count(*) AS n, round(avg(accuracy), 6) AS score, arg_min(model, pos) AS first_label FROM costed GROUP BY 1")
def dataset_rollup(spark, sf_dir: str) -> DataFrame:
    from ..functions.prompts import dataset_of

    return costed(spark, sf_dir).groupBy(dataset_of(F.col("global_index")).alias("dataset")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("accuracy"), 6).alias("score"), F.min_by("model", "pos").alias("first_label"))


@query(f"WITH {PRICED} SELECT model, round(coalesce(avg(CASE WHEN cost <> 0 THEN cost END), 0.0), 10) AS avg_cost FROM costed GROUP BY model")
def avg_cost_per_sample(spark, sf_dir: str) -> DataFrame:
    return costed(spark, sf_dir).groupBy("model").agg(F.round(F.coalesce(F.avg(F.when(F.col("cost") != 0, F.col("cost"))), F.lit(0.0)), 10).alias("avg_cost"))


@query("SELECT model, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, CAST(sum(in_tok + out_tok) AS BIGINT) AS tokens, round(sum(in_tok + out_tok) FILTER (success) / nullif(count(*) FILTER (success), 0), 6) AS per_success FROM predictions GROUP BY model")
def token_stats(spark, sf_dir: str) -> DataFrame:
    both = F.col("in_tok") + F.col("out_tok")
    return view(spark, sf_dir, "predictions").groupBy("model").agg(F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.sum(both).alias("tokens"), F.round(F.avg(F.when(F.col("success"), both)), 6).alias("per_success"))


@query("SELECT CASE WHEN NOT success THEN 'failed' WHEN accuracy IS NULL THEN 'open' ELSE 'evaluated' END AS status, count(*) AS n FROM predictions GROUP BY 1")
def status_counts(spark, sf_dir: str) -> DataFrame:
    status = F.when(~F.col("success"), "failed").when(F.col("accuracy").isNull(), "open").otherwise("evaluated")
    return view(spark, sf_dir, "predictions").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT model, k, arg_max(pos, pos) AS pos, arg_max(value, pos) AS value FROM cache GROUP BY model, k")
def cube_last_wins(spark, sf_dir: str) -> DataFrame:
    return keyed.keep_last(view(spark, sf_dir, "cache").select("model", "k", "pos", "value"), ["model", "k"])


@query("SELECT model, k, arg_min(pos, pos) AS pos, arg_min(value, pos) AS value FROM cache WHERE success GROUP BY model, k")
def cache_first_success(spark, sf_dir: str) -> DataFrame:
    return keyed.first_success(view(spark, sf_dir, "cache"), ["model", "k"]).select("model", "k", "pos", "value")


_SPLIT = """l AS (SELECT model, k, arg_max(value, pos) AS value, arg_max(coalesce(score, -1), pos) AS sc FROM cache WHERE (score IS NULL) = {} GROUP BY model, k)"""


def _half(spark, sf_dir: str, again: bool) -> DataFrame:
    """The last evaluated entries of a cache, or the last of those that a run made again without evaluation."""
    rows = keyed.keep_last(view(spark, sf_dir, "cache").where(F.col("score").isNull() == again).select("model", "k", "pos", "value", F.coalesce("score", F.lit(-1.0)).alias("sc")), ["model", "k"])
    return rows.select("model", "k", "value", F.when(F.col("sc") >= 0, F.col("sc")).alias("score"))


@query(f"WITH {_SPLIT.format('false').replace('l AS', 'b AS', 1)}, {_SPLIT.format('true').replace('l AS', 'n AS', 1)} SELECT model, k, value FROM n UNION ALL SELECT model, k, value FROM b ANTI JOIN n USING (model, k)")
def cache_upsert(spark, sf_dir: str) -> DataFrame:
    return keyed.upsert(_half(spark, sf_dir, False), _half(spark, sf_dir, True), ["model", "k"]).select("model", "k", "value")


@query(f"""WITH {_SPLIT.format('false').replace('l AS', 'b AS', 1)}, {_SPLIT.format('true').replace('l AS', 'n AS', 1)}
SELECT coalesce(n.model, b.model) AS model, coalesce(n.k, b.k) AS k, coalesce(n.value, b.value) AS value, coalesce(nullif(n.sc, -1), nullif(b.sc, -1)) AS score
FROM b FULL JOIN n ON b.model = n.model AND b.k = n.k""")
def cache_merge_keep_eval(spark, sf_dir: str) -> DataFrame:
    return keyed.merge_keep(_half(spark, sf_dir, False), _half(spark, sf_dir, True), ["model", "k"], "score")


@query("SELECT pos, model, out_tok AS k FROM predictions WHERE accuracy IS NULL AND NOT EXISTS (SELECT 1 FROM cache c WHERE c.success AND c.k % 3 <> 0 AND c.model = predictions.model AND c.k = predictions.out_tok)")
def pending_rows(spark, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "predictions").where("accuracy is null").select("pos", "model", F.col("out_tok").alias("k"))
    return keyed.pending(rows, view(spark, sf_dir, "cache").where("success and k % 3 <> 0"), ["model", "k"]).select("pos", "model", "k")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS choice FROM embeddings")
def argmax_route(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", keyed.argmax(F.col("embedding")).cast("long").alias("choice"))


@query("SELECT vec_id, unnest(['alder', 'cedar']) AS model, unnest([embedding[1], embedding[3]]) AS confidence FROM embeddings")
def confidence_map(spark, sf_dir: str) -> DataFrame:
    arr = lambda *x: F.array(*map(F.lit, x))
    m = keyed.confidence_map(arr("alder", "birch", "cedar"), F.col("embedding"), arr(1.0, None, 2.0))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.explode(m).alias("model", "confidence"))


@query("SELECT pos, " + "CASE (row_number() OVER (ORDER BY pos) - 1) % 9 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS)) + " END AS assigned FROM predictions")
def round_robin(spark, sf_dir: str) -> DataFrame:
    return keyed.round_robin(view(spark, sf_dir, "predictions").select("pos"), MODELS, ["pos"]).select("pos", F.col("model").alias("assigned"))


_CUBE = "cube AS (SELECT model, k, arg_max(coalesce(score, 0.5), pos) AS accuracy, arg_max(value, pos) AS cost FROM cache WHERE (k + length(model)) % 4 <> 0 GROUP BY model, k)"


def _vs(spark, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "cache").where("(k + length(model)) % 4 <> 0").select("model", F.col("k").alias("global_index"), "pos", F.coalesce("score", F.lit(0.5)).alias("accuracy"), F.col("value").alias("cost"))
    choices = view(spark, sf_dir, "predictions").select("router", "pos", "model", F.col("out_tok").alias("global_index"))
    return keyed.against_cube(choices, keyed.keep_last(rows, ["model", "global_index"]))


@query(f"WITH {_CUBE} SELECT p.router, p.pos, coalesce(c.accuracy, 0.0) AS accuracy, coalesce(c.cost, 0.0) AS cost, c.model IS NULL AS missing FROM predictions p LEFT JOIN cube c ON c.model = p.model AND c.k = p.out_tok")
def router_vs_cube(spark, sf_dir: str) -> DataFrame:
    return _vs(spark, sf_dir).select("router", "pos", "accuracy", "cost", "missing")


@query(f"WITH {_CUBE} SELECT p.router, count(*) AS n, count(*) FILTER (c.model IS NULL) AS missing FROM predictions p LEFT JOIN cube c ON c.model = p.model AND c.k = p.out_tok GROUP BY p.router")
def missing_pairs(spark, sf_dir: str) -> DataFrame:
    return _vs(spark, sf_dir).groupBy("router").agg(F.count(F.lit(1)).alias("n"), F.count_if("missing").alias("missing"))


@query("SELECT p.router, concat('level', CAST(n.n_regionkey AS VARCHAR)) AS level, count(*) AS n, round(avg(p.accuracy), 6) AS accuracy FROM predictions p JOIN nation n ON n.n_nationkey = p.out_tok % 25 GROUP BY 1, 2")
def difficulty_breakdown(spark, sf_dir: str) -> DataFrame:
    """Choices by the difficulty of their question, which every one must have."""
    rows = view(spark, sf_dir, "predictions").withColumn("question", F.col("out_tok") % 25)
    levels = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("question"), F.concat(F.lit("level"), F.col("n_regionkey").cast("string")).alias("level"))
    return evaluate.require_match(rows, levels, ["question"]).groupBy("router", "level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("accuracy"), 6).alias("accuracy"))


_RAW = """SELECT event_id AS pos, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'p0' ELSE concat('q', CAST(event_id AS VARCHAR(19))) END AS global_index,
 CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'other' ELSE props END AS prompt, CASE event_type WHEN 'view' THEN 'alder' WHEN 'error' THEN NULL WHEN 'click' THEN 'oak' ELSE 'elm-mini' END AS prediction FROM events"""


@query(f"""WITH r AS ({_RAW}), d AS (SELECT concat('q', CAST(event_id AS VARCHAR)) AS k, props AS wanted FROM events),
j AS (SELECT r.*, d.k, d.wanted, m.model AS m, CASE WHEN coalesce(global_index, '') = '' THEN 'missing_key' WHEN d.k IS NULL THEN 'unknown_key' WHEN coalesce(prompt, '') = '' THEN 'missing_prompt' END AS stop
 FROM r LEFT JOIN d ON d.k = r.global_index LEFT JOIN registry m ON m.model = r.prediction)
SELECT pos, stop AS code FROM j WHERE stop IS NOT NULL
UNION ALL SELECT pos, 'prompt_mismatch' FROM j WHERE stop IS NULL AND prompt <> wanted
UNION ALL SELECT pos, 'missing_prediction' FROM j WHERE stop IS NULL AND coalesce(prediction, '') = ''
UNION ALL SELECT pos, 'unknown_model' FROM j WHERE stop IS NULL AND coalesce(prediction, '') <> '' AND m IS NULL""")
def validate_rows(spark, sf_dir: str) -> DataFrame:
    registry = view(spark, sf_dir, "registry")
    tables(spark, sf_dir, "events")
    data = spark.table("events").select(F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("global_index"), F.col("props").alias("prompt"))
    return validate.row_errors(spark.sql(_RAW), data, registry)


#: Generated results in JSON, with every fault of the ladder.
ANY_PAYLOAD = """SELECT event_id AS pos, CASE WHEN event_id % 29 = 0 THEN 'null' WHEN event_id % 31 = 0 THEN '[1]' ELSE concat('{', a, CASE WHEN a <> '' AND concat(s, u) <> '' THEN ',' ELSE '' END, s, CASE WHEN s <> '' AND u <> '' THEN ',' ELSE '' END, u, '}') END AS raw
 FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '"generated_answer":5' WHEN 2 THEN '"generated_answer":""' WHEN 3 THEN '"generated_answer":"  "' WHEN 4 THEN '"generated_answer":null' ELSE '"generated_answer":"x"' END AS a,
  CASE user_id % 11 WHEN 0 THEN '' WHEN 1 THEN '"success":false' WHEN 2 THEN '"success":"yes"' WHEN 3 THEN '"success":""' WHEN 4 THEN '"success":1' WHEN 5 THEN '"success":0' WHEN 6 THEN '"success":null' WHEN 7 THEN '"success":[]' WHEN 8 THEN '"success":[0]' ELSE '"success":true' END AS s,
  CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'click' THEN '"token_usage":null' ELSE '"token_usage":{}' END AS u FROM events) AS parts"""


_USED = PRICED[: PRICED.index(",\ncosted AS")].replace("FROM predictions", "FROM (SELECT model FROM predictions UNION SELECT model FROM registry) AS used")


@query(f"WITH {_USED} SELECT model, exact, in_price IS NOT NULL AS priced FROM priced")
def validate_prices(spark, sf_dir: str) -> DataFrame:
    p, prices = view(spark, sf_dir, "predictions"), view(spark, sf_dir, "prices")
    used = validate.used_models(p, view(spark, sf_dir, "registry"))
    out = costs.with_prices(used, prices)
    names = F.broadcast(prices.select(F.col("model").alias("x")))
    return out.join(names, costs.base_name(F.col("model")) == F.col("x"), "left").select("model", F.col("x").isNotNull().alias("exact"), F.col("in_price").isNotNull().alias("priced"))


@query("SELECT count(*) AS pairs, count(DISTINCT model) AS models FROM (SELECT DISTINCT model, k FROM cache)")
def cube_size(spark, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "cache").select("model", "k").distinct().agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("model").alias("models"))


@query("SELECT model FROM predictions UNION SELECT model FROM registry")
def used_models(spark, sf_dir: str) -> DataFrame:
    return validate.used_models(view(spark, sf_dir, "predictions"), view(spark, sf_dir, "registry"))


@query("SELECT p.pos, coalesce(r.model, a.model, p.model) AS canonical, r.model IS NULL AND a.model IS NULL AS missing FROM predictions p LEFT JOIN registry r ON r.model = p.model LEFT JOIN aliases a ON a.alias = p.model")
def lenient_names(spark, sf_dir: str) -> DataFrame:
    """Known models by their own names, others unchanged; the missing ones are marked."""
    named, missing = costs.lenient(view(spark, sf_dir, "predictions"), view(spark, sf_dir, "registry"), view(spark, sf_dir, "aliases"))
    return named.join(costs.dimension(missing.withColumn("missing", F.lit(True))), "model", "left").select("pos", "canonical", F.coalesce("missing", F.lit(False)).alias("missing"))
