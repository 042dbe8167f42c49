"""Queries that go through files and clients: what is written is read back."""

from __future__ import annotations

import base64
import pickle
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import code_run
from ..operators import evaluate as E
from ..operators import keyed
from ..session import scratch
from ..sources import inference, readers
from ..streaming.resume import resume
from .views import MODELS, tables, view, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql)
        return f

    return add


@query("SELECT router, global_index, model AS prediction, out_tok AS output_tokens, success, accuracy FROM predictions")
def prediction_files(spark, sf_dir: str) -> DataFrame:
    """A prediction file for each router, written and read."""
    folder = scratch(spark, "predictions")
    usage = F.struct(F.col("in_tok").alias("input_tokens"), F.col("out_tok").alias("output_tokens"))
    rows = view(spark, sf_dir, "predictions").select("router", "pos", F.col("global_index").alias("global index"), F.col("model").alias("prediction"), F.struct(F.lit("x").alias("generated_answer"), "success", usage.alias("token_usage")).alias("generated_result"), "accuracy")
    readers.write_predictions(rows, folder)
    read = readers.predictions(spark, folder).withColumn("router", F.regexp_extract(F.col("_metadata.file_path"), "router=([^/]+)/", 1))
    return read.select("router", "global_index", "prediction", F.col("generated_result.token_usage.output_tokens").alias("output_tokens"), "generated_result.success", "accuracy")


_LINES = """SELECT event_id, CASE event_type WHEN 'error' THEN concat('not json ', props) WHEN 'view' THEN '' WHEN 'signup' THEN concat('{"global_index": "', CAST(event_id AS VARCHAR(19)), '", "success": tr')
 ELSE concat('{"global_index": "q', CAST(event_id AS VARCHAR(19)), '", "success": ', CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END, ', "token_usage": {"input_tokens": ', CAST(user_id AS VARCHAR(19)), '}}') END AS value FROM events"""


@query(f"""SELECT json_extract_string(value, '$.global_index') AS global_index, CAST(json_extract(value, '$.success') AS BOOLEAN) AS success, CAST(json_extract(value, '$.token_usage.input_tokens') AS BIGINT) AS input_tokens
 FROM ({_LINES}) AS l WHERE json_valid(value)""")
def malformed_lines(spark, sf_dir: str) -> DataFrame:
    """JSON lines among blank, broken and cut ones."""
    folder = scratch(spark, "lines")
    tables(spark, sf_dir, "events")
    spark.sql(_LINES).select("value").write.mode("overwrite").text(folder)
    return readers.json_lines(spark, folder).select("global_index", "success", F.col("token_usage.input_tokens").alias("input_tokens"))


_SECOND = "model IN ('alder', 'fir')"


@query(f"""SELECT model, CAST(pos AS VARCHAR) AS global_index, CASE WHEN {_SECOND} THEN score + 1 ELSE score END AS score FROM cache WHERE NOT ({_SECOND}) OR success""")
def cache_files(spark, sf_dir: str) -> DataFrame:
    """The scored cache by model; a second write replaces the files of its models alone."""
    folder = scratch(spark, "cache")
    rows = view(spark, sf_dir, "cache").select("model", F.col("pos").cast("string").alias("global_index"), "success", F.struct("score").alias("evaluation_result"))
    readers.write_cache(rows, folder)
    again = rows.where(_SECOND).where("success").withColumn("evaluation_result", F.struct((F.col("evaluation_result.score") + 1).alias("score")))
    readers.write_cache(again, folder)
    return readers.json_lines(spark, folder, readers.CACHE + ", model string").select("model", "global_index", F.col("evaluation_result.score").alias("score"))


@query("SELECT CAST(n_nationkey AS INT) AS pos, n_name AS model, CAST(n_nationkey / 10.0 AS DOUBLE) AS in_price, CAST(n_regionkey + 0.5 AS DOUBLE) AS out_price FROM nation")
def price_file(spark, sf_dir: str) -> DataFrame:
    """A price table as the JSON object that it is stored as, in its order: a model for each nation."""
    folder = scratch(spark, "prices")
    tables(spark, sf_dir, "nation")
    entry = F.struct((F.col("n_nationkey") / 10).alias("input_token_price_per_million"), (F.col("n_regionkey") + 0.5).cast("double").alias("output_token_price_per_million"))
    ordered = spark.table("nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", entry.alias("price")))).alias("x"))  # one object is one row
    ordered.select(F.to_json(F.map_from_entries(F.transform("x", lambda r: F.struct(r["n_name"], r["price"])))).alias("value")).coalesce(1).write.mode("overwrite").text(folder)
    return readers.prices(spark, folder)


@query("""SELECT concat('r', CAST(r_regionkey AS VARCHAR)) AS router_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS pos, n_name AS model FROM region JOIN nation ON n_regionkey = r_regionkey""")
def router_config_files(spark, sf_dir: str) -> DataFrame:
    """Configurations with a list of names, or a map of names to costs."""
    folder = scratch(spark, "routers")
    tables(spark, sf_dir, "region", "nation")
    rows = spark.sql("SELECT r_regionkey, array_sort(collect_list(struct(n_nationkey, n_name))).n_name AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
    named = F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("router_name")
    listed = F.to_json(F.struct(F.struct(named, F.col("names").alias("models")).alias("pipeline_params")))
    mapped = F.to_json(F.struct(F.struct(named, F.map_from_arrays("names", F.transform("names", lambda _: F.lit(0.5))).alias("models")).alias("pipeline_params")))
    rows.select("r_regionkey", F.when(F.col("r_regionkey") % 2 == 0, listed).otherwise(mapped).alias("value")).write.mode("overwrite").partitionBy("r_regionkey").text(folder)
    return readers.router_config(spark, f"{folder}/*/").select("router_name", "pos", "model")


@query("SELECT split, CAST(item_id AS VARCHAR) AS global_index, text AS prompt_formatted FROM benchmark, (VALUES ('sub_10'), ('full')) AS s(split) WHERE split = 'full' OR length(text) > 150")
def split_files(spark, sf_dir: str) -> DataFrame:
    """Both splits of the prompts, written and read."""
    folder = scratch(spark, "splits")
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("global_index"), F.col("text").alias("prompt_formatted"))
    failed = readers.write_splits({"sub_10": rows.where(F.length("prompt_formatted") > 150), "full": rows}, folder)
    if failed:
        raise OSError("; ".join(failed))
    own = [readers.dataset(spark, folder, s).select(F.lit(s).alias("split"), "*") for s in ("sub_10", "full")]
    return own[0].unionByName(own[1])


@query("SELECT p_partkey AS dataset, metric FROM (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part WHERE p_size > 45), (VALUES ('math_metric'), ('exact_match')) AS m(metric) WHERE metric = 'exact_match' OR length(p_name) % 2 = 0")
def eval_config_files(spark, sf_dir: str) -> DataFrame:
    """A folder of evaluation configurations, one pretty-printed file for each data set (a large part). The files lie side
    by side and are moved there by their tasks, so that neither lists folders one by one nor waits for the driver."""
    folder = scratch(spark, "configs")
    tables(spark, sf_dir, "part")
    rows = spark.sql("SELECT CAST(p_partkey AS STRING) AS dataset, p_name FROM part WHERE p_size > 45")
    metrics = F.when(F.length("p_name") % 2 == 0, F.array(F.lit("math_metric"), F.lit("exact_match"))).otherwise(F.array(F.lit("exact_match")))
    text = F.to_json(F.struct(F.struct("dataset", metrics.alias("eval_metrics"), F.lit("{Question}").alias("prompt")).alias("eval_params")), {"pretty": "true"})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.select(text.alias("value")).repartition(parts).write.mode("overwrite").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(folder)
    return readers.eval_configs(spark, folder).select("dataset", F.explode("eval_metrics").alias("metric"))


@query("SELECT p_partkey AS pos, CAST(p_size AS VARCHAR) AS global_index, p_name AS answer FROM part")
def truth_files(spark, sf_dir: str) -> DataFrame:
    """The truth of the full split, by the names that its source has."""
    folder = scratch(spark, "truth")
    tables(spark, sf_dir, "part")
    spark.sql("SELECT p_partkey AS pos, CAST(p_size AS STRING) AS `Global Index`, p_name AS Answer FROM part").write.mode("overwrite").parquet(folder)
    return readers.ground_truth(spark, folder, "full")


_LOG = "concat('started ', props, chr(10), CASE WHEN event_type <> 'error' THEN concat('Metrics: ', chr(10), '{\"value\": ', CAST(user_id AS VARCHAR(19)), '}', chr(10)) ELSE '' END, 'done')"


@query(f"SELECT event_id, coalesce(TRY_CAST(json_extract(nullif(regexp_extract(value, '(?s)Metrics:\\s*(\\{{.*?\\}})', 1), ''), '$.value') AS BIGINT), -1) AS user_id FROM (SELECT event_id, {_LOG} AS value FROM events) AS l")
def log_metrics(spark, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    logs = spark.sql(f"SELECT event_id, {_LOG} AS value FROM events")
    return logs.select("event_id", F.coalesce(F.get_json_object(readers.metrics_block(F.col("value")), "$.value").cast("long"), F.lit(-1)).alias("user_id"))


@query("SELECT pos, model, accuracy * 2 AS score FROM predictions WHERE accuracy IS NOT NULL")
def resumed_scores(spark, sf_dir: str) -> DataFrame:
    """Rows scored as a stream of files that starts again where it ended: the second half comes later."""
    source, target, state = (scratch(spark, f"resume/{n}") for n in ("in", "out", "state"))
    for f in (source, target, state):
        readers.remove(spark, f)
    rows = view(spark, sf_dir, "predictions").select("pos", "model", "accuracy")
    half = F.col("model") < "c"
    for part in (half, ~half):
        rows.where(part).write.mode("append").parquet(source)
        resume(spark, source, "pos long, model string, accuracy double", lambda d: d.where("accuracy is not null").withColumn("score", F.col("accuracy") * 2), target, state)
    return spark.read.parquet(target).select("pos", "model", "score")


@query("SELECT model, CAST(k AS VARCHAR) AS global_index, arg_max(value, pos) AS accuracy FROM cache GROUP BY model, k")
def cube_files(spark, sf_dir: str) -> DataFrame:
    """The (model, question) cube, a folder for each model, written and read."""
    folder = scratch(spark, "cube")
    cube = keyed.keep_last(view(spark, sf_dir, "cache").select("model", "k", "pos", "value"), ["model", "k"])
    readers.write_cube(cube.select("model", F.col("k").cast("string").alias("global_index"), F.col("value").alias("accuracy")), folder)
    return spark.read.schema("global_index string, accuracy double, model string").json(folder)


@query("SELECT CAST(item_id AS VARCHAR) AS global_index, text AS question, length(text) % 2 = 0 AS success, CAST(length(text) AS DOUBLE) AS score FROM benchmark")
def score_files(spark, sf_dir: str) -> DataFrame:
    """A JSON array made JSON lines (once: a second array is not taken), scored, with the scores beside it."""
    array, lines, other = (scratch(spark, f"scores/{n}") for n in ("array", "lines.jsonl", "other"))
    readers.remove(spark, lines)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("global_index"), F.col("text").alias("question"), (F.length("text") % 2 == 0).alias("success"), F.lit("r").alias("router"), F.col("item_id").alias("pos"))
    for rows, to in ((items, array), (items.where("success"), other)):
        readers.write_predictions(rows, to)
        readers.to_json_lines(spark, f"{to}/router=r", lines)
    scored = readers.json_lines(spark, lines).select("global_index", "question", "success", F.length("question").cast("double").alias("score"))
    return spark.read.schema(scored.schema).json(readers.write_scores(scored, lines))


_CLIENTS = {m: "first" if i % 2 else "second" for i, m in enumerate(MODELS)}


def _first(model: str, prompt: str) -> dict:
    return {"response": f"{model} {prompt[::-1]}", "success": True, "token_usage": {"input_tokens": len(prompt)}}


def _second(model: str, prompt: str) -> dict:
    return {"response": "", "success": False, "error": f"{model} is down"}


@query(f"""WITH a AS (SELECT model, pos, model IN ({', '.join(repr(m) for m, p in _CLIENTS.items() if p == 'first')}) AS ok FROM cache WHERE NOT success)
SELECT model, CAST(pos AS VARCHAR) AS global_index, CASE WHEN ok THEN concat(model, ' ', reverse(concat('question ', CAST(pos AS VARCHAR)))) ELSE '' END AS generated_answer, ok AS success,
 CASE WHEN ok THEN 'first' ELSE 'second' END AS provider, CASE WHEN NOT ok THEN concat(model, ' is down') END AS error, CASE WHEN ok THEN length(concat('question ', CAST(pos AS VARCHAR))) ELSE 0 END AS input_tokens FROM a""")
def inferred_entries(spark, sf_dir: str) -> DataFrame:
    """Entries without success, sent to their model's client again; one client fails always."""
    cache = view(spark, sf_dir, "cache").select("model", F.col("pos").cast("string").alias("global_index"), "success")
    todo = keyed.pending(cache, cache.where("success"), ["model", "global_index"])
    rows = todo.select("global_index", "model", F.concat(F.lit("question "), F.col("global_index")).alias("prompt"))
    got = inference.infer(rows, {"first": _first, "second": _second}, _CLIENTS, attempts=1)
    entries = E.result_entry(got.withColumn("question", F.col("prompt")).withColumn("token_usage", F.struct("input_tokens")))
    return entries.select(F.col("llm_selected").alias("model"), "global_index", "generated_answer", "success", "provider", "error", F.col("token_usage.input_tokens").alias("input_tokens"))


@F.pandas_udf(StringType())
def _packed(tests: pd.Series) -> pd.Series:
    return tests.map(lambda t: base64.b64encode(zlib.compress(pickle.dumps(t))).decode())


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN 0.0 WHEN n_nationkey * 2 = n_nationkey + n_regionkey THEN 1.0 ELSE 0.0 END AS score FROM nation""")
def code_runs(spark, sf_dir: str) -> DataFrame:
    """Programs (some are no code) run on packed private tests: is twice the key the key and its region?"""
    tables(spark, sf_dir, "nation")
    rows = spark.sql("""SELECT n_nationkey AS id, n_nationkey % 2 = 0 AS is_stdin, CASE WHEN n_nationkey % 5 = 4 THEN 'no code' WHEN n_nationkey % 2 = 0 THEN 'first\\n```python\\nx = 1\\n```\\nthen\\n```python\\nprint(int(input()) * 2)\\n```'
     ELSE 'so\\n```python\\ndef twice(x):\\n    return x * 2\\n```' END AS text, to_json(array(named_struct('input', CAST(n_nationkey AS STRING), 'output', CAST(n_nationkey + n_regionkey AS STRING)))) AS tests FROM nation""")
    packed = rows.withColumn("private_test_cases", _packed(F.col("tests"))).drop("tests")
    tests = F.from_json("private_test_cases", "array<struct<input:string,output:string>>").alias("tests")
    scored = code_run.code_accuracy(code_run.with_private_tests(packed).select("id", "text", "is_stdin", tests), allow=True)
    return scored.select(F.col("id").alias("n_nationkey"), "score")


_PROBLEMS = """SELECT CAST(p_partkey AS STRING) AS _index, p_name AS question_content, p_type AS starter_code, concat('t', CAST(p_partkey AS STRING)) AS question_id, p_brand AS difficulty,
 CASE WHEN p_size % 2 = 0 THEN '[{"input": "1", "output": "2", "testtype": "stdin"}]' ELSE '[{"input": "1", "output": "2", "testtype": "functional"}]' END AS public_test_cases,
 to_json(array(named_struct('input', p_name, 'output', CAST(p_size AS STRING)))) AS tests, p_size FROM part"""


@query("""WITH k AS (SELECT event_id AS pos, concat(CASE WHEN event_id % 3 = 0 THEN 'LiveCodeBench' ELSE 'GSM8K' END, '_', CAST(user_id AS VARCHAR)) AS global_index, user_id FROM events WHERE event_id % 3 = 0)
SELECT concat('t', CAST(p_partkey AS VARCHAR)) AS task_id, p_name AS prompt, p_type AS entry_point, p_size % 2 = 0 AS is_stdin, concat('[{"input":"', p_name, '","output":"', CAST(p_size AS VARCHAR), '"}]') AS test, concat('LiveCodeBench_', CAST(p_partkey AS VARCHAR)) AS global_idx
FROM part WHERE p_size % 7 <> 0 AND p_partkey IN (SELECT user_id FROM k)""")
def benchmark_code(spark, sf_dir: str) -> DataFrame:
    """The packed problems that the benchmark's keys ask; some of them can't be unpacked."""
    tables(spark, sf_dir, "part", "events")
    keys = spark.sql("SELECT event_id AS pos, concat(CASE WHEN event_id % 3 = 0 THEN 'LiveCodeBench' ELSE 'GSM8K' END, '_', CAST(user_id AS STRING)) AS global_index FROM events")
    packed = F.when(F.col("p_size") % 7 == 0, F.lit("not packed")).otherwise(_packed(F.col("tests")))
    problems = spark.sql(_PROBLEMS).withColumn("private_test_cases", packed).drop("tests", "p_size")
    return E.benchmark_problems(problems, keys).select("task_id", "prompt", "entry_point", "is_stdin", "test", "global_idx")


@query("SELECT pos, model, accuracy FROM predictions WHERE accuracy IS NULL OR in_tok % 5 = 0")
def unscored_rows(spark, sf_dir: str) -> DataFrame:
    """Rows without an accuracy or without a cost."""
    rows = view(spark, sf_dir, "predictions").withColumn("cost", F.when(F.col("in_tok") % 5 != 0, F.col("in_tok") / 1000))
    return E.unscored(rows).select("pos", "model", "accuracy")


@query("SELECT p.pos, p.model AS prediction, coalesce(r.model, a.model) AS model, CAST(1.0 AS DOUBLE) AS confidence FROM predictions p LEFT JOIN registry r ON r.model = p.model LEFT JOIN (SELECT alias, model FROM aliases) a ON a.alias = p.model WHERE r.model IS NOT NULL OR a.model IS NOT NULL")
def single_confidence(spark, sf_dir: str) -> DataFrame:
    """A router of one model: full confidence in the canonical name of its choice."""
    registry, aliases = view(spark, sf_dir, "registry"), view(spark, sf_dir, "aliases")
    known = registry.select("model").union(aliases.select("alias")).distinct()
    rows = view(spark, sf_dir, "predictions").join(known, "model", "left_semi").select("pos", F.col("model").alias("prediction"))
    return E.sure(rows, registry, aliases).select("pos", "prediction", F.explode("all_confidence").alias("model", "confidence"))
