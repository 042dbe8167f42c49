"""Queries on evaluation: gates, matching with the truth, choice of scorers, scores, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import symbolic
from ..functions import text as T
from ..operators import evaluate as E
from ..operators import keyed, validate
from .answers import LADDER
from .routing import ANY_PAYLOAD
from .views import tables, view, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql)
        return f

    return add


#: Predictions with gaps: no key, no model, no result, a failure.
GAPS = """SELECT event_id AS pos, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 23 = 0 THEN NULL ELSE concat('q', CAST(event_id AS VARCHAR(19))) END AS global_index,
 CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '' ELSE props END AS prompt,
 CASE WHEN user_id % 7 = 0 THEN '' WHEN user_id % 7 = 1 THEN NULL WHEN user_id % 7 = 2 THEN 'oak' WHEN user_id % 7 = 3 THEN 'birch' ELSE 'alder' END AS prediction,
 event_type <> 'view' AS has_result, CASE WHEN event_type = 'signup' THEN NULL ELSE event_type <> 'error' END AS success FROM events"""


@query(f"SELECT pos, global_index, prompt FROM ({GAPS}) AS g WHERE global_index <> '' AND prompt <> ''")
def complete_rows(spark, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return E.complete(spark.sql(GAPS)).select("pos", "global_index", "prompt")


@query(f"""SELECT g.pos, coalesce(r.model, a.model) AS canonical, CASE WHEN coalesce(global_index, '') = '' THEN 'missing_key' WHEN coalesce(prediction, '') = '' THEN 'missing_model'
 WHEN NOT has_result THEN 'no_result' WHEN NOT coalesce(success, false) THEN 'unsuccessful' WHEN r.model IS NULL AND a.model IS NULL THEN 'unknown_model' END AS reason
 FROM ({GAPS}) AS g LEFT JOIN registry r ON r.model = g.prediction LEFT JOIN aliases a ON a.alias = g.prediction""")
def evaluable_rows(spark, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return E.evaluable(spark.sql(GAPS), view(spark, sf_dir, "registry"), view(spark, sf_dir, "aliases")).select("pos", "canonical", "reason")


@query("SELECT pos, model, k FROM cache WHERE success AND score IS NULL")
def unevaluated_entries(spark, sf_dir: str) -> DataFrame:
    return E.unevaluated(view(spark, sf_dir, "cache")).select("pos", "model", "k")


@query("SELECT pos, model, k FROM cache WHERE success")
def rerun_entries(spark, sf_dir: str) -> DataFrame:
    return E.unevaluated(view(spark, sf_dir, "cache"), rerun=True).select("pos", "model", "k")


#: A truth with repeated keys: the parts, by their size.
_TRUTH = "SELECT p_partkey AS pos, p_size AS k, p_name AS answer FROM part"


def _truth(spark, sf_dir: str, last: bool) -> DataFrame:
    tables(spark, sf_dir, "part")
    rows = view(spark, sf_dir, "predictions").select(F.col("pos").alias("row"), F.col("out_tok").cast("int").alias("k"))
    return E.with_truth(rows, spark.sql(_TRUTH), last, "k").select("row", "k", "answer")


@query(f"SELECT p.pos AS row, CAST(p.out_tok AS INT) AS k, t.answer FROM predictions p LEFT JOIN (SELECT k, arg_max(answer, pos) AS answer FROM ({_TRUTH}) AS x GROUP BY k) t ON t.k = p.out_tok")
def truth_last_wins(spark, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir, True)


@query(f"SELECT p.pos AS row, CAST(p.out_tok AS INT) AS k, t.answer FROM predictions p LEFT JOIN (SELECT k, arg_min(answer, pos) AS answer FROM ({_TRUTH}) AS x GROUP BY k) t ON t.k = p.out_tok")
def truth_first_wins(spark, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir, False)


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_name FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey")
def truth_required(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return E.require_match(rows, parts, ["l_partkey"])


_OPTIONS = ["red bolt", "Small  Ring", "blue", "ring of steel", "Widget"]


@query(f"""WITH o AS (SELECT unnest(range(0, {len(_OPTIONS)})) AS i, unnest([{', '.join(repr(x) for x in _OPTIONS)}]) AS o),
s AS (SELECT p_partkey, p_name, i, o = p_name AS same, CASE WHEN contains(lower(o), lower(p_name)) OR contains(lower(p_name), lower(o)) THEN
   len(list_intersect(list_distinct(regexp_split_to_array(lower(p_name), '\\s+')), list_distinct(regexp_split_to_array(lower(o), '\\s+')))) ELSE 0 END AS n FROM part CROSS JOIN o),
b AS (SELECT p_partkey, any_value(p_name) AS p_name, min(i) FILTER (same) AS exact, arg_min(i, (-n, i)) FILTER (n > 0) AS near FROM s GROUP BY p_partkey)
SELECT p_partkey, coalesce(CAST(coalesce(exact, near) AS VARCHAR), p_name) AS truth FROM b""")
def cloze_truth(spark, sf_dir: str) -> DataFrame:
    options = F.array(*map(F.lit, _OPTIONS))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", E.option_index(F.col("p_name"), options).alias("truth"))


@query("SELECT p.pos, q.l_name AS task FROM (SELECT pos, global_index, CAST(pos AS VARCHAR) AS place FROM predictions) p LEFT JOIN (SELECT CAST(p_partkey AS VARCHAR) AS place, p_name AS l_name FROM part) q USING (place)")
def code_by_position(spark, sf_dir: str) -> DataFrame:
    problems = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("_index"), F.col("p_name").alias("task"))
    return E.by_position(view(spark, sf_dir, "predictions").select("pos", "global_index"), problems).select("pos", "task")


@query("""WITH e AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN b.text WHEN 1 THEN substr(b.text, 1 + CAST(doc_id % 7 AS INT), 120) ELSE concat('no such question ', CAST(doc_id AS VARCHAR)) END AS prompt
  FROM documents JOIN benchmark b ON b.item_id = doc_id % 40),
x AS (SELECT text, max(item_id) AS g FROM benchmark GROUP BY text),
h AS (SELECT head, min(b.item_id) AS g FROM (SELECT DISTINCT left(prompt, 100) AS head FROM e) d JOIN benchmark b ON contains(b.text, head) GROUP BY head)
SELECT e.doc_id, coalesce(x.g, h.g, -1) AS global_index FROM e LEFT JOIN x ON x.text = e.prompt LEFT JOIN h ON h.head = left(e.prompt, 100)""")
def question_match(spark, sf_dir: str) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.col("doc_id") % 40).alias("item_id")).join(b, "item_id")
    k = F.col("doc_id") % 3
    prompt = F.when(k == 0, F.col("text")).when(k == 1, F.col("text").substr((F.col("doc_id") % 7 + 1).cast("int"), F.lit(120))).otherwise(F.concat(F.lit("no such question "), F.col("doc_id").cast("string")))
    questions = b.select(F.col("text").alias("question"), F.col("item_id").alias("global_index"), F.col("item_id").alias("pos"))
    return E.match_questions(d.select("doc_id", prompt.alias("prompt")), questions).select("doc_id", F.coalesce("global_index", F.lit(-1)).alias("global_index"))


_CONFIGS = [("AIME", ["math_metric"]), ("GSM8K", ["math_metric", "exact_match", "no_such_metric"]), ("GeoGraphyData", ["exact_match"]), ("SuperGLUE-RC", ["superglue_exact_match", "superglue_clozetest"]), ("Ethics_commonsense", []), ("MATH", None)]
_CONFIG_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {'NULL' if m is None else repr(m) if m else 'CAST([] AS VARCHAR[])'})" for n, m in _CONFIGS) + ") AS t(dataset, eval_metrics)"
_KNOWN = ", ".join(f"'{m}'" for m in E.METRICS)
_OWN = "CASE dataset " + " ".join(f"WHEN '{d}' THEN {m!r}" for d, m in E.DATASET_METRICS.items()) + " ELSE ['mcq_accuracy'] END"
_SPARK_DATASETS = ["AIME", "GSM8K", "GeoGraphyData_100k", "SuperGLUE-RC", "Ethics_commonsense", "MATH", "MMLUPro", "NarrativeQA", "other"]
_PICK = "CASE CAST({} % 9 AS INT) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_SPARK_DATASETS)) + " END"
_METRICS_SQL = f"""c AS ({_CONFIG_SQL}),
m AS (SELECT r.*, list_filter(coalesce(c.eval_metrics, []), lambda x: x IN ({_KNOWN})) AS known FROM r LEFT JOIN c ON c.dataset = CASE WHEN r.dataset = 'GeoGraphyData_100k' THEN 'GeoGraphyData' ELSE r.dataset END),
u AS (SELECT * EXCLUDE (known), unnest(CASE WHEN len(known) > 0 THEN known ELSE {_OWN} END) AS metric FROM m)"""


def _configs(spark) -> DataFrame:
    return spark.createDataFrame(_CONFIGS, "dataset string, eval_metrics array<string>")


@query(f"WITH r AS (SELECT pos, {_PICK.format('pos')} AS dataset FROM predictions), {_METRICS_SQL} SELECT pos, dataset, metric FROM u")
def dataset_metrics(spark, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "predictions").select("pos", F.expr(_PICK.format("pos")).alias("dataset"))
    return E.with_metrics(rows, _configs(spark)).select("pos", "dataset", "metric")


#: Scores of the answers view by each metric that SQL restates; ``x`` is the extracted answer.
_SCORE = r"""CASE metric WHEN 'mcq_accuracy' THEN x = truth WHEN 'mcq_exact_match' THEN x = truth WHEN 'exact_match' THEN lower(x) = lower(truth)
 WHEN 'superglue_exact_match' THEN CASE WHEN truth IN ('Yes', 'No') THEN CASE WHEN upper(x) IN ('A', 'X', '1', 'TRUE') THEN 'Yes' WHEN upper(x) IN ('B', 'Y', '0', 'FALSE') THEN 'No' ELSE x END ELSE x END = truth
 WHEN 'superglue_clozetest' THEN CASE WHEN contains(text, '\boxed{') THEN x ELSE upper(text[1]) END = truth
 WHEN 'chess_accuracy' THEN CASE WHEN contains(text, '\boxed{') THEN x WHEN regexp_matches(text, '\b[A-Z]\b') THEN list_extract(regexp_extract_all(text, '\b([A-Z])\b', 1), -1) ELSE '' END = truth
 WHEN 'meteor_score' THEN lower(x) = lower(truth) END"""
_NATIVE = ["mcq_accuracy", "mcq_exact_match", "exact_match", "superglue_exact_match", "superglue_clozetest", "chess_accuracy", "meteor_score"]

#: Products of two linear factors against their expansions, some with a part of another sign: m, n and an error d.
_QUADRATICS = """SELECT l_orderkey, l_linenumber, CAST(l_partkey % 9 - 4 AS INT) AS m, CAST(l_suppkey % 7 - 3 AS INT) AS n, CAST(CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS d, CAST(l_orderkey % 4 AS INT) AS form FROM lineitem"""
_FORMULA_TEXT = r"""CASE form WHEN 0 THEN concat('so \boxed{(x+', m, ')(x+', n, ')}') WHEN 1 THEN concat('\boxed{', n, 'x+x^2+', m, 'x+', m, '\cdot', n, '}')
 WHEN 2 THEN concat('\boxed{\left|x+', m, '\right|}') ELSE concat('\boxed{\sqrt{(x+', m, ')^2}}') END"""
_FORMULA_TRUTH = r"""CASE WHEN form < 2 THEN concat('x^2+', m + n, 'x+', m * n + d) WHEN form = 2 AND d = 0 THEN concat('|', m, '+x|') WHEN d = 0 THEN concat('\sqrt{x^2+', 2 * m, 'x+', m * m, '}') ELSE concat('x+', m) END"""
#: Programs that print twice a number, against a test that wants the supplier's nation and a half of it.
_PROGRAM_ROWS = """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 4 THEN 'no code at all' WHEN 3 THEN '```python\nwhile False:\n    pass\nraise ValueError\n```' ELSE '```python\nimport sys\nprint(2 * int(sys.stdin.buffer.read()))\n```' END AS text,
 true AS is_stdin, array(named_struct('input', CAST(s_nationkey AS STRING), 'output', CAST(CAST(s_nationkey + s_suppkey % 3 AS INT) + s_nationkey AS STRING))) AS tests FROM supplier"""


@query(f"""WITH {LADDER}, s AS (SELECT l_linenumber, unnest({_NATIVE!r}) AS metric, text, truth, x FROM ext),
q AS ({_QUADRATICS}), all_rows AS (SELECT metric, l_linenumber, CASE WHEN {_SCORE} THEN 1.0 ELSE 0.0 END AS score FROM s
 UNION ALL SELECT 'math_metric', l_linenumber, CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END FROM q
 UNION ALL SELECT 'code_accuracy', 0, CASE WHEN s_suppkey % 5 < 3 AND s_suppkey % 3 = 0 THEN 1.0 ELSE 0.0 END FROM supplier)
SELECT metric, l_linenumber, count(*) AS n, round(avg(score), 6) AS mean FROM all_rows GROUP BY ALL""")
def metric_scores(spark, sf_dir: str) -> DataFrame:
    """Answers, formulas and programs by all nine metrics through one dispatch. Equal rows are scored once and weigh what they are."""
    tables(spark, sf_dir, "lineitem", "supplier")
    none = F.lit(None).cast("array<struct<input:string,output:string>>")
    own = ["l_linenumber", "metric", "text", "truth", "answer", "is_stdin", "tests", "rows"]
    counted = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    rows = counted(view(spark, sf_dir, "answers"), "l_linenumber", "text", "truth").select("rows", "l_linenumber", "text", "truth", T.answer(F.col("text")).alias("answer"), F.lit(False).alias("is_stdin"), none.alias("tests"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, _NATIVE))).alias("metric")).select(own)
    spark.sql(_QUADRATICS).createOrReplaceTempView("quadratics")
    formulas = spark.sql(f"SELECT l_linenumber, 'math_metric' AS metric, {_FORMULA_TEXT} AS text, {_FORMULA_TRUTH} AS truth, '' AS answer, false AS is_stdin FROM quadratics".replace("\\", "\\\\"))
    formulas = counted(formulas, *formulas.columns)
    programs = counted(spark.sql(_PROGRAM_ROWS), "text", "is_stdin", "tests").select("rows", F.lit(0).alias("l_linenumber"), F.lit("code_accuracy").alias("metric"), "text", F.lit("").alias("truth"), F.lit("").alias("answer"), "is_stdin", "tests")
    every = rows.unionByName(formulas.withColumn("tests", none).select(own)).unionByName(programs.select(own))
    means = E.metric_means(E.score_rows(every, answer="answer", tests="tests", allow=True), "l_linenumber", weight="rows")
    return means.select("metric", "l_linenumber", "n", F.round("mean", 6).alias("mean"))


@query(f"SELECT l_orderkey, l_linenumber, m, n, CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END AS score FROM ({_QUADRATICS}) AS q")
def score_identities(spark, sf_dir: str) -> DataFrame:
    """Quadratics, absolute values and roots that are or aren't the same function; SQL knows how they were made."""
    tables(spark, sf_dir, "lineitem")
    spark.sql(_QUADRATICS).createOrReplaceTempView("quadratics")
    rows = spark.sql(f"SELECT l_orderkey, l_linenumber, m, n, {_FORMULA_TEXT} AS text, {_FORMULA_TRUTH} AS truth FROM quadratics".replace("\\", "\\\\"))
    return symbolic.with_math_scores(rows).select("l_orderkey", "l_linenumber", "m", "n", "score")


@query(f"""WITH r AS (SELECT l_orderkey, text, truth, {_PICK.format('l_orderkey')} AS dataset FROM answers), {_METRICS_SQL},
{LADDER.replace('FROM answers', 'FROM u')}, s AS (SELECT * FROM ext WHERE metric IN ({', '.join(repr(m) for m in _NATIVE)}))
SELECT dataset, metric, count(*) AS n, round(avg(CASE WHEN {_SCORE} THEN 1.0 ELSE 0.0 END), 6) AS mean FROM s GROUP BY ALL""")
def dataset_scores(spark, sf_dir: str) -> DataFrame:
    """From data set to configuration to metrics to scores to means."""
    rows = view(spark, sf_dir, "answers").select("text", "truth", F.expr(_PICK.format("l_orderkey")).alias("dataset"))
    scored = E.score_rows(E.with_metrics(rows, _configs(spark)).where(F.col("metric").isin(*_NATIVE)))
    means = E.metric_means(scored, "dataset")
    return means.select("dataset", "metric", "n", F.round("mean", 6).alias("mean"))


@query(f"""WITH {LADDER} SELECT id, l_linenumber, CASE WHEN {_SCORE.replace('metric WHEN', "'superglue_clozetest' WHEN", 1)} THEN 1.0 ELSE 0.0 END AS score FROM ext""")
def score_cloze(spark, sf_dir: str) -> DataFrame:
    from ..functions import scores as S

    return view(spark, sf_dir, "answers").select("id", "l_linenumber", S.cloze(F.col("text"), F.col("truth")).alias("score"))


_RUNS = "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'click' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'timeout' ELSE 'exception' END AS status, value AS duration FROM events"


@query(f"""SELECT count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'timeout') AS timeout, count(*) FILTER (status = 'exception') AS "exception",
 round(avg(duration) FILTER (status = 'success'), 6) AS mean_duration FROM ({_RUNS}) AS r""")
def batch_run_stats(spark, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return E.batch_stats(spark.sql(_RUNS)).withColumn("mean_duration", F.round("mean_duration", 6))


@query("SELECT doc_id, coalesce(bool_or(trim(text) <> '') OVER (), false) AS answered FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 100) ORDER BY doc_id LIMIT 1")
def answers_present(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("answer"))
    return d.orderBy("doc_id").limit(1).select("doc_id", F.lit(E.has_answers(d, "doc_id")).alias("answered"))


@query("SELECT model, count(*) > 0 AND max(CASE WHEN c.m IS NULL THEN 0 ELSE 1 END) = 1 AS available FROM predictions LEFT JOIN (SELECT DISTINCT model AS m FROM cache WHERE score > 0) c ON c.m = model GROUP BY model")
def model_availability(spark, sf_dir: str) -> DataFrame:
    return E.availability(view(spark, sf_dir, "predictions"), view(spark, sf_dir, "cache").where("score > 0"))


@query("""SELECT router, n, coalesce(size, -1) AS size FROM (SELECT concat('r', CAST(user_id % 5 AS VARCHAR), '_', CAST(user_id AS VARCHAR)) AS router, concat('r', CAST(user_id % 5 AS VARCHAR)) AS base, count(*) AS n FROM events GROUP BY 1, 2)
 LEFT JOIN (SELECT concat('r', CAST(r_regionkey AS VARCHAR)) AS base, length(r_name) AS size FROM region WHERE r_regionkey <> 3) USING (base)""")
def router_configs(spark, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events", "region")
    routers = spark.sql("SELECT concat('r', CAST(user_id % 5 AS STRING), '_', CAST(user_id AS STRING)) AS router, count(*) AS n FROM events GROUP BY 1")
    configs = spark.sql("SELECT concat('r', CAST(r_regionkey AS STRING)) AS router_name, CAST(length(r_name) AS BIGINT) AS size FROM region WHERE r_regionkey <> 3")
    return E.by_router(routers, configs).select("router", "n", F.coalesce("size", F.lit(-1)).alias("size"))


@query("""SELECT event_id AS global_index, event_type AS question, concat('m', CAST(user_id % 4 AS VARCHAR)) AS llm_selected, CASE WHEN user_id % 3 = 0 THEN '' ELSE props END AS generated_answer, value AS token_usage,
 event_type <> 'error' AND event_type <> 'view' AS success, CASE WHEN user_id % 5 = 0 THEN 'unknown' ELSE 'here' END AS provider, CASE WHEN event_type IN ('error', 'view') THEN 'broke' END AS error FROM events""")
def result_entries(spark, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    rows = spark.sql("""SELECT event_id AS global_index, event_type AS question, concat('m', user_id % 4) AS model, CASE WHEN user_id % 3 <> 0 THEN props END AS response, value AS token_usage,
     CASE WHEN event_type <> 'view' THEN event_type <> 'error' END AS success, CASE WHEN user_id % 5 <> 0 THEN 'here' END AS provider, 'broke' AS error FROM events""")
    return E.result_entry(rows)


@query("SELECT page_id, replace(replace(url, '/', '_'), '\\', '_') AS name, replace(replace(replace(replace(url, '/', '_'), '\\', '_'), ':', '_'), ' ', '_') AS log_name FROM pages")
def file_names(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", P.file_name(F.col("url")).alias("name"), P.file_name(F.col("url"), log=True).alias("log_name"))


_TEMPLATES = {
    "LiveCodeBench": {"is_stdin_prompt": "Read input. {Question}", "not_is_stdin_prompt": "Write a function. {Question}"},
    "SuperGLUE-RC": {"prompt": "Q: {Question} A: {Answer}"},
    "SuperGLUE-Wic": {"prompt": "Q: {Question} C: {Context}"},
    "GSM8K": {"prompt": "Context: {Context} Solve {Question} {{x}}"},
    "MMLU": {"prompt": "Context: {Context} Choose {Question}\n{Options}"},
}
_SETS = list(_TEMPLATES)
_SET_SQL = "CASE p_size % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_SETS)) + " END"
_ESC = r"regexp_replace(regexp_replace({}, '\{{\{{?', '{{{{', 'g'), '\}}\}}?', '}}}}', 'g')"
_CTX = "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END"


@query(f"""WITH r AS (SELECT p_partkey, {_SET_SQL} AS dataset, concat('{{', p_name, '}}') AS question, {_CTX} AS context, p_brand AS answer FROM part)
SELECT p_partkey, dataset, CASE dataset WHEN 'LiveCodeBench' THEN concat(CASE WHEN p_partkey % 2 = 0 THEN 'Read input. ' ELSE 'Write a function. ' END, {_ESC.format('question')})
 WHEN 'SuperGLUE-RC' THEN concat('Q: ', {_ESC.format('question')}, ' A: ', answer) WHEN 'SuperGLUE-Wic' THEN concat('Q: ', {_ESC.format('question')}, ' C: ', context)
 WHEN 'GSM8K' THEN concat('Context: ', coalesce(nullif(context, ''), 'None'), ' Solve ', {_ESC.format('question')}, ' {{x}}')
 ELSE concat('Context: ', coalesce(nullif(context, ''), 'None'), ' Choose ', {_ESC.format('question')}, chr(10), 'A. ', answer, chr(10), 'B. ', context, chr(10)) END AS prompt FROM r""")
def prompt_dispatch(spark, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "part")
    rows = spark.sql(f"SELECT p_partkey, {_SET_SQL} AS dataset, concat('{{', p_name, '}}') AS question, {_CTX} AS context, p_brand AS answer FROM part")
    options = F.when(F.col("dataset") == "MMLU", F.array("answer", "context"))
    prompt = P.dispatch(_TEMPLATES, F.col("dataset"), F.col("question"), F.col("context"), options, F.col("answer"), F.col("p_partkey") % 2 == 0)
    return rows.select("p_partkey", "dataset", prompt.alias("prompt"))


@query(f"""WITH r AS ({ANY_PAYLOAD}), j AS (SELECT pos, raw, json_type(raw) AS t, json_type(raw, '$.generated_answer') AS ta, json_type(raw, '$.success') AS ts, json_type(raw, '$.token_usage') AS tu,
 json_extract_string(raw, '$.generated_answer') AS a, json_extract_string(raw, '$.success') AS s FROM r)
SELECT pos, CASE WHEN t = 'NULL' THEN 'null_result' WHEN t <> 'OBJECT' THEN 'not_object' WHEN ta IS NULL OR ts IS NULL OR tu IS NULL THEN 'missing_field' WHEN ta <> 'VARCHAR' THEN 'answer_not_text'
 WHEN trim(a) = '' AND (ts = 'BOOLEAN' AND s = 'true' OR ts = 'VARCHAR' AND s <> '' OR ts IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(s AS DOUBLE) <> 0 OR ts IN ('ARRAY', 'OBJECT') AND s NOT IN ('[]', '{{}}')) THEN 'success_without_answer'
 WHEN ts <> 'BOOLEAN' THEN 'success_not_boolean' END AS code FROM j""")
def validate_payloads(spark, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return spark.sql(ANY_PAYLOAD).select("pos", validate.payload_error(F.col("raw")).alias("code"))


@query("SELECT router, count(*) AS n, min(pos) AS first_pos FROM predictions GROUP BY router HAVING count(*) > 0")
def predictions_by_router(spark, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "predictions")
    return E.require_rows(p, "router").groupBy("router").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


@query("SELECT pos, code FROM (SELECT pos, 'prompt' AS code FROM predictions WHERE accuracy IS NULL) ORDER BY pos LIMIT 10")
def error_preview(spark, sf_dir: str) -> DataFrame:
    errors = view(spark, sf_dir, "predictions").where("accuracy is null").select("pos", F.lit("prompt").alias("code"))
    return E.preview(errors, ["pos"])[0]


@query("SELECT CAST(event_id AS VARCHAR) AS global_index, props AS prompt, CASE WHEN value > 50 THEN 'alder' ELSE 'birch-7b' END AS prediction FROM events WHERE props <> ''")
def generate_predictions(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("global_index"), F.col("props").alias("prompt"), "value")
    models = view(spark, sf_dir, "prices").select("model")
    return E.generate(rows, F.when(F.col("value") > 50, "alder").otherwise("birch-7b"), models).select("global_index", "prompt", "prediction")


@query("SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS VARCHAR) AS _index, p_partkey FROM part")
def row_index(spark, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return keyed.numbered(parts, ["p_partkey"], "i").select(F.col("i").cast("string").alias("_index"), "p_partkey")
