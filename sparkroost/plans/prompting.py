"""Queries on prompt construction and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..operators import keyed
from .routing import _DS
from .views import tables, view, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql)
        return f

    return add


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ESC = r"regexp_replace(regexp_replace({}, '\{{\{{?', '{{{{', 'g'), '\}}\}}?', '}}}}', 'g')"


@query(f"SELECT page_id, md5({_ESC.format('html')}) AS escaped FROM pages")
def escape_braces(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(P.escape_braces(F.col("html")).cast("binary")).alias("escaped"))


_FILLED = f"concat('Use {{}}. Context: None Question: ', {_ESC.format('html')}, chr(10))"


@query(f"SELECT page_id, CAST(length(p) AS BIGINT) AS n, md5(CASE WHEN length(p) > 10000 THEN concat(left(p, 5000), '...', right(p, 5000)) ELSE p END) AS prompt FROM (SELECT page_id, {_FILLED} AS p FROM pages)")
def prompt_build(spark, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    filled = P.fill("Use {{}}. Context: {Context} Question: {Question}\n", Context=F.nullif(F.lit(""), F.lit("")), Question=F.col("html"))
    return pages.select("page_id", F.length(filled).cast("long").alias("n"), F.md5(P.truncate_middle(filled).cast("binary")).alias("prompt"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 10000 THEN concat(left(text, 5000), '...', right(text, 5000)) ELSE text END) AS cut FROM documents")
def prompt_truncate(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(P.truncate_middle(F.col("text")).cast("binary")).alias("cut"))


@query("SELECT p_partkey, concat('A. ', p_name, chr(10), 'B. ', p_brand, chr(10), 'C. ', p_type, chr(10)) AS block FROM part")
def options_block(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", P.options_block(F.array("p_name", "p_brand", "p_type")).alias("block"))


@query(f"SELECT pos, {_DS} AS dataset FROM predictions")
def dataset_from_key(spark, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "predictions").select("pos", P.dataset_of(F.col("global_index")).alias("dataset"))


@query("""SELECT pos, CASE WHEN pos % 5 = 0 THEN 'given' WHEN starts_with(global_index, 'Ethics') THEN concat(split_part(global_index, '_', 1), '_', split_part(global_index, '_', 2))
 WHEN starts_with(global_index, 'ChessInstruct_mcq') THEN 'ChessInstruct_mcq' ELSE split_part(global_index, '_', 1) END AS dataset FROM predictions""")
def dataset_for_prompt(spark, sf_dir: str) -> DataFrame:
    given = F.when(F.col("pos") % 5 == 0, "given").otherwise("")
    return view(spark, sf_dir, "predictions").select("pos", P.dataset_for_prompt(F.col("global_index"), given).alias("dataset"))


@query("""SELECT 'MMLU' AS slice, count(*) FILTER (contains(global_index, 'MMLU_')) AS n FROM predictions UNION ALL SELECT 'ArcMMLU', count(*) FILTER (contains(global_index, 'MMLU_')) FROM predictions
UNION ALL SELECT 'Ethics_justice', count(*) FILTER (contains(global_index, 'Ethics_justice')) FROM predictions UNION ALL SELECT 'AIME_0', count(*) FILTER (global_index = 'AIME_0') FROM predictions""")
def dataset_slice(spark, sf_dir: str) -> DataFrame:
    p, names = view(spark, sf_dir, "predictions"), ["MMLU", "ArcMMLU", "Ethics_justice", "AIME_0"]
    counts = p.agg(*[F.count_if(P.in_slice(n, F.col("global_index"))).alias(n) for n in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("slice"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")


@query("""WITH p AS (SELECT item_id AS pos, CASE WHEN item_id % 3 = 0 THEN concat('LiveCodeBench_', CAST(item_id AS VARCHAR)) END AS g, CASE WHEN item_id % 3 = 1 THEN CAST(item_id AS VARCHAR) END AS i, text AS t, concat('task', CAST(item_id AS VARCHAR)) AS task FROM benchmark),
r AS (SELECT doc_id, concat('LiveCodeBench_', CAST(doc_id % 60 AS VARCHAR)) AS gi, doc_id % 60 AS d, b.text AS q FROM documents LEFT JOIN benchmark b ON b.item_id = doc_id % 41)
SELECT r.doc_id, coalesce(a.task, b.task, c.task) AS task_id FROM r LEFT JOIN p a ON a.g = r.gi LEFT JOIN p b ON b.i = CAST(r.d AS VARCHAR)
LEFT JOIN (SELECT left(t, 120) AS h, arg_max(task, pos) AS task FROM p GROUP BY 1) c ON c.h = left(r.q, 120)""")
def code_row_match(spark, sf_dir: str) -> DataFrame:
    b, d = _table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents")
    own = F.col("item_id").cast("string")
    problems = b.select(F.col("item_id").alias("pos"), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("LiveCodeBench_"), own)).alias("global_idx"), F.when(F.col("item_id") % 3 == 1, own).alias("_index"), F.col("text").alias("prompt"), F.concat(F.lit("task"), own).alias("task_id"))
    rows = d.select("doc_id", F.concat(F.lit("LiveCodeBench_"), (F.col("doc_id") % 60).cast("string")).alias("global_index"), (F.col("doc_id") % 41).alias("b"))
    rows = rows.join(b.select(F.col("item_id").alias("b"), F.col("text").alias("question")), "b", "left").select("doc_id", "global_index", "question")
    return keyed.match_code_rows(rows, problems).select("doc_id", "task_id")


_TESTS = """SELECT event_id, CASE event_type WHEN 'click' THEN concat('[{"testtype": "stdin", "input": "', CAST(user_id AS VARCHAR(19)), '"}]') WHEN 'view' THEN concat('[', props, ', {"testtype": "', CASE WHEN user_id % 2 = 0 THEN 'functional' ELSE 'stdin' END, '"}]')
 WHEN 'error' THEN '[{"testtype": "functional"' WHEN 'signup' THEN '[]' ELSE concat('[', props, ', ', props, ']') END AS tests FROM events"""


@query(f"""SELECT event_id, CASE WHEN json_valid(tests) THEN list_contains(json_extract_string(tests, '$[*].testtype'), 'stdin') ELSE false END AS stdin,
 CASE WHEN json_valid(tests) THEN list_contains(json_extract_string(tests, '$[*].testtype'), 'functional') ELSE false END AS functional FROM ({_TESTS}) AS t""")
def has_test_type(spark, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    t = F.col("tests")
    return spark.sql(_TESTS).select("event_id", P.has_test_type(t, "stdin").alias("stdin"), P.has_test_type(t, "functional").alias("functional"))


_FORMS = {"llama": ("[INST] ", " [/INST]"), "zephyr": ("<|user|>\n", "</s>\n<|assistant|>\n")}


@query("""SELECT conv_id, turn, md5(CASE WHEN turn % 4 = 0 THEN t WHEN turn % 4 = 1 THEN concat('[INST] ', t, ' [/INST]') WHEN turn % 4 = 2 THEN concat('<|user|>', chr(10), t, '</s>', chr(10), '<|assistant|>', chr(10)) ELSE concat('User: ', t) END) AS prompt
 FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)""")
def chat_prompts(spark, sf_dir: str) -> DataFrame:
    """Prompts in the chat form that each row's template names; none: as they are."""
    k = F.col("turn") % 4
    template = F.when(k == 1, "Llama3-chat").when(k == 2, "ZEPHYR").when(k == 3, "other")
    prompt = P.chat(F.coalesce("text", F.lit("")), template, _FORMS, ("User: ", ""))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(prompt.cast("binary")).alias("prompt"))
