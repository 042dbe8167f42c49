"""Queries on many models and saved progress, on tests and words read from texts, and on whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fanout
from ..functions import code_run, segment
from ..functions import scores as S
from ..functions import text as T
from ..session import scratch
from ..sources import answer_log, readers
from .views import MODELS, tables, view, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql)
        return f

    return add


@query(f"""WITH m AS (SELECT unnest({MODELS!r}) AS model), r AS (SELECT model, count(*) AS n, sum(score) AS total FROM cache WHERE score IS NOT NULL GROUP BY model)
SELECT model, CASE WHEN model = 'fir' THEN 'exception' WHEN model = 'elm-mini' THEN 'failed' ELSE 'success' END AS status, CASE WHEN model NOT IN ('fir', 'elm-mini') THEN coalesce(n, 0) ELSE -1 END AS n, CASE WHEN model NOT IN ('fir', 'elm-mini') THEN round(coalesce(total, 0), 4) ELSE -1 END AS total FROM m LEFT JOIN r USING (model)""")
def fan_out_models(spark, sf_dir: str) -> DataFrame:
    """Every model's scores summed in a job of its own; one has no entry in the registry, one's job fails."""
    folder, cache = scratch(spark, "fan/out"), scratch(spark, "fan/cache")
    readers.remove(spark, folder)
    rows = view(spark, sf_dir, "cache").select("model", "score")
    rows.write.mode("overwrite").partitionBy("model").parquet(cache)
    held = spark.read.schema("score double, model string").parquet(cache)

    def work(model: str) -> DataFrame:
        if model == "fir":
            raise KeyError(f"{model} is not registered")
        own = held.where(F.col("model") == model).where("score is not null")
        n = F.count(F.lit(1))
        return own.agg((n if model != "elm-mini" else F.raise_error(F.concat(F.lit("a broken score among "), n.cast("string"))).cast("long")).alias("n"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"))

    told = fanout.fan_out(spark, MODELS, work, folder)
    out = told.join(fanout.results(spark, folder, "n long, total double"), "model", "left")
    return out.select("model", "status", F.coalesce("n", F.lit(-1)).alias("n"), F.coalesce(F.round("total", 4), F.lit(-1.0)).alias("total"))


_PROVIDERS = {m: "steady" if i % 3 else "shaky" for i, m in enumerate(MODELS)}


def _steady(model: str, prompt: str) -> dict:
    return {"response": f"{model}: {prompt}", "success": True, "token_usage": {"input_tokens": len(prompt), "output_tokens": 1, "total_tokens": len(prompt) + 1}}


def _first_down(model: str, prompt: str) -> dict:
    return {"success": False, "error": "down"}


@query(f"""WITH a AS (SELECT model, pos, model IN ({', '.join(repr(m) for m, p in _PROVIDERS.items() if p == 'shaky')}) AS shaky FROM cache WHERE NOT success)
SELECT model, CAST(pos AS VARCHAR) AS global_index, concat(model, ': q', CAST(pos AS VARCHAR)) AS response, CASE WHEN shaky THEN 'second' ELSE 'first' END AS run_id, length(concat('q', CAST(pos AS VARCHAR))) + 1 AS total_tokens,
 (SELECT count(*) FROM a) AS asked_first, (SELECT count(*) FROM a WHERE NOT shaky) AS reused_second, (SELECT count(*) FROM a WHERE shaky) AS asked_second FROM a""")
def logged_inference(spark, sf_dir: str) -> DataFrame:
    """Entries without success asked through an answer log, twice: the second run reuses the first's successes and asks
    its failures again."""
    folder = scratch(spark, "answers")
    readers.remove(spark, folder)
    todo = view(spark, sf_dir, "cache").where("not success").select(F.col("pos").cast("string").alias("global_index"), "model")
    rows = todo.withColumn("prompt", F.concat(F.lit("q"), F.col("global_index")))
    counts = []
    for run_id, shaky in (("first", _first_down), ("second", _steady)):
        entries, told = answer_log.run_inference(rows, {"steady": _steady, "shaky": shaky}, _PROVIDERS, folder, run_id, shards=8, every=500, attempts=1)
        counts.append(told.agg(F.sum("asked"), F.sum("reused")).first())
    said = [F.lit(n).cast("long").alias(name) for n, name in ((counts[0][0], "asked_first"), (counts[1][1], "reused_second"), (counts[1][0], "asked_second"))]
    return entries.where("success").select("model", "global_index", "response", "run_id", "total_tokens", *said)


#: Tests written as an array, as objects side by side, as lines, and with a broken one among them.
_TESTS = r"""SELECT event_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN concat('```json', chr(10), '[{"input": "', user_id, '", "output": "', event_type, '"}, {"input": "[1, 2]", "output": "', user_id, '"}]', chr(10), '```')
 WHEN 1 THEN concat('{"input": "', user_id, '", "output": "', event_type, '"}{"input": "x", "output": "', user_id, '"} {"input": "", "output": "{}"}')
 WHEN 2 THEN concat('{"input": "', user_id, '", "output": "', event_type, '"}', chr(10), '{"input": "', chr(10), '{"input": ', user_id, ', "output": [', user_id, ', 2]}')
 ELSE concat('no tests here: ', user_id) END AS text FROM events"""


@query("""WITH r AS (SELECT event_id, CAST(event_id % 4 AS INT) AS k, CAST(user_id AS VARCHAR) AS u, event_type AS t FROM events),
x AS (SELECT event_id, unnest(CASE k WHEN 0 THEN [{'at': 0, 'i': u, 'o': t}, {'at': 1, 'i': '[1, 2]', 'o': u}] WHEN 1 THEN [{'at': 0, 'i': u, 'o': t}, {'at': 1, 'i': 'x', 'o': u}, {'at': 2, 'i': '', 'o': '{}'}]
 WHEN 2 THEN [{'at': 0, 'i': u, 'o': t}, {'at': 1, 'i': NULL, 'o': NULL}, {'at': 2, 'i': u, 'o': concat('[', u, ', 2]')}] ELSE [{'at': 0, 'i': NULL, 'o': NULL}] END) AS q FROM r)
SELECT event_id, CAST(q['at'] AS INT) AS at, q['i'] AS input, q['o'] AS output, q['i'] IS NULL AS faulty FROM x""")
def read_test_cases(spark, sf_dir: str) -> DataFrame:
    """Functional tests of all written forms; a faulty one is a row that says so."""
    tables(spark, sf_dir, "events")
    found = code_run.test_cases(spark.sql(_TESTS))
    return found.select("event_id", "at", "input", "output", F.col("error").isNotNull().alias("faulty"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g')), '\s+'), lambda x: x <> '') AS a,
 list_filter(regexp_split_to_array(trim(regexp_replace(lower(truth), '[^\p{L}\p{N}_\s]', ' ', 'g')), '\s+'), lambda x: x <> '') AS b FROM pairs),
f AS (SELECT doc_id, len(a) + len(b) AS n, list_filter(a, lambda x: list_contains(b, x)) AS a, b FROM t),
l AS (SELECT doc_id, n, list_reduce(list_prepend(list_transform(b, lambda x: 0), list_transform(a, lambda x: list_transform(b, lambda y: CASE WHEN x = y THEN 1 ELSE 0 END))),
 lambda row, hit: list_transform(range(1, len(row) + 1), lambda j: list_max(list_prepend(row[j], list_transform(list_filter(range(1, j + 1), lambda i: hit[i] = 1), lambda i: coalesce(row[i - 1], 0) * CASE WHEN i > 1 THEN 1 ELSE 0 END + 1))))) AS row FROM f)
SELECT doc_id, round(CASE WHEN n = 0 OR len(row) = 0 THEN 0 ELSE 2.0 * row[-1] / n END, 6) AS score FROM l""")
def score_rouge_documents(spark, sf_dir: str) -> DataFrame:
    """The longest common subsequence of whole documents and benchmark items; SQL fills the whole table."""
    score = S.rouge_l(T.tokens(F.col("text")), T.tokens(F.col("truth")))
    pairs = view(spark, sf_dir, "pairs").repartition(spark.sparkContext.defaultParallelism, "doc_id")  # few bytes, much work
    return pairs.select("doc_id", F.round(score, 6).alias("score"))


#: Six ideographs a row, of four, with more of some pairs than of others.
_SIX_LETTERS = "SELECT l_orderkey, l_linenumber, l_partkey, concat(" + ", ".join(f"CASE CAST((l_partkey * {k} + l_suppkey * {m}) % 7 AS INT) WHEN 0 THEN '山' WHEN 1 THEN '山' WHEN 2 THEN '水' WHEN 3 THEN '水' WHEN 4 THEN '火' WHEN 5 THEN '木' ELSE '水' END" for k, m in ((1, 0), (3, 1), (1, 0), (5, 2), (3, 1), (2, 5))) + ", ' abc') AS text FROM lineitem"


@query(f"""WITH t AS ({_SIX_LETTERS}), runs AS (SELECT left(text, 6) AS run, count(*) AS times FROM t GROUP BY 1),
g AS (SELECT substr(run, i, k) AS w, times FROM runs, (SELECT unnest(range(1, 7)) AS i), (SELECT unnest(range(1, 4)) AS k) WHERE i + k <= 7),
d AS (SELECT w, round(ln(sum(times) / (SELECT sum(6 * times) FROM runs)) * 1000000)::BIGINT AS weight FROM g GROUP BY w HAVING sum(times) >= 2 OR length(w) = 1),
cuts AS (SELECT m, list_filter(range(1, 7), lambda i: i = 1 OR (m >> (i - 2)) & 1 = 1) AS starts FROM (SELECT unnest(range(0, 32)) AS m)),
sizes AS (SELECT m, starts, list_transform(range(1, len(starts) + 1), lambda j: coalesce(starts[j + 1], 7) - starts[j]) AS lens FROM cuts),
parts AS (SELECT run, m, unnest(starts) AS s, unnest(lens) AS l FROM runs, sizes WHERE list_max(lens) <= 3),
paths AS (SELECT run, m, sum(weight) AS weight, string_agg(w, '/' ORDER BY s) AS words, list(l ORDER BY s) AS lens, count(*) = (SELECT len(starts) FROM sizes z WHERE z.m = p.m) AS whole FROM parts p JOIN d ON w = substr(run, s, l) GROUP BY run, m),
best AS (SELECT run, arg_max(words, {{'w': weight, 'l': lens}}) AS words FROM paths WHERE whole GROUP BY run)
SELECT l_orderkey, l_linenumber, l_partkey, concat(words, '/abc') AS words FROM t JOIN best ON run = left(text, 6)""")
def segmented_words(spark, sf_dir: str) -> DataFrame:
    """Words of texts without spaces, by a dictionary that the texts themselves give; SQL tries all 32 ways to cut a text."""
    tables(spark, sf_dir, "lineitem")
    rows = spark.sql(_SIX_LETTERS)
    words = segment.dictionary(rows, longest=3)
    return segment.segmented(rows, words).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("words", "/").alias("words"))
