"""Queries on answer extraction and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import symbolic
from ..functions import text as T
from .views import tables, view, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = with_views(sql)
        return f

    return add


#: The ladder in RE2 over the (ASCII) answers.
LADDER = r"""ext AS (SELECT *, CASE WHEN contains(text, '\boxed{') THEN regexp_extract(text, '\\boxed\{([^}]+)\}', 1)
 WHEN regexp_matches(text, '(?i)answer\s*:\s*[A-Z]') THEN upper(regexp_extract(text, '(?i)answer\s*:\s*([A-Z])', 1))
 WHEN regexp_matches(text, '(?i)(?:option|choice|select)[:\s]*[A-Z]') THEN upper(regexp_extract(text, '(?i)(?:option|choice|select)[:\s]*([A-Z])', 1))
 WHEN regexp_matches(text, '\b[A-Z]\b') THEN list_extract(regexp_extract_all(text, '\b([A-Z])\b', 1), -1) ELSE trim(text) END AS x FROM answers)"""


def _answers(spark, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "answers")


@query(f"WITH {LADDER} SELECT text, truth, x AS extracted, count(*) AS n FROM ext GROUP BY ALL")
def extract_mcq(spark, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    return a.groupBy("text", "truth", T.answer(F.col("text")).alias("extracted")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LADDER} SELECT l_linenumber, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN x = truth THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS exact, CAST(sum(CASE WHEN x = truth THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS accuracy, CAST(sum(CASE WHEN x = chr(CAST(65 + l_linenumber + 1 AS INT)) THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS by_index FROM ext GROUP BY l_linenumber")
def score_mcq(spark, sf_dir: str) -> DataFrame:
    x, truth = F.col("x"), F.col("truth")
    index = (F.col("l_linenumber") + 1).cast("double").cast("string")
    rows = _answers(spark, sf_dir).select("l_linenumber", "truth", T.answer(F.col("text")).alias("x"))
    return rows.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum(S.score_if(x == T.strip(truth))).alias("exact"), F.sum(S.mcq_accuracy_of(x, truth)).alias("accuracy"), F.sum(S.mcq_accuracy_of(x, index)).alias("by_index"))


#: What strip() takes off, in RE2.
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(rf"""SELECT doc_id, CASE WHEN x <> '' THEN x ELSE 'B' END AS extracted FROM (SELECT doc_id,
 regexp_replace(regexp_extract(replace(coalesce(text, ''), '\text{{', '') || '}}', '^[^}}]*'), '^{_BLANK}|{_BLANK}$', '', 'g') AS x FROM documents)""")
def extract_boxed(spark, sf_dir: str) -> DataFrame:
    """Whole texts of all documents; a blank box falls through to the ladder's later rungs."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", T.answer(boxed_text(F.col("text"))).alias("extracted"))


def boxed_text(text):
    return F.concat(F.lit("thus \\boxed{ \\text{"), F.coalesce(text, F.lit("")), F.lit("} } or \\boxed{B}"))


#: Answers with a number, and truths that are it, a hundredth of it, the number of another column, or no number.
_AMOUNTS = r"""SELECT l_orderkey, l_partkey, l_linenumber, CASE CAST(l_partkey % 6 AS INT) WHEN 0 THEN concat('the result is \boxed{x = ', q, ',000}') WHEN 1 THEN concat('Final answer: ', q)
  WHEN 2 THEN concat('\boxed{', q, '\%}') WHEN 3 THEN concat('answer is ', q, '.0') WHEN 4 THEN concat('no more than ', q, ' of ', p) ELSE 'none at all' END AS text,
 CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN concat(q, '000') WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN concat(q, '%') ELSE 'none at all' END AS truth
 FROM (SELECT *, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(9)) AS q, CAST(l_partkey % 50 AS VARCHAR(9)) AS p FROM lineitem) AS li"""


@query(rf"""WITH m AS ({_AMOUNTS}), x AS (SELECT *, trim(regexp_extract(CASE WHEN contains(text, '\boxed{{') THEN regexp_extract(text, '\\boxed\{{([^}}]*)', 1)
  WHEN regexp_matches(text, '(?i)answer\s*[:\-]') THEN regexp_extract(text, '(?i)answer\s*[:\-]\s*([^\n]+)', 1) WHEN regexp_matches(text, '(?i)answer\s+is\s') THEN regexp_extract(text, '(?i)answer\s+is\s+([^\n]+)', 1)
  WHEN regexp_matches(text, '[0-9]') THEN regexp_extract_all(text, '\b([0-9]+)\b', 1)[-1] ELSE text END, '[^=]*$')) AS a FROM m),
n AS (SELECT *, TRY_CAST(regexp_replace(replace(a, ',', ''), '\\?%$', '') AS DOUBLE) / (CASE WHEN ends_with(a, '%') THEN 100 ELSE 1 END) AS u, TRY_CAST(regexp_replace(truth, '%$', '') AS DOUBLE) / (CASE WHEN ends_with(truth, '%') THEN 100 ELSE 1 END) AS v FROM x)
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN lower(a) = lower(truth) THEN 1.0 WHEN u IS NOT NULL AND v IS NOT NULL AND
 len(list_filter([v / 100, v, v * 100], lambda z: abs(u - z) <= 1e-4 * greatest(abs(u), abs(z)))) > 0 THEN 1.0 ELSE 0.0 END AS score FROM n""")
def score_numeric(spark, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "lineitem")
    rows = spark.sql(_AMOUNTS.replace("\\", "\\\\"))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", S.math_metric(F.col("text"), F.col("truth")).alias("score"))


#: Linear formulas written in two ways; they are equal if the products of their parts are.
_FORMULAS = r"""SELECT p_partkey, p_size AS a, p_partkey % 7 + 1 AS b, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size * (p_partkey % 3 + 1) END AS c, (p_partkey % 7 + 1) * (p_partkey % 2 + 1) AS d, p_partkey % 5 AS k FROM part"""
_WRITTEN = r"""SELECT p_partkey, CASE CAST(k % 3 AS INT) WHEN 0 THEN concat('so \boxed{\frac{', a, '}{', b, '}x + ', k, '}') WHEN 1 THEN concat('\boxed{y = ', a, 'x/', b, ' + ', k, '}') ELSE concat('\boxed{', k, '+x\cdot\left(', a, '/', b, '\right)}') END AS text,
 CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN concat(k, ' + \frac{', c, 'x}{', d, '}') WHEN 1 THEN concat('y=(', c, '*x)/', d, '+', k) ELSE concat('\frac{', c, 'x + ', k * d, '}{', d, '}') END AS truth
 FROM (SELECT p_partkey, CAST(a AS VARCHAR(9)) AS a, CAST(b AS VARCHAR(9)) AS b, CAST(c AS VARCHAR(9)) AS c, CAST(d AS VARCHAR(9)) AS d, k, k * d FROM formulas) AS f""".replace("k * d FROM", "CAST(k * d AS VARCHAR(9)) AS kd FROM").replace("k * d, '}{'", "kd, '}{'")


@query(f"SELECT p_partkey, CASE WHEN a * d = b * c THEN 1.0 ELSE 0.0 END AS score FROM ({_FORMULAS}) AS f")
def score_formulas(spark, sf_dir: str) -> DataFrame:
    """Formulas of one variable that only their values show to be equal; SQL multiplies crosswise."""
    tables(spark, sf_dir, "part")
    spark.sql(_FORMULAS).createOrReplaceTempView("formulas")
    rows = spark.sql(_WRITTEN.replace("\\", "\\\\"))
    return symbolic.with_math_scores(rows).select("p_partkey", "score")


_TOK = r"list_filter(regexp_split_to_array(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+'), lambda x: x <> '')"


@query(f"""WITH t AS (SELECT doc_id, {_TOK.format('text')} AS a, {_TOK.format('truth')} AS b FROM pairs),
c AS (SELECT doc_id, 'a' AS s, unnest(a) AS w FROM t UNION ALL SELECT doc_id, 'b', unnest(b) FROM t),
o AS (SELECT doc_id, sum(least(x, y)) AS o, count(*) FILTER (x > 0 AND y > 0) AS d FROM (SELECT doc_id, w, count(*) FILTER (s = 'a') AS x, count(*) FILTER (s = 'b') AS y FROM c GROUP BY doc_id, w) GROUP BY doc_id),
r AS (SELECT doc_id, a, b, unnest([a, b]) AS arr, unnest([b, a]) AS other, unnest([1, 2]) AS side FROM t),
k AS (SELECT doc_id, side, len(list_filter(range(1, len(arr) + 1), lambda i: list_contains(other, arr[i]) AND (i = 1 OR NOT list_contains(other, arr[i - 1])))) AS n FROM r),
m AS (SELECT doc_id, min(n) AS n FROM k GROUP BY doc_id)
SELECT t.doc_id, round(CASE WHEN o.o > 0 THEN 2.0 * o.o / (len(a) + len(b)) ELSE 0 END, 6) AS f1,
 round(CASE WHEN o.d = 0 THEN 0 ELSE 2.0 * o.o / (len(a) + len(b)) * (1 - CASE WHEN m.n = o.d THEN 0 ELSE 0.5 * pow(m.n / o.d, 2) END) END, 6) AS meteor
FROM t JOIN o USING (doc_id) JOIN m USING (doc_id)""")
def score_overlap(spark, sf_dir: str) -> DataFrame:
    pairs = view(spark, sf_dir, "pairs").repartition("doc_id").select("doc_id", T.tokens(F.col("text")).alias("a"), T.tokens(F.col("truth")).alias("b"))
    return S.overlap_by_count(pairs, "doc_id", "a", "b").select("doc_id", F.round("f1", 6).alias("f1"), F.round("meteor", 6).alias("meteor"))


_COUNTED = """SELECT event_id, concat(props, ' and ', CAST(user_id AS VARCHAR(19)), ', ', CAST(event_id % 40 AS VARCHAR(19)), CASE WHEN event_type = 'view' THEN ' none' ELSE concat(' or ', CAST(user_id % 40 AS VARCHAR(19))) END) AS text,
 CASE WHEN event_type = 'error' THEN 'no number' ELSE concat('Paragraph ', CAST(user_id % 40 AS VARCHAR(19))) END AS truth FROM events"""


@query(rf"""WITH n AS (SELECT event_id, regexp_extract_all(text, '[0-9]+') AS own, regexp_extract(truth, 'Paragraph ([0-9]+)', 1) AS want FROM ({_COUNTED}) AS c)
SELECT event_id, round(CASE WHEN len(own) = 0 THEN 0.0 ELSE len(list_filter(own, lambda x: x = want)) / len(own) END, 9) AS score FROM n""")
def score_lists(spark, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return spark.sql(_COUNTED).select("event_id", F.round(S.retrieval_score(F.col("text"), F.col("truth")), 9).alias("score"))

_CLASSES = ["ring", "small", "red", "in", "bolt", "small ring", "ECONOMY", "i"]


@query(f"""WITH t AS (SELECT p_partkey, p_name AS truth, list_filter(list_filter({_CLASSES!r}, lambda c: c <> p_name) || [p_name], lambda c: contains(concat(p_name, ' ', p_type, CASE WHEN p_size % 3 = 0 THEN ' small ring' ELSE '' END), c)) AS named FROM part),
e AS (SELECT p_partkey, truth, unnest(named) AS c, generate_subscripts(named, 1) AS i FROM t),
r AS (SELECT *, contains(truth, c) AND c <> truth AS within FROM e),
p AS (SELECT *, i - coalesce(max(CASE WHEN within THEN 0 ELSE i END) OVER (PARTITION BY p_partkey ORDER BY i), 0) AS place FROM r),
k AS (SELECT p_partkey, count(*) FILTER (NOT (within AND place % 2 = 1)) AS n, count(*) FILTER (c = truth) AS hit FROM p GROUP BY p_partkey)
SELECT t.p_partkey, round(CASE WHEN k.hit > 0 THEN 1.0 / k.n ELSE 0 END, 9) AS score FROM t LEFT JOIN k USING (p_partkey)""")
def score_classes(spark, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" "), "p_type", F.when(F.col("p_size") % 3 == 0, " small ring").otherwise(""))
    classes = F.concat(F.filter(F.array(*map(F.lit, _CLASSES)), lambda c: c != F.col("p_name")), F.array("p_name"))
    score = S.class_score(text, F.col("p_name"), classes)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.round(score, 9).alias("score"))


#: Exact answers, chess moves and yes-or-no answers in many spellings, from the parts.
_NAMED = r"""SELECT p_partkey, concat('so \boxed{ ', CASE WHEN p_size % 2 = 0 THEN upper(replace(p_name, ' ', '_')) ELSE concat(p_type, '  ', p_name) END, '}') AS t1,
 CASE WHEN p_partkey % 3 = 0 THEN concat(p_type, '_', p_name) ELSE p_name END AS g1,
 CASE p_size % 5 WHEN 0 THEN concat('I play ', mv, ' or e2e4') WHEN 1 THEN concat('\boxed{', upper(mv), '}') WHEN 2 THEN concat('move: ', upper(mv), 'x') WHEN 3 THEN concat('I choose ', chr(65 + CAST(p_size % 4 AS INT))) ELSE ' unsure ' END AS t2,
 CASE p_partkey % 5 WHEN 0 THEN mv WHEN 1 THEN upper(concat(left(mv, 2), '-', right(mv, 2))) WHEN 2 THEN CAST(p_size % 4 AS VARCHAR(9)) WHEN 3 THEN 'e2e4' ELSE 'unsure' END AS g2,
 concat('\boxed{', CASE p_size % 8 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' WHEN 2 THEN 'A' WHEN 3 THEN 'B' WHEN 4 THEN '1' WHEN 5 THEN '0' WHEN 6 THEN 'True' ELSE 'No' END, '}') AS t3,
 CASE p_partkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN '1' WHEN 3 THEN '0.0' WHEN 4 THEN 'yes' WHEN 5 THEN '1.0' ELSE 'True' END AS g3
 FROM (SELECT *, concat(chr(97 + CAST(p_size % 8 AS INT)), CAST(p_size % 7 + 1 AS VARCHAR(9)), chr(97 + CAST(p_partkey % 8 AS INT)), CAST(p_partkey % 6 + 1 AS VARCHAR(9))) AS mv FROM part) AS x"""


@query(rf"""WITH n AS ({_NAMED}), box AS (SELECT *, trim(regexp_extract(t1, '\\boxed\{{([^}}]+)\}}', 1)) AS x1, regexp_extract(t3, '\\boxed\{{([^}}]+)\}}', 1) AS x3,
 regexp_replace(lower(CASE WHEN contains(t2, 'boxed') THEN regexp_extract(t2, '\{{(.*)\}}', 1) WHEN regexp_matches(t2, '(?i)\b[a-h][1-8][a-h][1-8]\b') THEN regexp_extract_all(t2, '(?i)\b[a-h][1-8][a-h][1-8]\b')[-1]
  WHEN regexp_matches(t2, '(?i)(move|play)[:\s]*[a-h][1-8][a-h][1-8]') THEN regexp_extract(t2, '(?i)(?:move|play)[:\s]*([a-h][1-8][a-h][1-8])', 1)
  WHEN regexp_matches(t2, '\b[A-Z]\b') THEN regexp_extract_all(trim(t2), '\b[A-Z]\b')[-1] ELSE trim(t2) END), '[^a-z0-9]', '', 'g') AS x2 FROM n),
keys(key, num, word) AS (VALUES ('A', '0.0', 'Yes'), ('B', '1.0', 'No'), ('X', NULL, 'Yes'), ('Y', NULL, 'No'), ('0', '0.0', 'No'), ('1', '1.0', 'Yes'), ('TRUE', '1.0', 'Yes'), ('FALSE', '0.0', 'No')),
side AS (SELECT *, CASE WHEN len(x2) = 1 AND x2 BETWEEN 'a' AND 'z' THEN upper(x2) ELSE x2 END AS c2, CASE WHEN regexp_full_match(g2, '[0-9]+') THEN chr(65 + CAST(g2 AS INT)) ELSE regexp_replace(lower(g2), '[^a-z0-9]', '', 'g') END AS d2 FROM box)
SELECT p_partkey, CASE WHEN regexp_replace(lower(replace(x1, '_', ' ')), '\s+', ' ', 'g') = regexp_replace(lower(replace(g1, '_', ' ')), '\s+', ' ', 'g') THEN 1.0 ELSE 0.0 END AS exact,
 CASE WHEN c2 = d2 THEN 1.0 ELSE 0.0 END AS chess,
 CASE WHEN coalesce(CASE WHEN g3 IN ('0', '1', '0.0', '1.0') THEN num WHEN lower(g3) IN ('yes', 'no') THEN word END, x3) = g3 THEN 1.0 ELSE 0.0 END AS superglue FROM side LEFT JOIN keys ON key = upper(x3)""")
def score_named(spark, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "part")
    c = F.col
    scores = [S.exact_match(c("t1"), c("g1")).alias("exact"), S.chess_accuracy(c("t2"), c("g2")).alias("chess"), S.superglue_exact(c("t3"), c("g3")).alias("superglue")]
    return spark.sql(_NAMED.replace("\\", "\\\\")).select("p_partkey", *scores)


#: All subsequences of a short list, as texts.
_SUBS = "list_distinct(list_transform(range(0, CAST(pow(2, len({0})) AS BIGINT)), lambda m: array_to_string(list_filter({0}, lambda w, i: (m >> (i - 1)) & 1 = 1), ' ')))"


@query(f"""WITH t AS (SELECT p_partkey, string_split(concat(p_name, ' ', lower(p_type)), ' ') AS a, string_split(concat(lower(p_type), ' small ', p_name), ' ') AS b FROM part),
s AS (SELECT p_partkey, a, b, list_intersect({_SUBS.format('a')}, {_SUBS.format('b')}) AS same FROM t)
SELECT p_partkey, round(2.0 * list_max(list_transform(same, lambda x: CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END)) / (len(a) + len(b)), 9) AS score FROM s""")
def score_rouge(spark, sf_dir: str) -> DataFrame:
    """Longest common subsequences of words; SQL meets all subsequences of both sides."""
    words = lambda *c: F.split(F.concat_ws(" ", *c), " ")
    kind = F.lower("p_type")
    score = S.rouge_l(words("p_name", kind), words(kind, F.lit("small"), "p_name"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.round(score, 9).alias("score"))


_LETTERS = "list_filter(string_split(regexp_replace({0}, '(.)', '\\1 ', 'g'), ' '), lambda x: x <> '')"


@query(f"""WITH t AS (SELECT n_nationkey, {_LETTERS.format("concat('x', replace(r_name, ' ', '_'))")} AS a, {_LETTERS.format('n_name')} AS b FROM nation JOIN region ON r_regionkey = n_regionkey),
s AS (SELECT n_nationkey, a, b, list_intersect({_SUBS.format('a')}, {_SUBS.format('b')}) AS same FROM t)
SELECT n_nationkey, round_even(200.0 * list_max(list_transform(same, lambda x: CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END)) / (len(a) + len(b)), 0) / 100 AS score FROM s""")
def score_code_line(spark, sf_dir: str) -> DataFrame:
    """The first line without a comment against the truth, by characters."""
    tables(spark, sf_dir, "nation", "region")
    rows = spark.sql("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
    text = F.concat(F.lit("\n\n# a note\n// another\nx"), F.translate("r_name", " ", "_"), F.lit("\nmore"))
    return rows.select("n_nationkey", S.code_similarity(text, F.col("n_name")).alias("score"))


_FENCED = "'See:' || chr(10) || '```python' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || 'then' || chr(10) || '```python' || chr(10) || coalesce(text, '') || chr(10) || '```' || chr(10)"


@query(rf"""SELECT conv_id, turn, md5(regexp_replace(list_extract(regexp_extract_all({_FENCED}, '(?is)```python\s*\n(.*?)\n```', 1), -1), '^{_BLANK}|{_BLANK}$', '', 'g')) AS body FROM conversations""")
def extract_code(spark, sf_dir: str) -> DataFrame:
    """The last fenced block of whole texts of all turns, null and fenced ones included."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    fenced = F.concat(F.lit("See:\n```python\nx = 1\n```\nthen\n```python\n"), F.coalesce("text", F.lit("")), F.lit("\n```\n"))
    return c.select("conv_id", "turn", F.md5(T.code_block(fenced).cast("binary")).alias("body"))


def _tidy(column: str) -> str:
    """English normalisation in SQL; articles go twice, as two side by side share a space."""
    out = rf"regexp_replace(lower({column}), '[!-/:-@\[-`{{-~]', '', 'g')"
    for _ in range(2):
        out = rf"regexp_replace({out}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \3', 'g')"
    return out


@query(rf"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array({_tidy('text')}, '{_BLANK}'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array({_tidy('truth')}, '{_BLANK}'), lambda x: x <> '') AS b FROM pairs),
c AS (SELECT doc_id, w, count(*) FILTER (s = 'a') AS x, count(*) FILTER (s = 'b') AS y FROM (SELECT doc_id, 'a' AS s, unnest(a) AS w FROM t UNION ALL SELECT doc_id, 'b', unnest(b) FROM t) GROUP BY doc_id, w),
o AS (SELECT doc_id, sum(least(x, y)) AS o FROM c GROUP BY doc_id)
SELECT t.doc_id, round(CASE WHEN o.o > 0 THEN 2.0 * o.o / (len(a) + len(b)) ELSE 0 END, 6) AS f1 FROM t JOIN o USING (doc_id)""".replace(r"\b(a|an|the)\b", r"\b(a|an|the)\b"))
def score_qa(spark, sf_dir: str) -> DataFrame:
    """Token F1 of English texts without marks and articles."""
    words = lambda c: F.filter(F.split(T.normalize_english(F.col(c)), " "), lambda x: x != "")
    pairs = view(spark, sf_dir, "pairs").where("truth is not null").repartition("doc_id").select("doc_id", words("text").alias("a"), words("truth").alias("b"))
    return S.overlap_by_count(pairs, "doc_id", "a", "b").select("doc_id", F.round("f1", 6).alias("f1"))


_CJK = """SELECT l_orderkey, l_linenumber, l_partkey, concat('《段落', CAST(l_partkey % 9 AS VARCHAR(9)), '》。 Ａbc，  第', CAST(l_suppkey % 9 AS VARCHAR(9)), CASE WHEN l_linenumber = 1 THEN ' 或 100…！' ELSE '页 — (Ok). ' END) AS text,
 concat('段落', CAST(l_suppkey % 9 AS VARCHAR(9)), '页') AS truth FROM lineitem"""


@query(rf"""SELECT l_orderkey, l_linenumber, l_partkey, regexp_replace(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~{T.CJK_MARKS}', ''), '{_BLANK}', '', 'g') AS tidy,
 round(CASE WHEN len(own) = 0 THEN 0.0 ELSE len(list_filter(own, lambda x: x = regexp_extract(truth, '([0-9]+)', 1))) / len(own) END, 9) AS score FROM (SELECT *, regexp_extract_all(text, '[0-9]+') AS own FROM ({_CJK}) AS t)""")
def chinese_answers(spark, sf_dir: str) -> DataFrame:
    """Normalised Chinese texts, and the score of the passage that they name."""
    tables(spark, sf_dir, "lineitem")
    rows = spark.sql(_CJK)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", T.normalize_chinese(F.col("text")).alias("tidy"), F.round(S.retrieval_score(F.col("text"), F.col("truth"), "段落"), 9).alias("score"))


_CJK_LINES = "SELECT n_nationkey, concat('第', CAST(n_nationkey AS VARCHAR(9)), '页', n_name) AS text, concat(n_name, ' 第', CAST(n_regionkey AS VARCHAR(9)), '页') AS truth FROM nation"


@query(f"""WITH t AS (SELECT n_nationkey, regexp_extract_all(lower(text), '([一-鿿]|[^\\s一-鿿]+)') AS a, regexp_extract_all(lower(truth), '([一-鿿]|[^\\s一-鿿]+)') AS b FROM ({_CJK_LINES}) AS l),
s AS (SELECT n_nationkey, a, b, list_intersect({_SUBS.format('a')}, {_SUBS.format('b')}) AS same FROM t)
SELECT n_nationkey, round(2.0 * list_max(list_transform(same, lambda x: CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END)) / (len(a) + len(b)), 9) AS score FROM s""")
def score_rouge_chinese(spark, sf_dir: str) -> DataFrame:
    """The longest common subsequence over characters, as no dictionary of words is here."""
    tables(spark, sf_dir, "nation")
    return spark.sql(_CJK_LINES).select("n_nationkey", F.round(S.rouge_l(T.characters(F.col("text")), T.characters(F.col("truth"))), 9).alias("score"))


_METEOR = "SELECT p_partkey, concat('so \\boxed{', p_name, ' ', p_type, CASE WHEN p_size % 2 = 0 THEN '' ELSE ' bolt' END, '}') AS text, concat(p_type, CASE WHEN p_partkey % 2 = 0 THEN ' the ' ELSE ', ' END, p_name) AS truth FROM part"


@query(rf"""WITH t AS (SELECT p_partkey, string_split(lower(regexp_extract(text, '\{{(.*)\}}', 1)), ' ') AS a, regexp_extract_all(lower(truth), '[a-z]+') AS b FROM ({_METEOR}) AS m),
w AS (SELECT p_partkey, w, count(*) FILTER (s = 1) AS x, count(*) FILTER (s = 2) AS y FROM (SELECT p_partkey, 1 AS s, unnest(a) AS w FROM t UNION ALL SELECT p_partkey, 2, unnest(b) FROM t) GROUP BY ALL),
o AS (SELECT p_partkey, sum(least(x, y)) AS same, count(*) FILTER (x > 0 AND y > 0) AS kinds FROM w GROUP BY ALL),
r AS (SELECT p_partkey, a, b, len(list_filter(range(1, len(a) + 1), lambda i: list_contains(b, a[i]) AND (i = 1 OR NOT list_contains(b, a[i - 1])))) AS p, len(list_filter(range(1, len(b) + 1), lambda i: list_contains(a, b[i]) AND (i = 1 OR NOT list_contains(a, b[i - 1])))) AS q FROM t)
SELECT p_partkey, round(CASE WHEN same = 0 THEN 0 ELSE 2.0 * same / (len(a) + len(b)) * (1 - CASE WHEN least(p, q) = kinds THEN 0 ELSE 0.5 * pow(least(p, q) / kinds, 2) END) END, 9) AS score FROM r JOIN o USING (p_partkey)""")
def score_meteor(spark, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "part")
    rows = spark.sql(_METEOR.replace("\\", "\\\\"))
    return rows.select("p_partkey", F.round(S.meteor(F.col("text"), F.col("truth")), 9).alias("score"))


_LOOSE = """SELECT event_id, CASE event_type WHEN 'click' THEN concat('he said "', props, '" or ''x y'' at last') WHEN 'view' THEN concat('take (', CAST(user_id AS VARCHAR(19)), ') then (', CAST(user_id % 7 AS VARCHAR(19)), ' or so)')
 WHEN 'error' THEN concat('see [ ', CAST(user_id AS VARCHAR(19)), ' ] here') WHEN 'signup' THEN concat('my result: ', CAST(user_id AS VARCHAR(19)), ' apples.', chr(10), 'more') ELSE 'nothing to see' END AS text FROM events"""


@query(r"""SELECT event_id, CASE WHEN regexp_matches(text, '["''][^"'']+["'']') THEN trim(list_extract(regexp_extract_all(text, '["'']([^"'']+)["'']', 1), -1)) WHEN contains(text, '(') THEN trim(list_extract(regexp_extract_all(text, '\(([^)]+)\)', 1), -1))
 WHEN contains(text, '[') THEN trim(regexp_extract(text, '\[([^\]]+)\]', 1)) WHEN contains(text, 'result: ') THEN regexp_replace(regexp_extract(text, 'result: ([^\n]+)', 1), '\.$', '') ELSE '' END AS loose,
 CASE WHEN contains(text, 'result: ') THEN regexp_replace(regexp_extract(text, 'result: ([^\n]+)', 1), '\.$', '') WHEN regexp_matches(text, '[0-9]') THEN list_extract(regexp_extract_all(text, '\b[0-9]+(?:\.[0-9]+)?\b'), -1) ELSE '' END AS number,
 upper(text[1]) AS first FROM (""" + _LOOSE + ") AS t")
def extract_loose(spark, sf_dir: str) -> DataFrame:
    """The looser ladders: marks around an answer, a last number, a first character."""
    tables(spark, sf_dir, "events")
    t, empty = F.col("text"), F.lit("")
    rows = spark.sql(_LOOSE.replace("''x y''", "\\'x y\\'"))
    return rows.select("event_id", F.coalesce(T.general(t), empty).alias("loose"), F.coalesce(T.math_or_number(t), empty).alias("number"), T.answer(t, "SuperGLUE-ClozeTest").alias("first"))


_PROGRAMS = "SELECT event_id, concat('Try:', chr(10), '```', CASE WHEN user_id % 2 = 0 THEN 'python' ELSE '' END, chr(10), 'a = ', CAST(user_id AS VARCHAR(19)), chr(10), '```', chr(10), 'or ```py', chr(10), '<code>print(', props, ')</code> end```', chr(10), 'Input: ', CAST(user_id AS VARCHAR(19)), ' Output: ', event_type, CASE WHEN user_id % 3 = 0 THEN ' Output: x' ELSE '' END, ' Input: z Output: 5') AS text FROM events"


@query(rf"""SELECT event_id, len(regexp_extract_all(text, '(?s)```[a-zA-Z]*\n.*?```')) AS blocks, replace(string_split(list_extract(regexp_extract_all(text, '(?s)```[a-zA-Z]*\n(.*?)```', 1), -1), '</code>')[1], '<code>', '') AS last_block,
 array_to_string(list_transform(list_filter(list_transform(string_split(text, 'Input:'), lambda x: string_split(x, 'Output:')), lambda x: len(x) = 2), lambda x: concat(trim(x[1]), '>', trim(x[2]))), '|') AS tests FROM (SELECT event_id, text FROM ({_PROGRAMS}) AS p)""")
def cut_programs(spark, sf_dir: str) -> DataFrame:
    """Fenced blocks, the tidied last one, and tests written as text."""
    from ..functions import code_run

    tables(spark, sf_dir, "events")
    t = F.col("text")
    line = lambda c: F.regexp_replace(c, r"\n$", "")
    tests = F.transform(code_run.stdin_tests(t), lambda x: F.concat(line(x["input"]), F.lit(">"), line(x["output"])))
    return spark.sql(_PROGRAMS).select("event_id", F.size(code_run.fenced_blocks(t)).cast("long").alias("blocks"), code_run.answer_code(t).alias("last_block"), F.array_join(tests, "|").alias("tests"))
