"""From predictions to scores: gates, matching with the truth, choice of scorers, scoring, guards.

Dimension tables (models, prices, configurations, benchmark items) are broadcast only after
:func:`dimension` has counted them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions.code_run import code_projection, with_code_scores, with_private_tests
from ..functions.symbolic import with_math_scores
from .containment import holders
from .costs import canonical, dimension
from .keyed import keep_first, keep_last

# Names of metrics, and of the data sets that have one without a configuration.
METRICS = ["mcq_accuracy", "mcq_exact_match", "math_metric", "exact_match", "code_accuracy", "meteor_score", "chess_accuracy", "superglue_exact_match", "superglue_clozetest"]
DATASET_METRICS = {
    "lsat-ar": ["mcq_exact_match"],
    "AIME2024": ["math_metric"],
    "MATH-500": ["math_metric"],
    "MMLUPro": ["mcq_accuracy"],
    "livecodebench": ["code_accuracy"],
    "OpenTDB": ["mcq_accuracy"],
    "MATH": ["math_metric"],
    "NarrativeQA": ["meteor_score"],
}
DEFAULT_METRIC = "mcq_accuracy"
CONFIG_ALIASES = {"GeoGraphyData_100k": "GeoGraphyData"}


def blank(c: Column) -> Column:
    """Null or empty: what counts as absent in a text."""
    return F.coalesce(c, F.lit("")) == ""


def complete(rows: DataFrame) -> DataFrame:
    """Rows that have a key and a prompt."""
    return rows.where(~blank(F.col("global_index")) & ~blank(F.col("prompt")))


def evaluable(rows: DataFrame, registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` (global_index, prediction, has_result, success, ...) with canonical and the first
    reason why a row can't be evaluated; null if it can."""
    known = canonical(rows, registry, aliases, "prediction")
    reason = (
        F.when(blank(F.col("global_index")), "missing_key")
        .when(blank(F.col("prediction")), "missing_model")
        .when(~F.coalesce("has_result", F.lit(False)), "no_result")
        .when(~F.coalesce("success", F.lit(False)), "unsuccessful")
        .when(~F.col("known"), "unknown_model")
    )
    return known.withColumn("reason", reason).drop("known")


def unevaluated(cache: DataFrame, rerun: bool = False) -> DataFrame:
    """Successful entries without a score; with ``rerun`` all successful entries."""
    held = cache.where(F.coalesce("success", F.lit(False)))
    return held if rerun else held.where("score is null")


def unscored(rows: DataFrame) -> DataFrame:
    """Rows that a resumed evaluation has left: those without an accuracy, or with one and no cost."""
    return rows.where("accuracy is null or cost is null")


def sure(rows: DataFrame, registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` (prediction, ...) of a router that names one model and no confidences, with
    all_confidence: 1 for the canonical name of its choice. Raises if a name is not known."""
    named = canonical(rows, registry, aliases, "prediction")
    unknown = [r[0] for r in named.where(~F.col("known")).select("prediction").distinct().limit(10).collect()]
    if unknown:
        raise ValueError(f"models that the registry lacks: {sorted(map(str, unknown))}")
    return named.withColumn("all_confidence", F.create_map("canonical", F.lit(1.0))).drop("known", "canonical")


def benchmark_problems(problems: DataFrame, keys: DataFrame, mark: str = "LiveCodeBench") -> DataFrame:
    """The code problems that a benchmark asks, as code matching reads them. ``keys`` (global_index, pos): those
    that hold ``mark`` end in the number that a problem has as ``_index`` (of keys with one number the last counts).
    Problems that no key asks, and those whose private tests can't be decoded, are left out."""
    number = lambda c: F.substring_index(c, "_", -1).try_cast("long")
    asked = keys.where(F.contains("global_index", F.lit(mark))).select(number("global_index").alias("at"), F.col("global_index").alias("global_idx"), "pos").where("at is not null")
    own = problems.drop("global_idx").withColumn("at", F.col("_index").try_cast("long"))
    held = with_private_tests(own.join(keep_last(asked, ["at"]).drop("pos"), "at").drop("at"))
    return code_projection(held.where("private_test_cases is not null"))


def with_truth(rows: DataFrame, truth: DataFrame, last: bool = True, key: str = "global_index") -> DataFrame:
    """``rows`` with the columns of ``truth`` (which has ``pos``); of repeated keys the last or the
    first counts. Unmatched rows have nulls."""
    one = (keep_last if last else keep_first)(truth, [key])
    return rows.join(one.drop("pos"), key, "left")


def require_match(rows: DataFrame, table: DataFrame, keys: list[str], what: str = "rows") -> DataFrame:
    """``rows`` joined to ``table``; raises if a row has no match."""
    lost = rows.join(table.select(*keys), keys, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} {what} have no match by {', '.join(keys)}")
    return rows.join(table, keys)


def option_index(answer: Column, options: Column) -> Column:
    """The truth of a cloze row: the answer's place among the options; else the first option with
    the most words in common among those that contain the answer or that it contains, if there are
    any; else the answer itself. As text."""
    low, words = F.lower, lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    score = lambda o: F.when(F.contains(low(o), low(answer)) | F.contains(low(answer), low(o)), F.size(F.array_intersect(words(answer), words(o)))).otherwise(0)
    exact = F.array_position(options, answer)
    scored = F.transform(options, score)
    most = F.array_max(scored)
    near = F.when(most > 0, F.array_position(scored, most))
    place = F.when(exact > 0, exact).otherwise(near) - 1
    return F.coalesce(place.cast("string"), answer)


def by_position(rows: DataFrame, problems: DataFrame) -> DataFrame:
    """Code rows with the problem whose ``_index`` is the number after the key's last ``_``; a key or an
    index that isn't a number matches nothing. An index that two problems have is an error."""
    index = F.substring_index("global_index", "_", -1).try_cast("long")
    own = problems.withColumn("at", F.col("_index").try_cast("long")).where("at is not null")
    twice = own.groupBy("at").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the index {twice[0]['at']} belongs to {twice[0]['count']} problems")
    return rows.withColumn("at", index).join(own, "at", "left").drop("at")


def match_questions(examples: DataFrame, questions: DataFrame) -> DataFrame:
    """``examples`` (prompt, ...) with the global_index of the question that equals the prompt (the
    last of equal questions), else of the first question (by ``pos``) that holds the prompt's first
    100 characters. Different heads without an exact match meet the windows of the different questions by hash."""
    exact = keep_last(questions.select("question", "global_index", "pos"), ["question"]).select(F.col("question").alias("q"), F.col("global_index").alias("by_text"))
    joined = examples.join(exact, F.col("prompt") == F.col("q"), "left").drop("q").withColumn("head", F.left("prompt", F.lit(100)))
    heads = joined.where("by_text is null").select(F.col("head").alias("part"))
    first = keep_first(questions.select("question", "global_index", "pos"), ["question"]).select(F.col("question").alias("text"), F.struct("pos", "global_index").alias("own"))
    met = holders(first.select(F.col("text").alias("text_id"), "text"), heads)
    found = met.join(first, F.col("text_id") == F.col("text")).groupBy(F.col("part").alias("head")).agg(F.min_by("own.global_index", "own.pos").alias("by_head"))
    out = joined.join(found, "head", "left")
    return out.withColumn("global_index", F.coalesce("by_text", "by_head")).drop("by_text", "by_head", "head")


def metrics_of(dataset: Column, configured: Column) -> Column:
    """The metrics of a data set: those configured that are known, else the data set's own, else one
    default."""
    known = F.filter(F.coalesce(configured, F.array().cast("array<string>")), lambda m: m.isin(*METRICS))
    own = F.array(F.lit(DEFAULT_METRIC))
    for name, metrics in DATASET_METRICS.items():
        own = F.when(dataset == name, F.array(*map(F.lit, metrics))).otherwise(own)
    return F.when(F.size(known) > 0, known).otherwise(own)


def with_metrics(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """``rows`` (dataset, ...), one for each metric of its data set. ``configs``: dataset, eval_metrics."""
    alias = F.col("dataset")
    for name, other in CONFIG_ALIASES.items():
        alias = F.when(F.col("dataset") == name, other).otherwise(alias)
    dim = dimension(configs.select(F.col("dataset").alias("c"), "eval_metrics").dropDuplicates(["c"]))
    joined = rows.withColumn("alias", alias).join(dim, F.col("alias") == F.col("c"), "left")
    return joined.withColumn("metric", F.explode(metrics_of(F.col("dataset"), F.col("eval_metrics")))).drop("alias", "c", "eval_metrics")


#: What each metric's score is made of: the extracted answer, the text and the truth. Formulas and programs have branches
#: of their own in :func:`score_rows`.
_NATIVE = {
    "mcq_accuracy": lambda x, text, truth: S.mcq_accuracy_of(x, truth),
    "mcq_exact_match": lambda x, text, truth: S.score_if(x == T.strip(truth)),
    "exact_match": lambda x, text, truth: S.exact_match_of(x, truth),
    "superglue_exact_match": lambda x, text, truth: S.superglue_exact_of(x, truth),
    "superglue_clozetest": lambda x, text, truth: S.cloze(text, truth),
    "chess_accuracy": lambda x, text, truth: S.chess_accuracy(text, truth),
    "meteor_score": lambda x, text, truth: S.meteor_of(x, truth),
}


def score_rows(rows: DataFrame, text: str = "text", truth: str = "truth", answer: str | None = None, tests: str | None = None, is_stdin: str = "is_stdin", allow: bool = False) -> DataFrame:
    """``rows`` (metric, text, truth) with score and error, by each row's metric, in one plan: formulas go to
    the reader and programs to their tests in branches that hold those rows alone, all others are native columns. The
    answer is extracted once for all metrics that share the rule (``answer``: the column that holds it
    already). A row that can't be scored is 0 with the reason: no truth, an unknown metric, a formula that breaks the
    reader, an answer without code or tests. Programs run only with ``allow`` and a column of ``tests``."""
    t, own = F.col(truth), rows if answer else rows.withColumn("extracted", T.answer(F.col(text)))
    metric, x = F.col("metric"), F.col(answer or "extracted")
    score = F.when(t.isNull() | metric.isNull(), 0.0)
    for name, how in _NATIVE.items():
        score = score.when(metric == name, how(x, F.col(text), t))
    code = metric == "code_accuracy"
    error = F.when(metric.isNull() | ~metric.isin(*METRICS), F.concat(F.lit("no metric "), F.coalesce(metric, F.lit("at all"))))
    error = error.when(code, "no tests" if allow else "programs are off").when(t.isNull(), "no truth")
    names = [c for c in own.columns if answer or c != "extracted"]
    programs = metric.eqNullSafe("code_accuracy") if tests and allow else F.lit(False)
    formulas = metric.eqNullSafe("math_metric") & t.isNotNull()
    out = own.where(~programs & ~formulas).select(*names, F.coalesce(score, F.lit(0.0)).alias("score"), error.alias("error"))
    out = out.unionByName(with_math_scores(rows.where(formulas), text, truth))
    return out.unionByName(with_code_scores(rows.where(programs), text, tests, is_stdin, allow=True)) if tests and allow else out


def metric_means(scored: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """Mean and number of scores for each metric; ``weight`` is the column that says how many equal rows a row stands for."""
    if weight:
        n = F.sum(F.when(F.col("score").isNotNull(), F.col(weight)))
        return scored.groupBy(*by, "metric").agg(F.coalesce(n, F.lit(0)).alias("n"), (F.sum(F.col("score") * F.col(weight)) / n).alias("mean"))
    return scored.groupBy(*by, "metric").agg(F.count("score").alias("n"), F.avg("score").alias("mean"))


def batch_stats(runs: DataFrame) -> DataFrame:
    """Runs by status (success, failed, timeout, exception) and the mean duration of successes."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return runs.agg(*[n(s) for s in ("success", "failed", "timeout", "exception")], F.avg(F.when(F.col("status") == "success", F.col("duration"))).alias("mean_duration"))


def has_answers(truth: DataFrame, order: str, rows: int = 100) -> bool:
    """Whether one of the first ``rows`` answers isn't blank: a split without any is not for scoring."""
    head = truth.orderBy(order).limit(rows)
    return not head.where(F.coalesce(T.strip(F.col("answer").cast("string")), F.lit("")) != "").isEmpty()


def require_rows(rows: DataFrame, column: str) -> DataFrame:
    """``rows``; raises if no row has ``column``."""
    if rows.where(F.col(column).isNotNull()).isEmpty():
        raise ValueError(f"no row has {column}")
    return rows


def preview(errors: DataFrame, order: list[str], rows: int = 10) -> tuple[DataFrame, int]:
    """The first ``rows`` errors, and how many more there are."""
    return errors.orderBy(*order).limit(rows), max(0, errors.count() - rows)


def availability(models: DataFrame, cached: DataFrame) -> DataFrame:
    """(model, available): whether the result cache has the model."""
    there = cached.select("model").distinct().withColumn("there", F.lit(True))
    return models.select("model").distinct().join(there, "model", "left").select("model", F.col("there").isNotNull().alias("available"))


def by_router(routers: DataFrame, configs: DataFrame) -> DataFrame:
    """Routers with their configuration: by the part of the name before the first ``_``."""
    dim = dimension(configs.withColumnRenamed("router_name", "base"))
    return routers.withColumn("base", F.substring_index("router", "_", 1)).join(dim, "base", "left")


def result_entry(rows: DataFrame, model: str = "model") -> DataFrame:
    """Inference results (global_index, question, model, response, token_usage, success, provider,
    error) as cache entries; a success has no error."""
    ok = F.coalesce("success", F.lit(False))
    return rows.select(
        "global_index",
        "question",
        F.col(model).alias("llm_selected"),
        F.coalesce("response", F.lit("")).alias("generated_answer"),
        "token_usage",
        ok.alias("success"),
        F.coalesce("provider", F.lit("unknown")).alias("provider"),
        F.when(~ok, F.col("error")).alias("error"),
    )


def generate(rows: DataFrame, choose, models: DataFrame) -> DataFrame:
    """Prediction rows of a router: ``choose`` gives the model's name from the columns of a row. Raises
    if a name is not among the configured models."""
    out = complete(rows).withColumn("prediction", choose)
    unknown = out.select("prediction").distinct().join(models.select(F.col("model").alias("prediction")), "prediction", "left_anti")
    names = [r[0] for r in unknown.limit(10).collect()]
    if names:
        raise ValueError(f"models that the configuration lacks: {names}")
    return out.select("global_index", "prompt", "prediction", F.lit(None).cast("string").alias("generated_result"), F.lit(None).cast("double").alias("cost"), F.lit(None).cast("double").alias("accuracy"))
