"""Evaluation operators, code runs, inference surface, sources and sinks on hand-made cases."""

import base64
import json
import pickle
import zlib

import pytest
from pyspark.sql import functions as F

from sparkroost.functions import code_run, prompts
from sparkroost.functions import scores as S
from sparkroost.operators import costs, evaluate, keyed, validate
from sparkroost.sources import inference, readers


def one(spark, column, **values):
    return spark.range(1).select(column(*[F.lit(v) for v in values.values()]).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "code"),
    [
        ("null", "null_result"),
        ("[1]", "not_object"),
        ('{"generated_answer":"x","success":true}', "missing_field"),
        ('{"generated_answer":null,"success":true,"token_usage":{}}', "answer_not_text"),
        ('{"generated_answer":" ","success":"yes","token_usage":{}}', "success_without_answer"),
        ('{"generated_answer":" ","success":[],"token_usage":null}', "success_not_boolean"),
        ('{"generated_answer":"","success":false,"token_usage":{}}', None),
        ('{"generated_answer":"x","success":1,"token_usage":{}}', "success_not_boolean"),
    ],
)
def test_payload_ladder(spark, raw, code):
    assert one(spark, validate.payload_error, raw=raw) == code


@pytest.mark.parametrize(
    ("answer", "truth", "equal"),
    [
        ("I pick B, surely", "b", False),
        ("I pick B, surely", "B", True),
        ("x[1]", "x1", False),
        ("[x]", "x", True),
        ("(1, 2)", "(1,2.00001)", True),
        ("(1, 2)", "(1, 3)", False),
        ("50", "0.5", True),
        ("3", "4", False),
        ("1,000", "1000", True),
        ("\\frac{1}{2}", "\\frac12", True),
        (None, "1", False),
    ],
)
def test_math_equality(spark, answer, truth, equal):
    assert spark.range(1).select(S.math_equal(F.lit(answer).cast("string"), F.lit(truth)).alias("x")).first().x is equal


def test_cloze_takes_the_first_character(spark):
    assert one(spark, S.cloze, text="b) that one", truth="1") == 1.0
    assert one(spark, S.cloze, text="\\boxed{C} b", truth="2") == 1.0
    assert one(spark, S.cloze, text="", truth="0") == 0.0


def test_option_index(spark):
    options = ["red bolt", "the red ring of steel", "ring"]
    for answer, want in (("ring", "2"), ("red ring of steel", "1"), ("nothing", "nothing"), ("RED BOLT", "0")):
        assert one(spark, lambda a, *o: evaluate.option_index(a, F.array(*o)), a=answer, b=options[0], c=options[1], d=options[2]) == want


def test_repeated_dimension_rows_do_not_multiply(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, model string")
    prices = spark.createDataFrame([(0, "a", 1.0, 1.0), (1, "a", 2.0, 2.0), (2, "bb", 3.0, 3.0)], "pos int, model string, in_price double, out_price double")
    assert sorted((r.id, r.in_price) for r in costs.with_prices(rows, prices).collect()) == [(1, 2.0), (2, 3.0)]
    registry, aliases = spark.createDataFrame([("a",)], "model string"), spark.createDataFrame([("b", "a"), ("b", "a")], "alias string, model string")
    assert costs.canonical(rows, registry, aliases).count() == 2
    data = spark.createDataFrame([("k", None), ("k", None)], "global_index string, prompt string")
    own = spark.createDataFrame([(0, "k", "p", "b")], "pos int, global_index string, prompt string, prediction string")
    assert [r.code for r in validate.row_errors(own, data, registry, aliases).collect()] == ["prompt_mismatch"]


def test_gates_and_matches(spark):
    rows = spark.createDataFrame([("k1", "p", "a", True, True), ("", "p", "a", True, True), ("k2", None, None, True, True), ("k3", "p", "a", False, None), ("k4", "p", "a", True, None), ("k5", "p", "z", True, True)], "global_index string, prompt string, prediction string, has_result boolean, success boolean")
    registry, aliases = spark.createDataFrame([("a",)], "model string"), spark.createDataFrame([], "alias string, model string")
    got = {r.global_index: r.reason for r in evaluate.evaluable(rows, registry, aliases).collect()}
    assert got == {"k1": None, "": "missing_key", "k2": "missing_model", "k3": "no_result", "k4": "unsuccessful", "k5": "unknown_model"}
    truth = spark.createDataFrame([("k1", "x", 0), ("k1", "y", 1)], "global_index string, answer string, pos int")
    for last, want in ((True, "y"), (False, "x")):
        assert {r.answer for r in evaluate.with_truth(rows.where("global_index = 'k1'"), truth, last).collect()} == {want}
    with pytest.raises(ValueError, match="no match"):
        evaluate.require_match(rows, truth, ["global_index"])
    with pytest.raises(ValueError, match="no row"):
        evaluate.require_rows(rows.limit(0), "prompt")
    with pytest.raises(ValueError, match="lacks"):
        evaluate.generate(rows, F.lit("q"), registry)
    answers = spark.createDataFrame([(i, " " if i < 100 else "x") for i in range(101)], "global_index int, answer string")
    assert not evaluate.has_answers(answers, "global_index") and evaluate.has_answers(answers.where("global_index > 0"), "global_index")
    assert evaluate.preview(answers, ["global_index"])[1] == 91


def test_metrics_fall_back(spark):
    rows = spark.createDataFrame([("MATH",), ("x",), ("GeoGraphyData_100k",), (None,)], "dataset string")
    configs = spark.createDataFrame([("MATH", ["no_such"]), ("GeoGraphyData", ["exact_match", "no_such"])], "dataset string, eval_metrics array<string>")
    got = {(r.dataset, r.metric) for r in evaluate.with_metrics(rows, configs).collect()}
    assert got == {("MATH", "math_metric"), ("x", "mcq_accuracy"), ("GeoGraphyData_100k", "exact_match"), (None, "mcq_accuracy")}


def test_overlap_by_count(spark):
    rows = spark.createDataFrame([(1, ["a", "x", "a", "x", "a"], ["a", "y", "a", "y", "a"]), (2, [], ["a"]), (3, ["b"], ["c"]), (4, [], [])], "id int, a array<string>, b array<string>")
    got = {r.id: (round(r.f1, 6), round(r.meteor, 6)) for r in S.overlap_by_count(rows, "id", "a", "b").collect()}
    assert got == {1: (0.6, -2.1), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (0.0, 0.0)}


def test_code_runs(spark):
    assert code_run.call_arguments('a = 1, b = "x"') == [1, "x"]
    assert code_run.call_arguments('[1, 2]\n"s"\n2.5') == [[1, 2], "s", 2.5]
    text = lambda code: f"so\n```python\n{code}\n```\nend"
    rows = [
        (1, text("def add(a, b):\n    return a + b"), False, [("a = 1, b = 2", "3"), ("2\n3", "5")]),
        (2, text("def add(a, b):\n    return a - b"), False, [("1\n2", "3")]),
        (3, text("print(int(input()) * 2)"), True, [("4\n", "8")]),
        (4, "no code", True, [("4\n", "8")]),
        (5, text("while True: pass"), True, [("", "")]),
        (6, text("def f(x):\n    print('noise')\n    return x"), False, []),
    ]
    table = spark.createDataFrame(rows, "id int, text string, is_stdin boolean, tests array<struct<input:string,output:string>>")
    with pytest.raises(PermissionError):
        code_run.code_accuracy(table)
    assert {r.id: r.score for r in code_run.code_accuracy(table, allow=True, seconds=2).collect()} == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 0.0, 6: 0.0}
    got = spark.range(1).select(code_run.stdin_tests(F.lit("Input: 1 Output: 2 Input: 3 Output: 4 Output: 5")).alias("x")).first().x
    assert [(t.input, t.output, t.testtype) for t in got] == [("1\n", "2\n", "stdin")]


def test_private_tests_admit_text_alone(spark):
    pack = lambda x: base64.b64encode(zlib.compress(pickle.dumps(x))).decode()
    rows = [(1, pack('[{"input": "1"}]')), (2, pack(print)), (3, "?"), (4, None), (5, pack("no json"))]
    table = spark.createDataFrame(rows, "id int, private_test_cases string")
    got = {r.id: r.private_test_cases for r in code_run.with_private_tests(table).collect()}
    assert got == {1: '[{"input": "1"}]', 2: None, 3: None, 4: None, 5: None}


def test_inference_surface(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return {"response": "ok", "success": True}

    slept = []
    assert inference.with_retry(flaky, sleep=slept.append)["response"] == "ok" and slept == [1.0, 2.0]
    rows = spark.createDataFrame([("k1", "alder-7b", "hi"), ("k2", "fir", "ho")], "global_index string, model string, prompt string")
    clients = {"here": lambda model, prompt: {"response": prompt.upper(), "success": True, "token_usage": {"input_tokens": 2}}}
    got = {r.global_index: (r.response, r.success, r.provider, r.input_tokens) for r in inference.infer(rows, clients, {"alder-7b": "here", "fir": "there"}).collect()}
    assert got == {"k1": ("HI", True, "here", 2), "k2": ("", False, "there", 0)}
    with pytest.raises(ValueError, match="elm"):
        inference.provider_of("elm", {"alder-7b": "here"})


def test_text_helpers(spark):
    assert one(spark, S.code_similarity, a="# no\nabc", b="abd") == 0.67
    assert one(spark, prompts.file_name, a="a/b\\c:d e") == "a_b_c:d e"
    assert spark.range(1).select(prompts.file_name(F.lit("a/b\\c:d e"), log=True).alias("x")).first().x == "a_b_c_d_e"
    assert one(spark, prompts.dialogue, a="why?").endswith("User: why?\n\n                Assistant:")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "router_data_10.json").write_text(json.dumps([{"global index": "k", "prompt_formatted": "p"}]))
    assert [tuple(r) for r in readers.dataset(spark, str(tmp_path), "sub_10").collect()] == [("k", "p")]
    with pytest.raises(ValueError, match="no split"):
        readers.dataset(spark, str(tmp_path), "other")
    configs = tmp_path / "configs"
    configs.mkdir()
    (configs / "a.json").write_text(json.dumps({"eval_params": {"dataset": "AIME", "eval_metrics": ["math_metric"], "prompt": "{Question}"}}, indent=1))
    assert [(r.dataset, r.eval_metrics) for r in readers.eval_configs(spark, str(configs)).collect()] == [("AIME", ["math_metric"])]
    spark.createDataFrame([("k", " ")], "`Global Index` string, Answer string").write.parquet(str(tmp_path / "truth"))
    assert readers.ground_truth(spark, str(tmp_path / "truth"), "sub_10").columns == ["global_index", "answer"]
    with pytest.raises(ValueError, match="no ground truth"):
        readers.ground_truth(spark, str(tmp_path / "truth"), "full")
    (tmp_path / "router.json").write_text('{"pipeline_params": {"router_name": "r"}}')
    with pytest.raises(ValueError, match="models"):
        readers.check_router_config(spark, str(tmp_path / "router.json"))
    where = str(tmp_path / "table")
    spark.range(3).write.json(where)
    readers.replace_table(spark.read.schema("id long").json(where).where("id > 0"), where)
    assert spark.read.json(where).count() == 2
    for n, run in ((1, "a"), (2, "b"), (3, "b")):
        readers.write_summary(spark.range(n).withColumn("a", F.lit(1)), str(tmp_path / "runs"), run)
    assert {r.run_id: r["count"] for r in spark.read.json(str(tmp_path / "runs")).groupBy("run_id").count().collect()} == {"a": 1, "b": 3}
    assert readers.write_scores(spark.range(2), f"{tmp_path}/x.jsonl") == f"{tmp_path}/x.scores"
    (tmp_path / "list.json").write_text('[{"global_index": "k"}, {"global_index": "j"}]')
    readers.to_json_lines(spark, str(tmp_path / "list.json"), str(tmp_path / "lines"))
    assert readers.json_lines(spark, str(tmp_path / "lines")).count() == 2
    readers.write_cube(spark.createDataFrame([("m", "k", 1.0)], "model string, global_index string, accuracy double"), str(tmp_path / "cube"))
    assert (tmp_path / "cube" / "model=m").is_dir()
    assert readers.write_splits({"full": readers.dataset(spark, str(tmp_path), "sub_10")}, str(tmp_path / "out")) == []


def test_models_and_indexes_that_must_be_there(spark):
    cube = spark.createDataFrame([("a", "1", 1.0, 2.0)], "model string, global_index string, accuracy double, cost double")
    choices = lambda *m: spark.createDataFrame([(x, k) for x in m for k in ("1", "2")], "model string, global_index string")
    assert sorted((r.global_index, r.accuracy, r.missing) for r in keyed.against_cube(choices("a"), cube).collect()) == [("1", 1.0, False), ("2", 0.0, True)]
    with pytest.raises(ValueError, match="lacks"):
        keyed.against_cube(choices("a", "b"), cube)
    rows = spark.createDataFrame([("x_1",), ("x_no",), (None,)], "global_index string")
    one = spark.createDataFrame([("1", "t1"), ("no", "t2")], "_index string, task string")
    assert {r.global_index: r.task for r in evaluate.by_position(rows, one).collect()} == {"x_1": "t1", "x_no": None, None: None}
    with pytest.raises(ValueError, match="belongs to 2"):
        evaluate.by_position(rows, one.union(one))
    registry, aliases = spark.createDataFrame([("a",)], "model string"), spark.createDataFrame([("z", "a")], "alias string, model string")
    assert [r.all_confidence for r in evaluate.sure(spark.createDataFrame([("z",)], "prediction string"), registry, aliases).collect()] == [{"a": 1.0}]
    with pytest.raises(ValueError):
        evaluate.sure(spark.createDataFrame([("q",)], "prediction string"), registry, aliases)


def test_pending_keys_are_never_null_or_done_twice(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 1)], "model string, k int")
    done = spark.createDataFrame([("a", 1), ("a", 1), (None, 3)], "model string, k int")
    assert sorted(map(str, keyed.pending(rows, done, ["model", "k"]).collect())) == sorted(map(str, rows.where("not (model <=> 'a' and k = 1)").collect()))
    half = spark.createDataFrame([(1, None, 1.0), (2, 0.5, None), (3, 0.5, 1.0)], "i int, accuracy double, cost double")
    assert sorted(r.i for r in evaluate.unscored(half).collect()) == [1, 2]


def test_availability_reads_the_whole_cache(spark):
    """A short name counts like any other."""
    from sparkroost.plans import evaluation
    from sparkroost.plans.views import view

    data = "/root/testdata/sf0.001"
    want = {r.model for r in view(spark, data, "cache").where("score > 0").select("model").distinct().collect()}
    got = {r.model for r in evaluation.model_availability(spark, data).where("available").collect()}
    assert "alder" in want and got == want


def test_overlap_shuffles_no_words(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"], ["a", "c"]), (2, None, ["x"]), (3, [], []), (1, ["q"], ["q"])], "id int, a array<string>, b array<string>")
    scored = S.overlap_by_count(rows, "id", "a", "b")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = sorted((r.id, round(r.f1, 6), round(r.meteor, 6)) for r in scored.collect())
    assert got == [(1, 0.4, 0.4), (1, 1.0, 1.0), (2, 0.0, 0.0), (3, 0.0, 0.0)]
