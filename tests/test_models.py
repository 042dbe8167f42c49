"""Fan-out over models, saved progress, containment, formulas, subsequences, words, tests and programs: against
brute force, faults and limits."""

import itertools
import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkroost import fanout, session
from sparkroost.functions import code_run, scores, segment, symbolic
from sparkroost.operators import containment, costs
from sparkroost.operators import evaluate as E
from sparkroost.sources import answer_log, readers


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    session.ship(spark)


# --- many models -------------------------------------------------------------------------------------------------


def test_a_hung_model_times_out_and_the_others_finish(spark, tmp_path):
    folder = f"file://{tmp_path}/out"

    def work(model):
        if model == "stuck in Spark":
            return spark.range(1).select(F.udf(lambda x: time.sleep(600) or x, "long")("id").alias("n"))
        if model == "stuck outside":
            time.sleep(18)
        if model == "raises":
            raise RuntimeError("no such model")
        if model == "breaks":
            return spark.range(1).select(F.raise_error(F.lit("broken row")).cast("long").alias("n"))
        return spark.range(len(model)).agg(F.count(F.lit(1)).alias("n"))

    spark.range(5).agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}.warm")  # the limit is not for the session's start
    models = ["stuck in Spark", "first", "raises", "stuck outside", "breaks", "second"]
    began = time.monotonic()
    rows = fanout.fan_out(spark, models, work, folder, seconds=12).collect()
    assert time.monotonic() - began < 60
    assert [(r.model, r.status) for r in rows] == [("stuck in Spark", "timeout"), ("first", "success"), ("raises", "exception"), ("stuck outside", "timeout"), ("breaks", "failed"), ("second", "success")]
    assert rows[2].error == "no such model" and "broken row" in rows[4].error and rows[0].duration < 18
    time.sleep(8)  # the one outside of Spark comes back too late, and leaves no result
    found = {r.model: r.n for r in fanout.results(spark, folder, "n long").collect()}
    assert found == {"first": 5, "second": 6}
    assert not [x for x in spark.sparkContext.statusTracker().getActiveJobsIds()]
    with pytest.raises(ValueError):
        fanout.fan_out(spark, ["a", "a"], work, folder)


def _asker(path, dies_at=None, fails=()):
    def ask(model, prompt):
        with open(path, "a") as f:
            f.write(f"{model}|{prompt}\n")
        if dies_at is not None:
            with open(path) as f:
                if sum(1 for _ in f) == dies_at:
                    raise SystemExit("the task is lost")
        if prompt in fails:
            return {"success": False, "error": "down"}
        return {"response": prompt.upper(), "success": True, "token_usage": {"input_tokens": 3}}

    return ask


def test_a_lost_task_asks_no_saved_question_again(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/log", tmp_path / "calls"
    calls.touch()
    rows = spark.createDataFrame([(f"q{i}", "m", f"p{i}") for i in range(60)] + [(None, "m", "no key"), ("q1", "m", "p1")], "global_index string, model string, prompt string")
    run = lambda client, run_id, **how: answer_log.run_inference(rows, {"x": client}, {"m": "x"}, folder, run_id, shards=2, every=5, attempts=1, **how)
    with pytest.raises(Exception):
        run(_asker(str(calls), dies_at=37, fails=("p3",)), "one")
    first = calls.read_text().splitlines()
    entries, counts = run(_asker(str(calls), fails=("p3",)), "one")
    every = calls.read_text().splitlines()
    total = counts.agg(F.sum("asked"), F.sum("reused"), F.sum("failed")).first()
    assert total[0] + total[1] == 61 and len(every) == len(first) + total[0]
    again = len(every) - len(set(every))
    assert again <= 2 * 5  # at most what each shard had not saved yet
    assert len(set(every)) == 60
    got = {r.global_index: (r.response, r.success) for r in entries.collect()}
    assert len(got) == 60 and got["q3"] == ("", False) and got["q7"] == ("P7", True)
    # a later run: successes are reused, the failure is asked again
    entries, counts = run(_asker(str(calls)), "two")
    assert counts.agg(F.sum("asked"), F.sum("reused")).first()[:] == (1, 60)
    assert {r.global_index: r.run_id for r in entries.collect()}["q3"] == "two"
    assert all(r.success for r in entries.collect())


def test_the_rate_of_a_task_is_bounded(spark, tmp_path):
    rows = spark.createDataFrame([(f"q{i}", "m", "p") for i in range(6)], "global_index string, model string, prompt string")
    began = time.monotonic()
    answer_log.run_inference(rows, {"x": _asker(str(tmp_path / "calls"))}, {"m": "x"}, f"file://{tmp_path}/log", "one", shards=1, per_second=5)
    assert time.monotonic() - began >= 1.0


def test_models_infer_all_questions(spark, tmp_path):
    questions = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", ""), (None, "x")], "global_index string, prompt string")
    told = fanout.infer_models(spark, questions, ["m", "n", "o"], {"x": _asker(str(tmp_path / "calls"))}, {"m": "x", "n": "x"}, f"file://{tmp_path}/log", f"file://{tmp_path}/out", "run", shards=2)
    assert [(r.model, r.status) for r in told.collect()] == [("m", "success"), ("n", "success"), ("o", "failed")]
    assert fanout.results(spark, f"file://{tmp_path}/out", "global_index string, response string").count() == 4


# --- containment -------------------------------------------------------------------------------------------------


def test_containment_equals_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab日😀 ", k=rng.randint(0, 30))) for _ in range(120)] + [None, ""]
    parts = ["".join(rng.choices("ab日😀 ", k=rng.randint(0, 5))) for _ in range(60)] + [None, ""]
    found = containment.holders(spark.createDataFrame(list(enumerate(texts)), "text_id long, text string"), spark.createDataFrame([(p,) for p in parts], "part string"))
    assert sorted(map(tuple, found.collect())) == sorted({(i, p) for i, t in enumerate(texts) for p in parts if t is not None and p is not None and p in t})
    empty = containment.holders(spark.createDataFrame([], "text_id long, text string"), spark.createDataFrame([], "part string"))
    assert empty.collect() == []


def test_question_match_has_no_nested_loop(spark):
    questions = spark.range(3000).select(F.concat(F.repeat(F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" ")), 20), F.lit("?")).alias("question"), F.col("id").alias("global_index"), F.col("id").alias("pos"))
    examples = questions.select(F.when(F.col("pos") % 2 == 0, F.col("question")).otherwise(F.substring("question", 5, 130)).alias("prompt"), F.col("pos").alias("want"))
    out = E.match_questions(examples, questions)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.where("not global_index <=> want").count() == 0
    priced = costs.with_prices(spark.createDataFrame([("alder-large",), ("alder",), ("al",), ("zz",), (None,)], "model string"), spark.createDataFrame([(0, "alder", 1.0, 2.0), (1, "alder-large", 3.0, 4.0)], "pos int, model string, in_price double, out_price double"))
    assert "NestedLoop" not in priced._jdf.queryExecution().toString()
    assert {r.model: r.in_price for r in priced.collect()} == {"alder-large": 3.0, "alder": 1.0, "al": 1.0, "zz": None, None: None}


# --- formulas ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("|x|", "x", False), ("|x+90|", "x+90", False), (r"\sqrt{(x+3)^2}", "x+3", False), (r"\sqrt{x^2}", "x", False), (r"\sqrt{x^2}", "|x|", False), ("x", "x+0.000000000001", False), (r"\sqrt{x}+0.000000000001", r"\sqrt{x}", False),
        ("x+1", "1+x", True), ("(x-1)(x+1)", "x^2-1", True), (r"\sin^2 x+\cos^2 x", "1", True), (r"(\sqrt{x})^2", "x", True), (r"\sqrt{x}\sqrt{y}", r"\sqrt{xy}", False),
        ("i^2 x", "-x", True), (r"\cosh^2 x-\sinh^2 x", "1", True), (r"\sqrt{x+1}-\sqrt{x}", r"\frac{1}{\sqrt{x+1}+\sqrt{x}}", True), (r"\frac{x^2-1}{x-1}", "x+1", True), (r"\sqrt{8}x", r"2\sqrt{2}x", True), ("2^{x+1}", "2*2^x", True), ("-x^2", "x^2", False), (r"\exp(x)", "e^x", True),
        ("x/0", "x", False), ("0.5x", "x/2", True), ("0.333x", "x/3", False), (r"\ln(x y)", r"\ln x+\ln y", False), (r"\pi", "3.1416", True), ("2x=6", "6-2x=0", True), ("x=3", "y=3", False), ("(-x)^3", "-x^3", True), ("x^{2^3}", "x^8", True),
    ],
)
def test_identities(a, b, same):
    assert symbolic.equal(a, b) == same == symbolic.equal(b, a)


def test_expanded_polynomials_are_identical_and_a_changed_one_is_not():
    rng = random.Random(8)
    for _ in range(60):
        roots = [rng.randint(-9, 9) for _ in range(rng.randint(1, 5))]
        product = "".join(f"(x-({r}))" for r in roots)
        coefficients = [1]
        for r in roots:
            coefficients = [p - r * q for p, q in zip([*coefficients, 0], [0, *coefficients], strict=True)]
        terms = lambda own: "+".join(f"({c})x^{len(own) - 1 - i}" for i, c in enumerate(own))
        assert symbolic.equal(product, terms(coefficients))
        k = rng.randrange(len(coefficients))
        assert not symbolic.equal(product, terms([c + (i == k) for i, c in enumerate(coefficients)]))


def test_one_dispatch_scores_all_nine_metrics(spark):
    schema = "id int, metric string, text string, truth string, is_stdin boolean, tests array<struct<input:string,output:string>>"
    code = "```python\nprint(int(input()) + 1)\n```"
    rows = [
        (1, "mcq_accuracy", r"\boxed{B}", "1", None, None), (2, "mcq_exact_match", r"\boxed{B}", "B", None, None), (3, "exact_match", r"\boxed{A b}", "a_B", None, None),
        (4, "math_metric", r"\boxed{x+1}", "1+x", None, None), (5, "math_metric", r"\boxed{\frac{1}{2}}", "0.5", None, None), (6, "meteor_score", r"\boxed{one}", "one", None, None),
        (7, "chess_accuracy", "move e2e4", "e2e4", None, None), (8, "superglue_exact_match", r"\boxed{A}", "Yes", None, None), (9, "superglue_clozetest", r"\boxed{C}", "2", None, None),
        (10, "code_accuracy", code, "", True, [("4", "5"), ("5", "6")]), (11, "code_accuracy", code, "", True, [("4", "5"), ("5", "7")]), (12, "code_accuracy", "none", None, True, [("4", "5")]),
        (13, "code_accuracy", code, "", True, None), (14, "no_such", "x", "x", None, None), (15, "math_metric", "x", None, None, None), (16, None, "x", "x", None, None), (17, "math_metric", None, "x", None, None),
    ]
    table = spark.createDataFrame(rows, schema)
    got = {r.id: (r.score, r.error) for r in E.score_rows(table, tests="tests", allow=True).collect()}
    assert len(got) == len(rows)
    assert {i for i, (s, _) in got.items() if s == 1.0} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10}
    assert {i: e for i, (_, e) in got.items() if e} == {12: "no code", 13: "no tests", 14: "no metric no_such", 15: "no truth", 16: "no metric at all"}
    off = {r.id: (r.score, r.error) for r in E.score_rows(table).collect()}
    assert off[10] == (0.0, "programs are off") and off[4] == (1.0, None)
    assert set(E.score_rows(table, tests="tests", allow=True).columns) == {*table.columns, "score", "error"}


# --- subsequences and words --------------------------------------------------------------------------------------


def table_of_lengths(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_subsequences_of_one_and_many_words(spark):
    rng = random.Random(3)
    sizes = [0, 1, 5, 61, 62, 63, 64, 123, 124, 125, 130, 250]
    rows = []
    for i in range(160):
        kinds = rng.choice([2, 5, 40])
        rows.append((i, *([f"w{rng.randint(0, kinds)}" for _ in range(rng.choice(sizes))] for _ in range(2))))
    rows.append((999, None, ["a"]))
    got = dict(spark.createDataFrame(rows, "i int, a array<string>, b array<string>").select("i", scores.common(F.col("a"), F.col("b"))).collect())
    assert got == {i: table_of_lengths(a or [], b or []) for i, a, b in rows}


def test_the_best_path_is_the_best_of_all(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("山水火木土", weights=[5, 4, 3, 2, 1], k=rng.randint(1, 9))) for _ in range(200)]
    corpus = spark.createDataFrame([(t,) for t in texts] + [(None,), ("no ideographs",)], "text string")
    held = {r.word: (r.n, r.weight) for r in segment.dictionary(corpus, longest=3).collect()}
    letters = sum(map(len, texts))
    grams = [t[i : i + k] for t in texts for k in (1, 2, 3) for i in range(len(t) - k + 1)]
    assert {w: n for w, (n, _) in held.items()} == {w: grams.count(w) for w in set(grams) if len(w) == 1 or grams.count(w) >= 2}
    assert all(w == round(math.log(n / letters) * 1e6) for n, w in held.values())
    own = segment.trie([(w, x[1]) for w, x in held.items()])

    def cuts(t):
        for mask in itertools.product((0, 1), repeat=len(t) - 1):
            at = [0, *(i + 1 for i, m in enumerate(mask) if m), len(t)]
            yield [t[a:b] for a, b in itertools.pairwise(at)]

    for t in set(texts):
        best = max(((sum(held[w][1] for w in c), [len(w) for w in c], c) for c in cuts(t) if all(w in held for w in c)))
        assert segment.best_path(t, own, -(10**8)) == best[2]
    rows = spark.createDataFrame([(1, "山水abc 12火"), (2, None), (3, ""), (4, "龍山")], "id int, text string")
    out = {r.id: r.words for r in segment.segmented(rows, segment.dictionary(corpus, longest=3)).collect()}
    assert out[2] is None and out[3] == [] and "".join(out[1]) == "山水abc12火" and out[4] == ["龍", "山"] and {"abc", "12"} <= set(out[1])


# --- tests and programs ------------------------------------------------------------------------------------------


def test_functional_tests_of_all_forms(spark):
    one, two = '{"input": "1", "output": "2"}', '{"input": "a = 3", "output": [1, {"b": "}"}]}'
    texts = [f"[{one}, {two}]", f"```json\n{one}{two}\n```", f"{one}\n{two}", f"{one},\n\n{two}", f'{one}\n{{"input": "x\n{two}', "", None, "words", "[1]", '{"input": "1"}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {}
    for r in code_run.test_cases(rows).orderBy("i", "at").collect():
        got.setdefault(r.i, []).append((r.input, r.output) if r.error is None else r.error)
    both = [("1", "2"), ("a = 3", json.dumps([1, {"b": "}"}]))]
    assert [got.get(i) for i in range(4)] == [both] * 4
    assert got[4][0] == both[0] and got[4][-1] == both[1] and any(isinstance(x, str) and x.startswith("at ") for x in got[4])
    assert 5 not in got and 6 not in got and got[8] == ["no input and output"] and got[9] == ["no input and output"] and got[7][0].startswith("at 0")


def test_a_stalled_test_fails_alone_and_in_time():
    code = "n = int(input())\nwhile n == 3: pass\nprint(n)"
    tests = [{"input": str(n), "output": str(n)} for n in (1, 2, 3, 4)]
    began = time.monotonic()
    assert code_run.run_tests(code, tests, True, allow=True, seconds=1) == [True, True, False, False]
    assert time.monotonic() - began < (1 + 1) * 4 + 5
    # a program that stops its own runner is over at the deadline, with what was sent before
    stops = "import os, signal\nn = int(input())\nif n == 2: os.kill(os.getppid(), signal.SIGSTOP)\nprint(n)"
    began = time.monotonic()
    assert code_run.run_tests(stops, tests[:3], True, allow=True, seconds=1) == [True, False, False]
    assert time.monotonic() - began < 20


def test_programs_read_and_leave_as_they_like():
    t = [{"input": "5\n7", "output": "12"}]
    for code in ("import sys\nprint(sum(map(int, sys.stdin.buffer.read().split())))", "print(sum(int(x) for x in open(0)))", "import sys\nprint(int(input()) + int(input()))\nsys.exit()", "if __name__ == '__main__':\n    print(12)"):
        assert code_run.run_stdin_tests(code, t, allow=True)
    for code in ("raise ValueError", "import sys\nprint(12)\nsys.exit(3)", "print(13)", "import os\nos._exit(1)", "x = [0] * 10**10\nprint(12)", "def broken("):
        assert not code_run.run_stdin_tests(code, t, allow=True, seconds=3)
    assert code_run.run_function_tests("def add(a, b):\n    print('noise')\n    return a + b", [{"input": "1\n2", "output": "3"}], allow=True)
    assert not code_run.run_function_tests("def add(a, b):\n    return a - b", [{"input": "1\n2", "output": "3"}], allow=True)
    assert not code_run.run_stdin_tests("print(1)", [], allow=True)


# --- files -------------------------------------------------------------------------------------------------------


def test_predictions_are_one_array_in_order(spark, tmp_path):
    folder = f"file://{tmp_path}/p"
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "small").otherwise("large one").alias("router"), (5000 - F.col("id")).alias("pos"), F.concat(F.lit("q\n"), F.col("id").cast("string")).alias("global index"), F.lit("m").alias("prediction"))
    readers.write_predictions(rows.repartition(7), folder)
    files = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.json"))
    assert len(files) == 2 and all(f.endswith("predictions.json") for f in files)
    for p in tmp_path.rglob("predictions.json"):
        held = json.loads(p.read_text())
        index = [int(r["global index"].split("\n")[1]) for r in held]
        assert index == sorted(index, reverse=True) and len(index) == (500 if "small" in str(p) else 4500)
    readers.write_predictions(rows.where("pos < 100"), folder)  # a second write takes the place of the first
    assert readers.predictions(spark, folder).count() == 99
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["p"]


def test_scratch_is_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    held = {}
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: held.get(key, default)), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="app"))
    with pytest.raises(ValueError, match="checkpoint"):
        session.scratch(cluster, "x")
    held["spark.checkpoint.dir"] = "hdfs://store/shared/"
    assert session.scratch(cluster, "x") == "hdfs://store/shared/sparkroost-app/x"


def test_repeated_formulas_are_read_once(spark):
    """The reader gets each different pair once; every row has its score."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    pairs = [(r"\boxed{x+1}", "1+x", 1.0), (r"\boxed{x+1}", "2+x", 0.0), (None, "x", 0.0), (r"\boxed{7}", None, 0.0)]
    rows = spark.createDataFrame([(i, *pairs[i % 4]) for i in range(400)], "id int, text string, truth string, want double")
    once = symbolic.each_once
    try:
        symbolic.each_once = lambda values: once(values).mapInArrow(counted, values.schema)
        got = symbolic.with_math_scores(rows).collect()
    finally:
        symbolic.each_once = once
    assert len(got) == 400 and all(r.score == r.want for r in got) and read.value == 4


def test_equal_rows_weigh_what_they_are(spark):
    rows = [("a", "m", 1.0, 3), ("a", "m", 0.0, 1), ("b", "m", 0.5, 2), ("b", "m", None, 5)]
    scored = spark.createDataFrame(rows, "k string, metric string, score double, rows long")
    assert sorted(tuple(r) for r in E.metric_means(scored, "k", weight="rows").collect()) == [("a", "m", 4, 0.75), ("b", "m", 2, 0.5)]


def test_equal_programs_run_once(spark, tmp_path):
    """Each different program with its tests is one process, whatever the number of its rows."""
    code = f"```python\nopen({str(tmp_path / 'runs')!r}, 'a').write('x')\nprint(input())\n```"
    rows = [(i, code, True, [{"input": "1", "output": "1"}]) for i in range(12)]
    table = spark.createDataFrame(rows, "id int, text string, is_stdin boolean, tests array<struct<input:string,output:string>>")
    got = E.with_code_scores(table, allow=True).select("id", "score").collect()
    assert sorted(tuple(r) for r in got) == [(i, 1.0) for i in range(12)] and (tmp_path / "runs").read_text() == "x"
