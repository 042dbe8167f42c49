"""Hand-computed cases, one for each trap."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkroost.functions import code_run, prompts, scores, symbolic, text
from sparkroost.operators import costs, keyed
from sparkroost.plans.answers import QUERIES, boxed_text
from tests.conftest import DATA


def value(spark, f, *args):
    names = [f"c{i}" for i in range(len(args))]
    frame = spark.createDataFrame([args], ", ".join(f"{n} {'double' if isinstance(a, float) else 'string'}" for n, a in zip(names, args, strict=True)))
    return frame.select(f(*map(F.col, names)).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("given", "want"),
    [("\\boxed{\\text{C}}", "C"), ("\\boxed{ A } then \\boxed{B}", "A"), ("Options: pick B", "S"), ("I think it is B", "B"), ("\\boxed{\\frac{1}{2}}", "\\frac{1"), ("", ""), (None, ""), ("  \n ", ""), ("went home", "went home"), ('he said "yes" twice', "yes")],
)
def test_answer(spark, given, want):
    assert value(spark, text.answer, given) == want


def python_ladder(given):
    """The ladder by Python's re, on the whole text."""
    t = ("thus \\boxed{ \\text{" + (given or "") + "} } or \\boxed{B}").strip()
    box = re.findall(text.BOXED, t.replace("\\text{", ""))
    if box and box[0].strip():
        return box[0].strip()
    for p in (text.MCQ_COLON, text.MCQ_OPTION, text.MCQ_ALT):
        if m := re.search(p, t):
            return m[1].upper()
    return re.findall(r"(?<!\w)([A-Z])(?!\w)", t)[-1]


def test_boxed_takes_whole_texts(spark):
    odd = [None, "", " \n\t", "}", "}{", "} answer: c", "a{b}c", "x" * 50_000, "line\nline " * 3000, "\\text{in} out", "\\boxed{C} and D", "UPPER ONLY", "\xa0é\u3000", "{", "1"]
    texts = odd + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", text.answer(boxed_text(F.col("text"))).alias("x")).collect()
    assert {r.id: r.x for r in rows} == {i: python_ladder(t) for i, t in enumerate(texts)}
    assert QUERIES["extract_boxed"](spark, DATA).count() == len(texts) - len(odd)


def test_balanced_box(spark):
    assert value(spark, text.math_answer, "so \\boxed{\\frac{1}{2}} ok") == "\\frac{1}{2}"
    assert value(spark, text.math_answer, "got 3 and then 4.5 apples") == "4.5"


@pytest.mark.parametrize(("a", "b", "want"), [("\\boxed{1,000}", "1000", 1.0), ("50", "0.5", 1.0), ("3", "4", 0.0), ("x = 7", "7", 1.0), ("\\boxed{12}", "12", 1.0)])
def test_math(spark, a, b, want):
    assert value(spark, scores.math_metric, a, b) == want


@pytest.mark.parametrize(("a", "b", "want"), [("\\boxed{B}", "1.0", 1.0), ("\\boxed{B}", "maybe", 0.0), ("\\boxed{A}", "-0.5", 1.0), ("\\boxed{C}", "c", 1.0)])
def test_mcq(spark, a, b, want):
    assert value(spark, scores.mcq_accuracy, a, b) == want


def test_meteor(spark):
    assert value(spark, lambda a, b: scores.meteor_words(F.split(a, " "), F.split(b, " ")), "a x a x a", "a y a y a") == pytest.approx(-2.1)
    assert value(spark, lambda a, b: scores.meteor_words(F.split(a, " "), F.split(b, " ")), "the cat sat", "the cat sat") == pytest.approx(0.94444444)


def test_superglue(spark):
    assert value(spark, scores.superglue_exact, "\\boxed{Y}", "Yes") == 0.0
    assert value(spark, scores.superglue_exact, "\\boxed{B}", "1") == 0.0


@pytest.mark.parametrize(("cost", "accuracy", "want"), [(0.0044, 1.0, 1.0), (1.0, 0.75, 0.716264254886406), (200.0, 0.5, 0.0), (300.0, 0.5, 0.0), (-1.0, 0.5, None)])
def test_arena(spark, cost, accuracy, want):
    assert value(spark, costs.arena, cost, accuracy) == (None if want is None else pytest.approx(want))


def test_braces_and_fill(spark):
    assert value(spark, prompts.escape_braces, "{x} {{y}} {{{z") == "{{x}} {{y}} {{{{z"
    assert value(spark, lambda q: prompts.fill("{{}} {Q}", Q=q), "{Q}") == "{} {{Q}}"


def test_argmax_takes_the_first(spark):
    assert spark.range(1).select(keyed.argmax(F.array(*map(F.lit, (0.2, 0.5, 0.5))))).first()[0] == 1


def test_upsert_twice_is_once(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = keyed.upsert(base, new, ["k"])
    assert sorted(map(tuple, keyed.upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_code_runs_only_if_allowed():
    tests = [{"input": "2", "output": "4"}]
    with pytest.raises(PermissionError):
        code_run.run_stdin_tests("print(int(input())*2)", tests)
    assert code_run.run_stdin_tests("print(int(input())*2)", tests, allow=True)
    assert not code_run.run_stdin_tests("while True: pass", tests, allow=True, seconds=1)


def lcs_f(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 2 * table[-1][-1] / (len(a) + len(b)) if a and b else 0.0


def test_rouge_l_equals_the_full_table(spark):
    rng = random.Random(3)
    rows = [([], []), (["a"], []), ([], ["a"]), (["a"], ["b"])]
    rows += [([rng.choice("abcd") for _ in range(rng.randrange(9))], [rng.choice("abce") for _ in range(rng.randrange(9))]) for _ in range(60)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = dict(frame.select("i", scores.rouge_l(F.col("a"), F.col("b"))).collect())
    assert got == pytest.approx({i: lcs_f(a, b) for i, (a, b) in enumerate(rows)})


FORMULAS = [
    ("\\frac{1}{2}", "0.5", True), ("\\frac12", "0.5", True), ("(x+1)^2", "x^2+2x+1", True), ("x^2", "x^3", False), ("\\sqrt{8}", "2\\sqrt{2}", True), ("\\sqrt[3]{27}", "3", True),
    ("2\\pi", "6.28318", True), ("y=2x", "2x-y=0", True), ("x=5", "5", True), ("5", "x = 5", True), ("a/b", "b/a", False), ("\\sin^2(x)+\\cos^2(x)", "1", True), ("no idea", "other", False),
    ("|x-1|", "|1-x|", True), ("-x^2", "(-x)^2", False), ("\\left(x+1\\right)\\cdot 2", "2x+2", True), ("", "", False), (None, "1", False), ("(" * 1500, "x", False), ("9^9^9^9", "1", False),
    ("\\begin{pmatrix}1&x\\\\2&0.5\\end{pmatrix}", "\\begin{pmatrix}1.0 & x\\\\ 2 & \\frac12\\end{pmatrix}", True), ("\\begin{pmatrix}1&2\\end{pmatrix}", "\\begin{pmatrix}1&3\\end{pmatrix}", False), ("e^{i\\pi}", "-1", True),
]


@pytest.mark.parametrize(("a", "b", "want"), FORMULAS)
def test_formulas(a, b, want):
    assert symbolic.equal(a, b) is want


def test_formulas_leave_what_native_steps_settle(spark):
    rows = [(1, "\\boxed{x+1}", "1+x"), (2, "\\boxed{4}", "5"), (3, "\\boxed{B}", "B"), (4, None, "1"), (5, "\\boxed{1}", None), (6, "\\boxed{\\frac{2}{4}}", "0.5")]
    got = spark.createDataFrame(rows, "id int, a string, b string").select("id", symbolic.math_metric(F.col("a"), F.col("b")).alias("s")).collect()
    assert {r.id: r.s for r in got} == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0, 5: 0.0, 6: 1.0}


def python_classes(text, truth, classes):
    found = [c for c in classes if c in text]
    for c in found:
        if c in truth and c != truth:
            found.remove(c)
    return 1 / len(found) if truth in found else 0.0


def test_class_score_skips_as_the_loop_does(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices("abc", k=6)), "".join(rng.choices("abc", k=3)), ["".join(x) for x in {tuple(rng.choices("abc", k=rng.randrange(1, 4))) for _ in range(7)}]) for _ in range(200)]
    rows = [(t + g, g, [*dict.fromkeys([*c, g])]) for t, g, c in rows]
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, r struct<t:string,g:string,c:array<string>>")
    got = dict(frame.select("i", scores.class_score(F.col("r.t"), F.col("r.g"), F.col("r.c"))).collect())
    assert got == pytest.approx({i: python_classes(*r) for i, r in enumerate(rows)})


def test_numbers_of_a_table_of_many_partitions(spark):
    rows = spark.range(0, 60_000, 1, 24).select((F.col("id") * 7919 % 60_000).alias("k"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("t"))
    got = keyed.numbered(rows, ["k"], "i", start=5)
    assert got.columns == ["k", "t", "i"] and got.count() == got.where("t <> ''").count() == 60_000
    assert got.where("i <> k + 5").count() == 0
    assert keyed.numbered(rows.where("k < 0"), ["k"], "i").count() == 0
    tied = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "k int, t string")
    assert sorted(r.i for r in keyed.numbered(tied, ["k"], "i").collect()) == [0, 1, 2]


def test_numbers_hold_under_a_filter(spark):
    """Rows and sizes must be of the same partitions, also where adaptive execution merges partitions."""
    held = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.files.maxPartitionBytes": "1m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_quantity")
        got = keyed.numbered(lines, ["l_orderkey", "l_linenumber", "l_partkey"], "i")
        assert got.where("l_extendedprice > 0").count() == lines.where("l_extendedprice > 0").count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
