"""A submission's way from a split and a configuration to its summary."""

import json

import pytest

from sparkroost import submission
from sparkroost.__main__ import main
from sparkroost.operators import validate
from sparkroost.sources import readers

PAYLOADS = [
    ("null", "null_result"), ("[1]", "not_object"), ('{"success": true}', "missing_field"), ('{"generated_answer": 5, "success": true, "token_usage": {}}', "answer_not_text"),
    ('{"generated_answer": " ", "success": true, "token_usage": {}}', "success_without_answer"), ('{"generated_answer": "x", "success": "yes", "token_usage": null}', "success_not_boolean"),
    ('{"generated_answer": "x", "success": true, "token_usage": {}}', None), ('{"generated_answer": "x", "success": true}', "missing_field"), ('{"generated_answer": "", "success": "yes", "token_usage": {}}', "success_without_answer"),
]


def test_payload_errors(spark):
    rows = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(PAYLOADS)], "id int, raw string")
    got = {r.id: r.code for r in rows.select("id", validate.payload_error(rows.raw).alias("code")).collect()}
    assert got == {i: code for i, (_, code) in enumerate(PAYLOADS)}


@pytest.fixture
def files(tmp_path):
    (tmp_path / "router_data_10.json").write_text(json.dumps([{"global index": f"k{i}", "prompt_formatted": f"p{i}"} for i in range(5)]))
    (tmp_path / "r.json").write_text('{"pipeline_params": {"router_name": "r", "models": ["elm", "oak"]}}')
    return tmp_path


def test_generate_check_score_process(spark, files):
    where = str(files / "out")
    submission.generate(spark, str(files / "r.json"), str(files), "sub_10", where)
    made = f"{where}/router=r"
    rows = readers.predictions(spark, made).orderBy("global_index").collect()
    assert [(r.global_index, r.prompt, r.prediction) for r in rows] == [(f"k{i}", f"p{i}", ("elm", "oak")[i % 2]) for i in range(5)]
    common = (str(files / "r.json"), str(files), "sub_10")
    assert submission.check(spark, made, *common).isEmpty()
    assert {r.code for r in submission.check(spark, made, *common, generated=True).collect()} == {"null_result"}
    assert main(["check", made, *common]) == 0

    scored = [{"global index": f"k{i}", "prompt": f"p{i}", "prediction": "oak", "cost": 0.25 * i, "accuracy": float(i % 2)} for i in range(5)]
    (files / "scored.json").write_text(json.dumps(scored))
    out = submission.process(spark, str(files / "scored.json"), *common, "r", str(files / "runs"), "one").first()
    assert (out.num_queries, out.accuracy, out.total_cost, out.avg_cost_per_1000) == (5, pytest.approx(0.4), 2.5, 500.0)
    assert spark.read.json(str(files / "runs")).first().run_id == "one"

    scored[1]["prediction"], scored[2]["prompt"] = "fir", "other"
    (files / "bad.json").write_text(json.dumps(scored[:4]))
    got = {(r.global_index, r.code) for r in submission.check(spark, str(files / "bad.json"), *common).collect()}
    assert got == {("k1", "unknown_model"), ("k2", "prompt_mismatch"), (None, "wrong_size")}
    (files / "prices.json").write_text('{"oak": {"input_token_price_per_million": 1, "output_token_price_per_million": 2}, "elm-mini": {"input_token_price_per_million": 1, "output_token_price_per_million": 2}}')
    registry, aliases = spark.createDataFrame([("oak",)], "model string"), spark.createDataFrame([("ash", "oak")], "alias string, model string")
    for known in (None, aliases):
        more = submission.check(spark, str(files / "bad.json"), *common, aliases=known, registry=registry, prices=str(files / "prices.json"))
        assert {(r.global_index, r.code) for r in more.collect()} - got == {(None, "unregistered_model elm"), (None, "no_price fir")}
    with pytest.raises(ValueError, match="k1: unknown_model"):
        submission.process(spark, str(files / "bad.json"), *common, "r", str(files / "runs"), "two")
    (files / "none.json").write_text("[]")
    with pytest.raises(ValueError, match="no row"):
        submission.score(spark, str(files / "none.json"), "r")
