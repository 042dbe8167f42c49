"""Readers and writers, resume as a stream, and upserts, on small files."""

import json

from pyspark.sql import functions as F

from sparkroost.operators import keyed
from sparkroost.sources import readers
from sparkroost.streaming.resume import resume


def test_predictions_and_json_lines(spark, tmp_path):
    row = {"global index": "AIME_1", "prompt": "p", "prediction": "elm", "generated_result": {"generated_answer": "x", "success": True, "token_usage": {"input_tokens": 1, "output_tokens": 2, "total_tokens": 3}}, "cost": 0.5}
    (tmp_path / "p.json").write_text(json.dumps([row, {"global index": "AIME_2", "generated_result": None}]))
    got = readers.predictions(spark, str(tmp_path / "p.json")).orderBy("global_index").collect()
    assert [r.global_index for r in got] == ["AIME_1", "AIME_2"]
    assert got[0].generated_result.token_usage.output_tokens == 2 and got[1].generated_result is None and got[1].accuracy is None

    folder = tmp_path / "caches"
    folder.mkdir()
    (folder / "elm.jsonl").write_text('{"global_index": "a", "success": true}\n\nnot json\n')
    (folder / "oak.jsonl").write_text('{"global_index": "b", "success": false}\n')
    got = readers.caches(spark, str(folder)).select("model", "global_index", "success").collect()
    assert {tuple(r) for r in got} == {("elm", "a", True), ("oak", "b", False)}


def test_prices_keep_the_order_of_the_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"oak": {"input_token_price_per_million": 2, "output_token_price_per_million": 4.5}, "elm": {"input_token_price_per_million": 0.5, "output_token_price_per_million": 1}}')
    got = [tuple(r) for r in readers.prices(spark, str(tmp_path / "c.json")).orderBy("pos").collect()]
    assert got == [(0, "oak", 2.0, 4.5), (1, "elm", 0.5, 1.0)]


def test_router_config_takes_lists_and_maps(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"pipeline_params": {"router_name": "r", "models": ["elm", "oak"]}}')
    (tmp_path / "m.json").write_text('{"pipeline_params": {"router_name": "s", "models": {"elm": 0.1}}}')
    assert [tuple(r) for r in readers.router_config(spark, str(tmp_path / "l.json")).orderBy("pos").collect()] == [("r", 0, "elm"), ("r", 1, "oak")]
    assert [tuple(r) for r in readers.router_config(spark, str(tmp_path / "m.json")).collect()] == [("s", 0, "elm")]


def test_write_cache_replaces_only_its_models(spark, tmp_path):
    folder = str(tmp_path / "cache")
    frame = lambda rows: spark.createDataFrame(rows, "global_index string, success boolean, model string")
    readers.write_cache(frame([("a", True, "elm"), ("b", True, "oak")]), folder)
    readers.write_cache(frame([("c", False, "elm")]), folder)
    got = spark.read.json(folder).select("model", "global_index").collect()
    assert {tuple(r) for r in got} == {("elm", "c"), ("oak", "b")}


def test_upsert_and_pending(spark):
    base = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    new = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert {tuple(r) for r in keyed.upsert(base, new, ["k"]).collect()} == {(1, "old"), (2, "new"), (3, "new")}
    assert [tuple(r) for r in keyed.pending(new, base, ["k"]).collect()] == [(3, "new")]


def test_resume_scores_each_file_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    score = lambda d: d.withColumn("score", F.col("x") * 2)
    for start in (0, 10):
        spark.range(start, start + 10, 1, 2).select(F.col("id").alias("x")).write.mode("append").parquet(source)
        resume(spark, source, "x long", score, target, state, files_per_batch=1)
    got = spark.read.parquet(target)
    assert sorted(r.score for r in got.collect()) == [2 * i for i in range(20)]
    assert got.select("batch").distinct().count() == 4


def test_config_files_lie_in_one_folder(spark, monkeypatch, tmp_path):
    """One file for each data set, and no folder of its own, which would be listed by a task each."""
    from sparkroost.plans import files

    monkeypatch.setattr(files, "scratch", lambda spark, name: str(tmp_path / name))
    got = files.eval_config_files(spark, "/root/testdata/sf0.001").select("dataset").distinct().count()
    inside = [p for p in (tmp_path / "configs").iterdir() if not p.name.startswith((".", "_"))]
    assert got and len(inside) == got and all(p.is_file() for p in inside)
