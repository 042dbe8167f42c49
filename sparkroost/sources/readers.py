"""Readers and writers of the domain's files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .answer_log import open_fs

PREDICTION = "`global index` string, prompt string, prediction string, generated_result struct<generated_answer:string,success:boolean,token_usage:struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>,provider:string,error:string>, cost double, accuracy double"
CACHE = "global_index string, question string, llm_selected string, generated_answer string, token_usage struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>, success boolean, provider string, error string, evaluation_result struct<extracted_answer:string,ground_truth:string,score:double,metric:string,inference_cost:double>"


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """A prediction file (one JSON array); the key is renamed to global_index."""
    return spark.read.option("multiLine", True).schema(PREDICTION).json(path).withColumnRenamed("global index", "global_index")


def json_lines(spark: SparkSession, path: str, schema: str = CACHE, strict: bool = False) -> DataFrame:
    """JSON lines; blank and malformed lines are left out, or fail the read if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def caches(spark: SparkSession, folder: str) -> DataFrame:
    """All models' result caches, the model by its file's name."""
    return json_lines(spark, f"{folder}/*.jsonl").withColumn("model", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1))


def prices(spark: SparkSession, path: str) -> DataFrame:
    """A price table: one JSON object of models, in the file's order (``pos``)."""
    entry = "map<string,struct<input_token_price_per_million:double,output_token_price_per_million:double>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", entry).alias("m"))
    rows = text.select(F.posexplode(F.map_entries("m")).alias("pos", "e"))
    return rows.select("pos", F.col("e.key").alias("model"), F.col("e.value.input_token_price_per_million").alias("in_price"), F.col("e.value.output_token_price_per_million").alias("out_price"))


def router_config(spark: SparkSession, path: str) -> DataFrame:
    """(router_name, pos, model), from a list of names or a map of names to costs."""
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", "pipeline_params struct<router_name:string,models:array<string>>")["pipeline_params"]
    mapped = F.from_json("value", "pipeline_params struct<router_name:string,models:map<string,double>>")["pipeline_params"]
    names = F.coalesce(F.when(F.size(listed["models"]) > 0, listed["models"]), F.map_keys(mapped["models"]))
    return text.select(F.coalesce(listed["router_name"], mapped["router_name"]).alias("router_name"), F.posexplode(names).alias("pos", "model"))


def metrics_block(log: Column) -> Column:
    """The JSON block after ``Metrics:`` in a log's text; empty if there is none."""
    return F.regexp_extract(log, r"(?s)Metrics:\s*(\{.*?\})", 1)


def metrics_in_log(log: DataFrame) -> DataFrame:
    return log.select(metrics_block(F.col("value")).alias("metrics"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(f.getPath().getName() for f in own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(own))


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Put a file or folder in the place of another, which goes if it is there."""
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(new, True)
    if not fs.rename(old, new):
        raise OSError(f"could not rename {path} to {to}")


def write_cache(rows: DataFrame, folder: str) -> None:
    """One folder for each model; only the models in ``rows`` are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").json(folder)


# The files of the splits.
SPLITS = {"sub_10": "router_data_10.json", "full": "router_data.json"}
EVAL_CONFIG = "eval_params struct<dataset:string,eval_metrics:array<string>,setting:string,prompt:string,is_stdin_prompt:string,not_is_stdin_prompt:string>"


def dataset(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The prompt rows of a split, from one file (a JSON array) or the folder that :func:`write_splits`
    makes of it (JSON lines); another name than the splits' is an error."""
    if split not in SPLITS:
        raise ValueError(f"no split {split}; there are {', '.join(SPLITS)}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{SPLITS[split]}")
    lines = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    rows = spark.read.option("multiLine", not lines).schema("`global index` string, global_index string, prompt_formatted string").json(f"{folder}/{SPLITS[split]}")
    return rows.select(F.coalesce("global_index", "global index").alias("global_index"), "prompt_formatted")


def eval_configs(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation configurations of a folder, one JSON file for each data set."""
    return spark.read.option("multiLine", True).schema(EVAL_CONFIG).option("recursiveFileLookup", True).json(folder).select("eval_params.*").where("dataset is not null")


def ground_truth(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The truth of a split, from Parquet, in the names that the joins use. A full split whose first
    100 answers are all blank has no truth to score by and is an error."""
    from ..operators.evaluate import has_answers

    raw = spark.read.parquet(path)
    names = {c.lower().replace(" ", "_"): c for c in raw.columns}
    rows = raw.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()])
    if split == "full" and not has_answers(rows, "global_index"):
        raise ValueError("the full split has no ground truth answers")
    return rows


def code_problems(spark: SparkSession, path: str) -> DataFrame:
    """Code problems. The look-ups of one evaluation read the columns that they need, so nothing is held in memory."""
    return spark.read.parquet(path)


def check_router_config(spark: SparkSession, path: str) -> None:
    """Raises unless a router's configuration has pipeline_params with models."""
    row = spark.read.text(path, wholetext=True).select(
        F.get_json_object("value", "$.pipeline_params").alias("params"), F.get_json_object("value", "$.pipeline_params.models").alias("models")
    ).first()
    for name in ("params", "models"):
        if row is None or row[name] is None:
            raise ValueError(f"the router configuration {path} lacks {'pipeline_params' if name == 'params' else 'models'}")


def replace_table(rows: DataFrame, path: str) -> None:
    """Overwrite JSON lines, also when ``rows`` is read from ``path``: written beside it, then renamed."""
    beside = path.rstrip("/") + ".new"
    rows.write.mode("overwrite").json(beside)
    rename(rows.sparkSession, beside, path)


def to_json_lines(spark: SparkSession, path: str, target: str, schema: str = CACHE) -> None:
    """A JSON array as JSON lines, unless the target is there already."""
    spark.read.option("multiLine", True).schema(schema).json(path).write.mode("ignore").json(target)


def write_predictions(rows: DataFrame, folder: str, by: str = "router") -> None:
    """One JSON array for each router, in the order of ``pos``: ``folder/router=<name>/predictions.json``.

    Rows are sorted by range into lines of text, whatever share of them a router has; a task for each router then
    joins its parts line by line, in order, with the brackets and commas between them. The new files take the old
    ones' place by one rename."""
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in (by, "pos")]
    parts, new = (f"{folder.rstrip('/')}.{kind}" for kind in ("parts", "new"))
    ordered = rows.repartitionByRange(by, "pos").sortWithinPartitions(by, "pos")
    ordered.select(by, F.to_json(F.struct(*names)).alias("value")).write.mode("overwrite").partitionBy(by).text(parts)
    remove(spark, new)
    found = [name for name in listed(spark, parts) if name.startswith(f"{by}=")]
    told = spark.createDataFrame([(n,) for n in found], "name string").repartition(max(1, len(found)), "name").mapInArrow(_joined(parts, new), "name string, n long")
    done = told.count()
    if done != len(found):
        raise OSError(f"{done} of {len(found)} files were written")
    remove(spark, folder)
    if found:
        rename(spark, new, folder)
    remove(spark, parts)


def _joined(parts: str, new: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        fs, source = open_fs(parts)
        _, target = open_fs(new)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs.create_dir(f"{target}/{name}", recursive=True)
                trial = f"{target}/.{TaskContext.get().taskAttemptId()}.trial"
                n = 0
                files = sorted((f for f in fs.get_file_info(pafs.FileSelector(f"{source}/{name}")) if f.base_name.startswith("part-")), key=lambda f: f.base_name)
                with fs.open_output_stream(trial) as out:
                    out.write(b"[")
                    for f in files:
                        with fs.open_input_stream(f.path) as stream:
                            for line in io.BufferedReader(stream, 1 << 20):
                                out.write((b",\n" if n else b"\n") + line.rstrip(b"\n"))
                                n += 1
                    out.write(b"\n]\n")
                fs.move(trial, f"{target}/{name}/predictions.json")
                yield pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([n], pa.int64())})

    return run


def write_cube(cube: DataFrame, folder: str) -> None:
    """The (model, global_index) cube, one folder for each model."""
    cube.write.mode("overwrite").partitionBy("model").json(folder)


def write_scores(scored: DataFrame, source: str) -> str:
    """Scores beside the file that they were computed from; the path."""
    path = source.rstrip("/").removesuffix(".jsonl").removesuffix(".json") + ".scores"
    replace_table(scored, path)
    return path


def write_summary(summary: DataFrame, folder: str, run_id: str) -> None:
    """A run's summary under its id, columns in order of their names; earlier runs stay."""
    named = summary.select(*[F.col(c) for c in sorted(summary.columns)]).withColumn("run_id", F.lit(run_id))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(folder)


def write_splits(prompts: dict[str, DataFrame], folder: str) -> list[str]:
    """Write the prompt rows of each split; a failure of a split other than the full one is returned."""
    failed = []
    for split, rows in prompts.items():
        try:
            rows.select("global_index", "prompt_formatted").write.mode("overwrite").json(f"{folder}/{SPLITS[split]}")
        except Exception as e:
            if split == "full":
                raise
            failed.append(f"{split}: {e}")
    return failed
