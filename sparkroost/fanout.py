"""Many models at once: a Spark job group for each, its share of the cluster, and a time limit.

Every model's work runs in a thread of the driver, in a scheduler pool and a job group of its own (with
``spark.scheduler.mode`` FAIR the pools share the executors; else jobs go in order of arrival). A model over its limit
has its group cancelled, so a hung one holds no executor, and the others go on. What a model gives is written
beside its place and renamed, so a cancelled or failed model leaves nothing that a reader takes for a result.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.answer_log import run_inference
from .sources.readers import rename

#: Models at a time, and the seconds that one may take.
WORKERS, SECONDS = 16, 43_200.0
STATUS = "model string, status string, duration double, error string"


def _one(spark: SparkSession, model: str, work: Callable[[str], DataFrame], folder: str, seconds: float) -> tuple[str, str, float, str | None]:
    """(model, status, duration, error) of one model. The work runs in a thread of its own, because code that never
    comes back to Spark can't be cancelled: such a thread is left, and its late result is not renamed."""
    context, group, began = spark.sparkContext, f"model-{uuid.uuid4().hex}", time.monotonic()
    beside, state = f"{folder}/_{group}", {"late": False}
    found: Future = Future()
    lock = threading.Lock()

    def run() -> None:
        context.setJobGroup(group, model, interruptOnCancel=True)
        context.setLocalProperty("spark.scheduler.pool", model)
        try:
            work(model).write.mode("overwrite").parquet(beside)
            with lock:
                if not state["late"]:
                    rename(spark, beside, f"{folder}/model={model}")
            found.set_result(None)
        except Exception as e:  # of the work or of Spark; the row tells which
            found.set_exception(e)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        with lock:
            state["late"] = not found.done()
        if state["late"]:
            context.cancelJobGroup(group)
            return model, "timeout", time.monotonic() - began, f"over {seconds:g} seconds"
    error = found.exception()
    duration = time.monotonic() - began
    if error is None:
        return model, "success", duration, None
    in_spark = type(error).__module__.startswith(("pyspark", "py4j"))
    return model, "failed" if in_spark else "exception", duration, (str(error).strip().splitlines() or [type(error).__name__])[0]


def fan_out(spark: SparkSession, models: Sequence[str], work: Callable[[str], DataFrame], folder: str, workers: int = WORKERS, seconds: float = SECONDS) -> DataFrame:
    """Run ``work`` for each model, ``workers`` at a time, and write what it gives to ``folder/model=<name>``. A
    row for each model: ``success``; ``failed``, a job of Spark's; ``exception``, an error before or between the
    jobs; ``timeout``. The order is that of ``models``; names must differ."""
    if len(set(models)) != len(models):
        raise ValueError("a model is named twice")
    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(models)))) as pool:
        rows = list(pool.map(lambda m: _one(spark, m, work, folder, seconds), models))
    return spark.createDataFrame(rows, STATUS)


def results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What the models gave, with their name; those without a result are absent."""
    return spark.read.schema(f"{schema}, model string").option("basePath", folder).parquet(folder)


def infer_models(spark: SparkSession, questions: DataFrame, models: Sequence[str], clients: dict, providers: dict[str, str], log: str, folder: str, run_id: str, workers: int = WORKERS, seconds: float = SECONDS, **settings) -> DataFrame:
    """Every model's answers to all ``questions`` (global_index, prompt), each model with a log of its own under ``log``
    (see :func:`answer_log.run_inference`, which takes ``settings``). Questions without a prompt are left out."""
    asked = questions.where("global_index is not null and prompt <> ''")

    def work(model: str) -> DataFrame:
        rows = asked.select("global_index", F.lit(model).alias("model"), "prompt")
        return run_inference(rows, clients, providers, f"{log}/{model}", run_id, **settings)[0].drop("model")

    return fan_out(spark, models, work, folder, workers, seconds)
