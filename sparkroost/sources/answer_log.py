"""Inference with saved progress: answers go to a log in the shared folder while the tasks run.

Requests are dealt to a fixed number of shards by their key. A shard's task appends a file of answers every
``every`` requests (written beside its name, then renamed), and begins by reading what the shard's log has, so neither a lost
task nor a later run asks again what was answered: of one run each request is asked once, of earlier runs the
successes are reused and the failures retried. A task that is lost between two files asks at most the ``every``
requests since its last one again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import inference

#: A log's columns: the request, its answer, the run that asked, and when (an order within the shard).
LOG = [("global_index", pa.string()), ("model", pa.string()), ("response", pa.string()), ("success", pa.bool_()), ("error", pa.string()), ("provider", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("total_tokens", pa.int64()), ("run_id", pa.string()), ("asked", pa.int64())]
LOG_SCHEMA = "global_index string, model string, response string, success boolean, error string, provider string, input_tokens long, output_tokens long, total_tokens long, run_id string, asked long"
SHARDS, EVERY = 64, 10


def open_fs(path: str):
    """On an executor: pyarrow's file system for a shared path, and the path within it."""
    from pyarrow import fs

    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    elif path.startswith("file://") and not path.startswith("file:///"):
        path = path.replace("file://", "file:///", 1)
    return fs.FileSystem.from_uri(path)


class ShardLog:
    """One shard's files; numbered, so that their order is that of the answers."""

    def __init__(self, folder: str, shard: int):
        from pyarrow import fs

        self.fs, root = open_fs(folder)
        self.root = f"{root}/shard={shard}"
        self.fs.create_dir(self.root, recursive=True)
        names = sorted(f.base_name for f in self.fs.get_file_info(fs.FileSelector(self.root)) if f.base_name.endswith(".parquet"))
        self.files = [f"{self.root}/{n}" for n in names]
        self.next = 1 + max((int(n.split("-")[1]) for n in names), default=-1)

    def done(self, run_id: str) -> set[tuple[str, str]]:
        """Requests that need no asking: answered in this run, or with success in an earlier one."""
        out = set()
        for path in self.files:
            with self.fs.open_input_file(path) as f:
                for r in pq.read_table(f, columns=["global_index", "model", "success", "run_id"]).to_pylist():
                    if r["success"] or r["run_id"] == run_id:
                        out.add((r["global_index"], r["model"]))
        return out

    def append(self, rows: list[tuple], attempt: int) -> None:
        columns = zip(*rows, strict=True)
        table = pa.table([pa.array(c, kind) for c, (_, kind) in zip(columns, LOG, strict=True)], names=[n for n, _ in LOG])
        trial = f"{self.root}/.trial-{self.next}-{attempt}"
        with self.fs.open_output_stream(trial) as f:
            pq.write_table(table, f, compression="zstd")
        self.fs.move(trial, f"{self.root}/part-{self.next:08d}-{attempt}.parquet")
        self.next += 1


def _ask(clients, providers, folder: str, run_id: str, every: int, per_second: float | None, attempts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, logs, last = TaskContext.get().taskAttemptId(), {}, 0.0
        asked, reused, failed = {}, {}, {}
        held: dict[int, list[tuple]] = {}

        def flush(shard: int) -> None:
            if held.get(shard):
                logs[shard][0].append(held.pop(shard), attempt)

        try:
            for batch in batches:
                for key, model, prompt, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if shard not in logs:
                        log = ShardLog(folder, shard)
                        logs[shard] = (log, log.done(run_id))
                        asked[shard] = reused[shard] = failed[shard] = 0
                    done = logs[shard][1]
                    if (key, model) in done:
                        reused[shard] += 1
                        continue
                    done.add((key, model))
                    provider = inference.provider_of(model, providers)
                    client = clients.get(provider)
                    if per_second:
                        time.sleep(max(0.0, last + 1 / per_second - time.monotonic()))
                        last = time.monotonic()
                    got = inference.with_retry(lambda: client(model, prompt), attempts) if client else {"success": False, "error": f"no client for {provider}"}  # noqa: B023
                    usage, ok = got.get("token_usage") or {}, bool(got.get("success", False))
                    counts = [int(usage.get(k, 0)) for k in ("input_tokens", "output_tokens", "total_tokens")]
                    held.setdefault(shard, []).append((key, model, got.get("response", ""), ok, None if ok else got.get("error"), provider, *counts, run_id, time.time_ns()))
                    asked[shard] += 1
                    failed[shard] += not ok
                    if len(held[shard]) >= every:
                        flush(shard)
        finally:  # also when a client ends the task
            for shard in list(held):
                flush(shard)
        names = list(asked)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *(pa.array([x[s] for s in names], pa.int64()) for x in (asked, reused, failed))], ["shard", "asked", "reused", "failed"])

    return run


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The log's answers, one for each request: the last success, else the last failure."""
    rows = spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.parquet").parquet(folder)
    others = [c for c in rows.columns if c not in ("global_index", "model")]
    return rows.groupBy("global_index", "model").agg(F.max_by(F.struct(*others), F.struct("success", "asked")).alias("x")).select("global_index", "model", "x.*")


def run_inference(rows: DataFrame, clients: dict[str, Callable[[str, str], dict]], providers: dict[str, str], folder: str, run_id: str, shards: int = SHARDS, every: int = EVERY, per_second: float | None = None, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Ask what ``rows`` (global_index, model, prompt) still need, and return (entries, counts): an answer for each
    request of ``rows`` from the log, and a row for each shard (shard, asked, reused, failed). ``per_second`` bounds
    one task's requests; all tasks together ask at most that times the tasks that run at once. The number of shards
    belongs to the folder; a model without a provider fails the run, after what was answered is saved."""
    spark = rows.sparkSession
    own = rows.select(F.col("global_index").cast("string").alias("global_index"), "model", "prompt").where("global_index is not null and model is not null")
    dealt = own.withColumn("shard", F.pmod(F.xxhash64("global_index", "model"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    told = dealt.select("global_index", "model", "prompt", "shard").mapInArrow(_ask(clients, providers, folder, run_id, every, per_second, attempts), "shard int, asked long, reused long, failed long")
    counts = spark.createDataFrame(told.collect(), told.schema)  # a row for each shard
    return own.join(latest(spark, folder), ["global_index", "model"]), counts
