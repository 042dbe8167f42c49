"""What blocks send to buckets, and what comes back, with a fixed fan-out.

A block sends one packed row to each of ``FAN`` buckets (of a kind), however large the corpus is. Where
a bucket fits into a task it is resolved at once. Where it doesn't, its rows are first merged to runs of
``RUN_ITEMS`` items (each item once), a run sends its items on to the ``wide`` parts of its bucket, the
parts are resolved, and the run translates the answers for the blocks that it was merged from. Rows
stay packed at every size: a corpus of n items costs n / RUN_ITEMS * wide rows in the second step.

A codec knows the items: ``sent`` and ``reply`` (schemas), ``resolve(table)`` (the answers of one
bucket), ``merge(rows)``, ``split(merged, bucket, wide)`` and ``answer(merged, rows, replies)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _blocks, _shared

FAN = 256
RUN_ITEMS = 2_000_000


def parts(items: int, per_task: int, fan: int = FAN) -> int:
    """Into how many parts each of ``fan`` buckets goes, so that a part has about ``per_task`` items."""
    return max(1, -(-items // (fan * per_task)))


def _runs(run_items: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sub = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        bucket, size = None, 0

        def flush():
            nonlocal held, size, sub
            row = pa.RecordBatch.from_pydict({"run": pa.array([(part << 24) | sub], pa.int64()), "bucket": pa.array([bucket], pa.int32()), "body": pa.array([_blocks._to_ipc(held)], pa.binary())})
            held, size, sub = [], 0, sub + 1
            return row

        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                at, n = own.column("bucket")[0].as_py(), own.column("n")[0].as_py()
                if held and (at != bucket or size + n > run_items):
                    yield flush()
                bucket, size = at, size + n
                held.append(own)
        if held:
            yield flush()

    return run


def _members(body) -> list[dict]:
    return pa.ipc.open_stream(body).read_all().to_pylist()


def _send_on(codec, wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                merged = codec.merge(_members(r["body"]))
                for sub, row in codec.split(merged, r["bucket"], wide):
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([r["bucket"] * wide + sub], pa.int32()), "block": pa.array([r["run"]], pa.int64()), **row})

    return run


def _answer(codec, resolved: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = _members(r["body"])
                yield from codec.answer(codec.merge(rows), rows, _blocks.table_of(resolved, r["run"])).combine_chunks().to_batches()

    return run


def exchange(sent: DataFrame, codec, wide: int, label: str, run_items: int = RUN_ITEMS) -> str:
    """The path of the replies to the blocks, for ``_blocks.table_of``. ``sent``: bucket, block, n and
    the codec's columns."""
    if wide <= 1:
        return _blocks.reply(sent.groupBy("bucket").applyInArrow(codec.resolve, codec.reply), label)
    spark = sent.sparkSession
    dealt = sent.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(wide))).sortWithinPartitions("bucket", "block")
    path = _shared.write(dealt.mapInArrow(_runs(run_items), "run long, bucket int, body binary"), _shared.scratch(spark, "runs"), rows=64)
    runs = spark.read.schema("run long, bucket int, body binary").parquet(path)
    resolved = _blocks.reply(runs.mapInArrow(_send_on(codec, wide), codec.sent).groupBy("bucket").applyInArrow(codec.resolve, codec.reply), label)
    out = _blocks.reply(runs.mapInArrow(_answer(codec, resolved), codec.reply), label)
    _shared.drop(spark, path, resolved)
    return out
