"""Texts staged as packed blocks, the unit that the word-level operators work on.

A block is a bounded run of texts of one scan partition: one row with the ids, the offsets and
the UTF-8 bytes. It is written to the shared folder once, so that each later pass sees the same
blocks under the same numbers, whatever executor reads them, and a lost task only reads its
blocks again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _shared
from ._words import pack

#: A text over this size is a block by itself.
BLOCK_BYTES = 8 << 20
SCHEMA = "block long, n int, ids binary, nulls binary, offsets binary, data binary, carry binary"


def _to_ipc(batches: list[pa.RecordBatch]) -> bytes | None:
    if not batches:
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _packer(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sub = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        others: list[pa.RecordBatch] = []
        size = 0

        def flush():
            nonlocal held, others, size, sub
            ids, nulls, lens, data = (np.concatenate(x) for x in zip(*held, strict=True))
            row = pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([(part << 24) | sub], pa.int64()),
                    "n": pa.array([len(ids)], pa.int32()),
                    "ids": pa.array([ids.tobytes()], pa.binary()),
                    "nulls": pa.array([nulls.tobytes()], pa.binary()),
                    "offsets": pa.array([np.concatenate([[0], np.cumsum(lens)]).astype(np.int64).tobytes()], pa.binary()),
                    "data": pa.array([data.tobytes()], pa.binary()),
                    "carry": pa.array([_to_ipc(others)], pa.binary()),
                }
            )
            held, others, size, sub = [], [], 0, sub + 1
            return row

        for batch in _shared.parts(batches):
            data, offsets = pack(batch.column(1))
            ids = batch.column(0)
            nulls = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            i, n = 0, len(ids)
            while i < n:
                j = int(np.searchsorted(offsets, offsets[i] + block_bytes - size, "right")) - 1
                if j <= i:
                    if held:
                        yield flush()
                        continue
                    j = i + 1
                j = min(j, n)
                held.append((ids[i:j], nulls[i:j], np.diff(offsets[i : j + 1]), data[offsets[i] : offsets[j]]))
                if batch.num_columns > 2:
                    others.append(batch.select(range(2, batch.num_columns)).slice(i, j - i))
                size += int(offsets[j] - offsets[i])
                i = j
                if size >= block_bytes:
                    yield flush()
        if held:
            yield flush()

    return run


def stage(df: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> str:
    """Write the blocks of ``df``; the path of the table. A null text is empty. With ``carry``, all
    columns of ``df`` but the text go along, in their order, as one Arrow stream for each block."""
    spark = df.sparkSession
    others = [df[c].alias(f"c{i}") for i, c in enumerate(df.columns) if c != text_col] if carry else []
    if carry:
        others.append(df[text_col].isNull().alias("no_text"))
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"), *others).mapInArrow(_packer(block_bytes), SCHEMA)
    return _shared.write(rows, _shared.scratch(spark, "blocks"))


def reply(df: DataFrame, label: str) -> str:
    """Write what an exchange says back to the blocks (columns ``block`` and ``bucket``, and others):
    one folder for each scan partition, rows in order of block, row groups small enough to read
    one block's rows alone."""
    spark = df.sparkSession
    dealt = df.withColumn("part", F.shiftright("block", 24)).repartition("part").sortWithinPartitions("part", "block", "bucket")
    with _shared.small_groups(spark):
        return _shared.write(dealt, _shared.scratch(spark, label), "part", large_rows=True)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


class Block:
    """One row of the table of blocks."""

    def __init__(self, row: dict):
        self.block, self.n = row["block"], row["n"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], np.uint8).astype(bool)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.data = np.frombuffer(row["data"], np.uint8)
        self.carry = row.get("carry")

    def carried(self) -> pa.Table:
        """The other columns of the block's rows."""
        return pa.ipc.open_stream(self.carry).read_all()

    def id_column(self, at=slice(None)) -> pa.Array:
        return pa.array(self.ids[at], pa.int64(), mask=self.nulls[at])

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block({k: batch.column(k)[i].as_buffer() if k not in ("block", "n") else batch.column(k)[i].as_py() for k in batch.schema.names})


def table_of(path: str, key: int) -> list[dict]:
    """On an executor: the rows of block ``key`` in a table that ``reply`` wrote, in order of bucket.
    None were left: an empty list."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, root = _shared.open_fs(f"{path}/part={key >> 24}")
    if where.get_file_info(root).type == fs.FileType.NotFound:
        return []
    out = []
    for f in where.get_file_info(fs.FileSelector(root)):
        if f.base_name.endswith(".parquet"):
            with where.open_input_file(f.path) as source:
                file = pq.ParquetFile(source)
                at = file.schema_arrow.get_field_index("block")
                for g in range(file.num_row_groups):
                    held = file.metadata.row_group(g).column(at).statistics
                    if held is None or not held.has_min_max or held.min <= key <= held.max:
                        out += [r for r in file.read_row_group(g).to_pylist() if r["block"] == key]
    return sorted(out, key=lambda r: r["bucket"])
