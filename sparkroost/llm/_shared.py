"""Scratch space that the driver and every executor can reach, and eager tables in it.

A cluster names its shared folder in ``spark.checkpoint.dir``. Everything an operator has to
cut lineage with, or to hand from one pass to the next, is written there, never to a
machine-local temporary folder.
"""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as ``spark.checkpoint.dir`` or ``setCheckpointDir`` names it. Only
    a local master, whose executors are this machine, gets a new folder where none is named."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir names no folder; set it to one that the driver and all executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sparkroost-"))
        where = context._jsc.sc().getCheckpointDir().get()
    return where.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/sparkroost/{label}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that no later read needs."""
    for path in paths:
        fs, p = _fs(spark, path)
        fs.delete(p, True)


def put_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """Write one file of bounded size through Hadoop's file system API."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    for at in range(0, len(data), 1 << 20):
        out.write(bytearray(data[at : at + (1 << 20)]))
    out.close()
    return path


def send_file(spark: SparkSession, data: bytes, label: str) -> str:
    """Give every executor ``data`` (of bounded size) as a file; ``SparkFiles.get`` of the name that
    this returns is its path there."""
    name = f"{hashlib.sha256(data).hexdigest()[:24]}-{label}"
    path = f"{shared_dir(spark)}/sparkroost/{name}"
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        put_bytes(spark, path, data)
    spark.sparkContext.addFile(path)
    return name


@contextlib.contextmanager
def _settings(spark: SparkSession, **values: str | None) -> Iterator[None]:
    """SQL settings for the length of one write; those that this Spark doesn't know stay out."""
    own = {k: v for k, v in values.items() if v is not None and spark.conf.isModifiable(k)}
    held = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows that a join sends to every executor at most; beyond that it is shuffled.
BROADCAST_ROWS = 1 << 22


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``BROADCAST_ROWS`` (narrow) rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def paths(*tables: DataFrame) -> list[str]:
    """The folders of tables that ``keep`` returned."""
    return sorted({f.rpartition("/")[0] for df in tables for f in df.inputFiles()})


@contextlib.contextmanager
def small_groups(spark: SparkSession, size: int = 1 << 20) -> Iterator[None]:
    """Parquet row groups of about ``size`` bytes in the writes within."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    held = conf.get("parquet.block.size")
    conf.set("parquet.block.size", str(size))
    try:
        yield
    finally:
        conf.unset("parquet.block.size") if held is None else conf.set("parquet.block.size", held)


def write(df: DataFrame, path: str, *partition_by: str, large_rows: bool = False, rows: int | None = None) -> str:
    """Write ``df`` as a Parquet table in the shared folder. Spark drops the query's shuffle files
    as soon as the rows are written. ``rows``: how many rows Python gets at a time; ``large_rows``: one."""
    with _settings(df.sparkSession, **{_CLEANUP: "true", _BATCH: "1" if large_rows else rows and str(rows)}):
        out = df.write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return path


def keep(df: DataFrame, label: str, *used: str, large_rows: bool = False, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return it read back; ``used`` paths then go."""
    spark = df.sparkSession
    path = write(df, scratch(spark, label), large_rows=large_rows, rows=rows)
    drop(spark, *used)
    return spark.read.schema(df.schema).parquet(path)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that arrays made from one stay small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """At most ``rows`` rows, chosen by the hash of the columns ``by``: all rows where there are so
    few, else a share of them that is a little under the bound. No partition sends more than that."""
    n = df.count()
    if n > rows:
        df = df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int((1 << 30) * 0.95 * rows / n))
    return df.limit(rows)


def open_fs(path: str):
    """On an executor: pyarrow's file system for a shared path, and the path within it."""
    from pyarrow import fs

    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    elif path.startswith("file://") and not path.startswith("file:///"):
        path = path.replace("file://", "file:///", 1)
    return fs.FileSystem.from_uri(path)
