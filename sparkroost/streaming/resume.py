"""Resume and checkpoint as a stream: new prediction files are scored once each and merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def resume(spark: SparkSession, source: str, schema: str, score: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 50) -> None:
    """Score all files under ``source`` that no earlier run has, and add them to ``target``. A batch
    is written to a folder of its own number, so that a repeated batch replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
