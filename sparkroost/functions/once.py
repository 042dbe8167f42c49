"""Costly work on repeated values: once for each, in tasks of even size."""

from __future__ import annotations

from pyspark.sql import DataFrame


def each_once(values: DataFrame) -> DataFrame:
    """The different rows of ``values``, dealt over all shuffle partitions however small they are: what is done with
    them takes long, so that tasks merged by size would leave cores idle."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return values.distinct().repartition(parts, *values.columns)
