"""Connected components of a graph of links, by alternating large and small stars.

Every round is two shuffles of the links and is written to the shared folder; links, nodes and
components never come to the driver. A node with very many links is no hot task: minima are
pre-aggregated and the join back is an ordinary shuffled join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import _shared


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b. One star step; again (a, b) with a > b."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(low.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select("a", "b", F.least("a", "m").alias("m"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")


def _mark(links: DataFrame):
    """What stays the same if the links do: their number and the sum of their hashes."""
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link; component: its smallest node.

    ``links``: columns ``a`` and ``b`` (long), in any order; null or equal ends are no links,
    repeated links count once.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = _shared.keep(links.where("a is not null and b is not null and a <> b").select(a.alias("a"), b.alias("b")).distinct(), "links")
    mark = _mark(now)
    while True:
        new = _shared.keep(_star(_star(now, True), False), "links", *_shared.paths(now))
        seen = _mark(new)
        now = new
        if seen == mark:  # neither star changed a link: each node's smallest neighbour is its root
            break
        mark = seen
    nodes = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

