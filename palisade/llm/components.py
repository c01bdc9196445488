"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.rows import join_grouped, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return join_grouped(both.filter("v > u"), least, ["u"]).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = join_grouped(edges, least, ["u"]).filter("v != m").select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) of the nodes in ``edges`` (u, v).

    Alternating large-star and small-star steps: each replaces edges by edges
    to smaller nodes and keeps what is connected, until every node points at
    the smallest of its component. Each step joins edges with one minimum per
    node, so a node with many edges is a skewed join that adaptive execution
    splits. Steps are written to the shared folder. No edges: no rows.
    """
    oriented = edges.filter("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    current = stored(oriented, "edges")
    seen = _state(current)
    while True:
        current = stored(_small_star(_large_star(current).distinct()).distinct(), "edges")
        now = _state(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
