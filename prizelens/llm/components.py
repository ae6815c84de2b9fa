"""Connected components by alternating star operations, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prizelens.llm.common import cut

MAX_ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
    return (
        both.where("b > a").join(least, F.col("a") == F.col("_a"))
        .where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a"))
    return (
        moved.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b"))).distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of all nodes that have an edge but are not the least of theirs.

    ``edges`` has whole numbers ``a`` and ``b``; direction, repeats and loops do not
    matter. The component is its smallest node, which itself is not listed. A hub meets
    its neighbours in partial aggregates and in joins that adaptive execution can split.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut(edges.distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        edges = cut(_small(_large(edges)))
        now = tuple(edges.agg(
            F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)),
        ).first())
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = now
    raise RuntimeError("components did not settle")
