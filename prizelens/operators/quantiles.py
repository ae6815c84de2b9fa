"""Exact order statistics that never gather a group in one task.

Values are first reduced to (value, count) with map-side combining, so repeats cost
nothing. The distinct values are then range-partitioned by (group, value): Spark draws
the bounds from the data, so a crowded range of dates, ids or prices spreads as evenly as
any other. Counts per (group, partition) give each partition's offset; only the wanted
partitions are ordered inside, each on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from prizelens.operators.joins import lookup
from prizelens.session import ensure_checkpoint_dir


def counted_values(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """``(group, value, _n, _part)``: each value of a group once, nulls too, in the range
    partition it was stored in. The one pass over the input that every statistic here needs."""
    ensure_checkpoint_dir(df.sparkSession)
    return (
        df.groupBy(*by, x)
        .agg(F.count(F.lit(1)).alias("_n"))
        .repartitionByRange(*by, x)
        .withColumn("_part", F.spark_partition_id())
        .checkpoint()  # fixes which partition a value is in
    )


def value_counts_with_start(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """One row per (group, value): count, number of smaller values, group size."""
    by = list(by)
    counts, located = _counts_and_parts(df, by, x)
    joined = lookup(counts, located, [*by, "_part"], "inner")
    inside = W.partitionBy(*by, "_part").orderBy(x)
    return joined.select(
        *by,
        x,
        F.col("_n").alias("n_equal"),
        (
            F.col("_below")
            + F.coalesce(
                F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0),
            )
        ).alias("n_smaller"),
        F.col("_total").alias("n_group"),
    )


def _counts_and_parts(df: DataFrame, by: list[str], x: str):
    counts = counted_values(df.where(F.col(x).isNotNull()), by, x)
    return counts, _located(counts, by)


def _located(counts: DataFrame, by: list[str]) -> DataFrame:
    """Per group and partition it reaches into: rows in it, before it and in all."""
    sizes = counts.groupBy(*by, "_part").agg(F.sum("_n").alias("_in_part"))
    ordered = W.partitionBy(*by).orderBy("_part")
    return sizes.select(
        *by,
        "_part",
        "_in_part",
        F.coalesce(
            F.sum("_in_part").over(ordered.rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_below"),
        F.sum("_in_part").over(W.partitionBy(*by)).alias("_total"),
    )


def exact_quantiles(
    df: DataFrame, by: Sequence[str], x: str, probs: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles of ``x`` per group, exact at any size.

    ``probs`` maps output column to probability. Groups without values are absent.
    """
    counts = counted_values(df.where(F.col(x).isNotNull()), list(by), x)
    return quantiles_of_counts(counts, by, x, probs)


def quantiles_of_counts(
    counts: DataFrame, by: Sequence[str], x: str, probs: dict[str, float]
) -> DataFrame:
    """``exact_quantiles`` of a table that ``counted_values`` made."""
    by = list(by)
    counts = counts.where(F.col(x).isNotNull())
    located = _located(counts, by)
    position = {name: F.lit(p) * (F.col("_total") - 1) for name, p in probs.items()}
    wanted = F.lit(False)
    for pos in position.values():
        for rank in (F.floor(pos), F.ceil(pos)):
            wanted = wanted | (
                (rank >= F.col("_below"))
                & (rank < F.col("_below") + F.col("_in_part"))
            )
    needed = located.where(wanted)
    inside = W.partitionBy(*by, "_part").orderBy(x)
    ranked = (
        lookup(counts, needed, [*by, "_part"], "inner")
        .withColumn(
            "_start",
            F.col("_below")
            + F.coalesce(
                F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
    )
    value = F.col(x).cast("double")

    def at(rank: Column) -> Column:
        return F.max(
            F.when(
                (rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_n")),
                value,
            )
        )

    picks = []
    for name, pos in position.items():
        picks += [
            at(F.floor(pos)).alias(f"_{name}_lo"),
            at(F.ceil(pos)).alias(f"_{name}_hi"),
        ]
    picked = ranked.groupBy(*by).agg(F.max("_total").alias("_total"), *picks)
    return picked.select(
        *by,
        *[
            (
                F.col(f"_{name}_lo")
                + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo"))
                * (pos - F.floor(pos))
            ).alias(name)
            for name, pos in position.items()
        ],
    )


def average_ranks(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Tie-averaged rank of each distinct value of a group."""
    return value_counts_with_start(df, by, x).select(
        *by,
        x,
        (F.col("n_smaller") + (F.col("n_equal") + 1) / F.lit(2.0)).alias("avg_rank"),
    )


HALF = 1 << 27


def moments_of_counts(counts: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """``n, mean, std, min, max`` per group of a table that ``counted_values`` made.

    Whole numbers are summed exactly, in any order: the sum as a decimal, the squares
    of the distances from the whole part of the mean in two halves of 27 bits, so that values of
    any 64-bit size neither overflow nor cancel. Other numbers take the two-pass formula in
    doubles. A group without values has ``n`` 0 and nulls; ``std`` needs two values.
    """
    by = list(by)
    whole = counts.schema[x].dataType in (LongType(), IntegerType(), ShortType(), ByteType())
    exact = "decimal(38,0)" if whole else "double"
    value = F.col(x).cast(exact)
    basics = counts.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(value.isNotNull(), F.col("_n"))), F.lit(0)).alias("n"),
        F.sum((value * F.col("_n").cast(exact)).cast(exact)).alias("_sum"),
        F.min(x).cast("double").alias("min"),
        F.max(x).cast("double").alias("max"),
    )
    mean = F.try_divide(F.col("_sum").cast("double"), F.col("n").cast("double"))
    if not whole:
        basics = basics.withColumn("mean", mean)
        near = lookup(counts, basics, by, "inner").where(value.isNotNull())
        squares = near.groupBy(*by).agg(
            F.sum((F.col(x) - F.col("mean")) * (F.col(x) - F.col("mean")) * F.col("_n")).alias("_s")
        )
        spread = F.col("_s")
    else:
        # The whole part of the mean, and what is left of the sum: both exact.
        n = F.col("n").cast(exact)
        rest = F.when(F.col("n") > 0, F.col("_sum") % n)
        basics = basics.withColumns({
            "_rest": rest.cast(exact),
            "_at": F.when(F.col("n") > 0, ((F.col("_sum") - rest) / n).cast(exact)),
            "mean": mean,
        })
        far = F.abs(value - F.col("_at")).cast(exact)
        high = F.floor(far / F.lit(HALF)).cast(exact)
        low = (far - high * F.lit(HALF).cast(exact)).cast(exact)
        count = F.col("_n").cast(exact)
        near = lookup(counts, basics, by, "inner").where(value.isNotNull()).select(
            *by, count.alias("_c"), high.alias("_h"), low.alias("_l")
        )

        def total(a: str, b: str) -> Column:
            return F.sum((F.col(a) * F.col(b) * F.col("_c")).cast(exact)).cast("double")

        squares = near.groupBy(*by).agg(
            total("_h", "_h").alias("_hh"), total("_h", "_l").alias("_hl"), total("_l", "_l").alias("_ll")
        )
        delta = F.col("_rest").cast("double") / F.col("n")
        spread = (
            F.col("_hh") * float(HALF) * float(HALF) + F.col("_hl") * (2.0 * HALF) + F.col("_ll")
            - F.col("n") * delta * delta
        )
    return lookup(basics, squares, by).select(
        *by, "n", "mean",
        F.when(F.col("n") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.col("n") - 1))).alias("std"),
        "min", "max",
    )
