"""Equi-joins with guards, set operations and null policies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Raise at analysis time when a column is missing; no job runs."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def lookup(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join in which a null key matches a null key; the left keys are kept."""
    keys = {k: f"_key_{k}" for k in on}
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(other)) for k, other in keys.items()],
        F.lit(True),
    )
    return left.join(right.withColumnsRenamed(keys), same, how).drop(*keys.values())


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: list[str], side: str) -> None:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"{side} side is not unique on {keys}")


def checked_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    validate: str = "many_to_one",
    indicator: str | None = None,
) -> DataFrame:
    """Join that first proves the promised cardinality.

    The proof is one pre-aggregated pass over each "one" side. ``indicator``
    names a boolean column that tells whether the right side matched.
    """
    allowed = {"many_to_one", "one_to_many", "one_to_one"}
    if validate not in allowed:
        raise ValueError(f"validate must be one of {sorted(allowed)}")
    if validate.endswith("to_one"):
        assert_unique(right, on, "right")
    if validate.startswith("one_"):
        assert_unique(left, on, "left")
    if indicator is None:
        return left.join(right, on, how)
    marked = right.withColumn(indicator, F.lit(True))
    return left.join(marked, on, how).withColumn(
        indicator, F.coalesce(F.col(indicator), F.lit(False))
    )


def enrich(facts: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """Attach a coarser dimension; unmatched facts keep nulls for the checks."""
    return facts.join(dim, on, "left")


def split_by_keys(
    df: DataFrame, keys: DataFrame, on: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is listed, all other rows)."""
    listed = keys.select(*on)
    return df.join(listed, on, "left_semi"), df.join(listed, on, "left_anti")


def attach(df: DataFrame, facts: DataFrame, on: list[str], aggs: list[Column]):
    """Aggregate the many side first, then look it up: money is never repeated."""
    return df.join(facts.groupBy(*on).agg(*aggs), on, "left")


def align_counts(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join of two aggregates; absent measures become 0."""
    measures = [c for c in a.columns + b.columns if c not in on]
    return a.join(b, on, "full").na.fill(0, subset=measures)


def join_config(
    df: DataFrame, config: DataFrame, key: str, required: list[str] | None = None
) -> DataFrame:
    """Inner join to a configuration whose key is unique and complete."""
    assert_unique(config, [key], "config")
    if required is not None:
        found = config.where(F.col(key).isin(*required)).count()
        if found != len(set(required)):
            raise ValueError("configuration does not cover the required keys")
    return df.join(config, key, "inner")


def apply_null_policy(df: DataFrame, zero: list[str]) -> DataFrame:
    """Counts become 0 after an outer join; every other column stays null."""
    return df.na.fill(0, subset=zero)


def complete_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def minus(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys of ``a`` that ``b`` does not have."""
    return a.select(*key).distinct().join(b.select(*key), key, "left_anti")


def common(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys both sides have."""
    return a.select(*key).intersect(b.select(*key))


def set_difference_sizes(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: number of keys only in ``a`` and only in ``b``."""
    tagged = (
        a.select(*key, F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
        .unionByName(b.select(*key, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
        .groupBy(*key)
        .agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    )
    return tagged.agg(
        F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 0)).alias("only_left"),
        F.count_if((F.col("in_a") == 0) & (F.col("in_b") == 1)).alias("only_right"),
    ).withColumn("same_set", (F.col("only_left") == 0) & (F.col("only_right") == 0))
