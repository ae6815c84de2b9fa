"""Ordered rules, group veto and duplicate / identity flags.

Flags over a group are worked out as pre-aggregated tables that are joined back,
never as a window over raw rows: a parent that holds a third of all children then
costs one partial aggregate per map task, and adaptive execution splits its join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from prizelens.functions.text import name_key
from prizelens.operators.joins import duplicate_keys, lookup
from prizelens.operators.quantiles import exact_quantiles
from prizelens.session import stored_small


def first_reason(rules: Sequence[tuple[str | Column, Column | None]]) -> Column:
    """Code of the first rule that fails, in list order; null when all pass.

    A rule is ``(code, fail_condition)`` or ``(reason_column, None)`` for rules
    that work out their own code.
    """
    parts = []
    for code, failed in rules:
        if failed is None:
            parts.append(code)
        else:
            parts.append(F.when(failed, F.lit(code)))
    return F.coalesce(*parts, F.lit(None).cast("string"))


def group_veto(
    children: DataFrame, parent: str, pos: str | Column, reason: str
) -> DataFrame:
    """Per rejected parent: the reason of its first bad child in source order."""
    return (
        children.where(F.col(reason).isNotNull())
        .groupBy(parent)
        .agg(F.min_by(reason, pos).alias("veto_reason"))
    )


def apply_veto(children: DataFrame, veto: DataFrame, parent: str) -> DataFrame:
    """Children of parents that no child vetoed."""
    return children.join(veto.select(parent), parent, "left_anti")


def to_quarantine(
    df: DataFrame,
    key: str,
    reason: str,
    affected: str,
    source: str | None = None,
    payload: Sequence[str] | None = None,
) -> DataFrame:
    """One row per flagged issue; the raw row travels along as JSON."""
    kept = payload or df.columns
    return df.where(F.col(reason).isNotNull()).select(
        F.col(key).cast("string").alias("record_id"),
        F.col(reason).alias("reason"),
        F.lit(affected).alias("affected_table"),
        (F.col(source) if source else F.lit(None).cast("string")).alias("source"),
        F.to_json(F.struct(*kept)).alias("payload"),
    )


def null_ambiguous_ids(
    children: DataFrame, parent: str, item_id: str, name: str
) -> DataFrame:
    """Null an id that names more than one item inside its parent; keep the rows.

    Adds ``<item_id>_raw`` and ``identity_status``. Text names are compared
    case-folded.
    """
    is_text = children.schema[name].dataType == StringType()
    key = name_key(F.col(name)) if is_text else F.col(name)
    # Smallest and largest differ: cheaper than a distinct count, but only numbers
    # keep it a hash aggregate.
    several = (
        F.count_distinct(key) > 1 if is_text else F.min(key) != F.max(key)
    )
    ambiguous = (
        children.where(F.col(item_id).isNotNull() & F.col(name).isNotNull())
        .groupBy(parent, item_id)
        .agg(several.alias("_ambiguous"))
        .where("_ambiguous")
    )
    raw = F.col(item_id)
    return (
        children.join(ambiguous, [parent, item_id], "left")
        .withColumns(
            {
                f"{item_id}_raw": raw,
                "identity_status": F.when(
                    F.col("_ambiguous"), F.lit("ambiguous_source_id")
                )
                .when(raw.isNotNull(), F.lit("source_provided_not_verified"))
                .otherwise(F.lit("source_id_missing")),
                item_id: F.when(F.col("_ambiguous").isNull(), raw),
            }
        )
        .drop("_ambiguous")
    )


def duplicate_within(
    df: DataFrame, keys: Sequence[str], pos: str, name: str = "is_repeat"
) -> DataFrame:
    """Flag every occurrence of a key after the first. ``pos`` is unique per key."""
    keys = list(keys)
    firsts = (
        df.groupBy(*keys)
        .agg(F.min(pos).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    return lookup(df, firsts, keys).withColumn(
        name, F.coalesce(F.col(pos) > F.col("_first"), F.lit(False))
    ).drop("_first")


def flag_duplicates(
    df: DataFrame, keys: Sequence[str], name: str = "is_duplicated"
) -> DataFrame:
    """Flag all members of a repeated key."""
    keys = list(keys)
    repeated = duplicate_keys(df, keys).withColumnRenamed("n_rows", "_repeats")
    return (
        lookup(df, repeated, keys)
        .withColumn(name, F.col("_repeats").isNotNull())
        .drop("_repeats")
    )


def iqr_fences(
    df: DataFrame, by: Sequence[str], metric: str, k: float = 1.5
) -> DataFrame:
    """Per group the lower and upper fence ``q1 - k*iqr`` and ``q3 + k*iqr``.

    The fences are stored, so that rows of a few large groups are not shuffled by group to
    meet them.
    """
    q = exact_quantiles(df, by, metric, {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    fences = q.select(
        *by,
        (F.col("q1") - F.lit(k) * spread).alias("lower_fence"),
        (F.col("q3") + F.lit(k) * spread).alias("upper_fence"),
    )
    return stored_small(fences, "fences")


def iqr_flag(
    df: DataFrame, by: Sequence[str], metric: str, k: float = 1.5
) -> DataFrame:
    """Add ``<metric>_iqr_flag``: strictly outside the fences. Nothing is deleted."""
    by = list(by)
    fences = iqr_fences(df, by, metric, k)
    return lookup(df, fences, by).withColumn(
        f"{metric}_iqr_flag",
        F.coalesce(
            (F.col(metric) < F.col("lower_fence"))
            | (F.col(metric) > F.col("upper_fence")),
            F.lit(False),
        ),
    ).drop("lower_fence", "upper_fence")


def flag_conflicts(
    df: DataFrame, key: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Per key: number of distinct metadata combinations and whether they conflict."""
    return (
        df.groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("observations"),
            F.count_distinct(F.struct(*cols)).alias("variants"),
        )
        .withColumn(
            "review_status",
            F.when(F.col("variants") > 1, F.lit("needs_metadata_review")).otherwise(
                F.lit("consistent")
            ),
        )
    )


def set_signatures(df: DataFrame, page: str, item: str) -> DataFrame:
    """Per page a signature of its set of items, independent of order and repeats.

    Four running sums of item hashes plus the count stand for the set, so no
    page's items are gathered in one place.
    """
    distinct = df.select(page, item).distinct()
    digest = F.sha2(F.col(item).cast("string"), 256)
    parts = [
        F.conv(F.substring(digest, 1 + 14 * i, 14), 16, 10).cast("decimal(38,0)")
        for i in range(4)
    ]
    return distinct.groupBy(page).agg(
        F.count(F.lit(1)).alias("n_items"),
        *[F.sum(p).alias(f"_s{i}") for i, p in enumerate(parts)],
    )


def duplicate_sets(df: DataFrame, page: str, item: str) -> DataFrame:
    """Pages whose set of items equals that of an earlier page (smallest id)."""
    marks = ["n_items", "_s0", "_s1", "_s2", "_s3"]
    signatures = set_signatures(df, page, item)
    firsts = signatures.groupBy(*marks).agg(F.min(page).alias("same_set_as"))
    return signatures.join(firsts, marks).select(
        page,
        "n_items",
        F.when(F.col("same_set_as") != F.col(page), F.col("same_set_as")).alias(
            "same_set_as"
        ),
    )
