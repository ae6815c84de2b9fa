"""Parent totals against the sum of their children, to the cent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prizelens.functions.money import prize_status
from prizelens.functions.text import sign_label

TOLERANCE_CENTS = 2


def child_totals(children: DataFrame, parent: str, amount: str) -> DataFrame:
    return children.groupBy(parent).agg(
        F.sum(amount).alias("child_cents"), F.count(F.lit(1)).alias("child_rows")
    )


def reconcile(
    parents: DataFrame,
    children: DataFrame,
    parent: str,
    pool: str,
    amount: str,
    tolerance: int = TOLERANCE_CENTS,
) -> DataFrame:
    """Add child total, difference (child - pool) and status to every parent.

    Children are summed before the join, so a parent's pool is never repeated.
    A parent without children has null total and status.
    """
    joined = parents.join(child_totals(children, parent, amount), parent, "left")
    return joined.withColumn(
        "diff_cents", F.col("child_cents") - F.col(pool)
    ).withColumn("status", prize_status(F.col("diff_cents"), tolerance))


def reconcile_review(
    parents: DataFrame,
    children: DataFrame,
    parent: str,
    pool: str,
    amount: str,
    name: str,
    tolerance: int = TOLERANCE_CENTS,
) -> DataFrame:
    """Review sheet: direction, size of the difference, repeats and negatives.

    Names are counted per (parent, name) first, then per parent, so neither a
    large parent nor a frequent name is gathered.
    """
    per_parent = (
        children.groupBy(parent, name)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(amount).alias("_sum"),
            F.count_if(F.col(amount) < 0).alias("_negative"),
        )
        .groupBy(parent)
        .agg(
            F.sum("_sum").alias("child_cents"),
            F.sum("_n").alias("child_rows"),
            F.count_if(F.col(name).isNotNull() & (F.col("_n") > 1)).alias(
                "duplicate_names"
            ),
            F.sum("_negative").alias("negative_amounts"),
        )
    )
    diff = F.col("child_cents") - F.col(pool)
    return parents.join(per_parent, parent, "inner").withColumns(
        {
            "diff_cents": diff,
            "abs_diff_cents": F.abs(diff),
            "abs_diff_pct": F.round(
                F.try_divide(F.abs(diff), F.abs(F.col(pool))) * F.lit(100.0), 4
            ),
            "direction": sign_label(
                diff, "placements_below_pool", "placements_above_pool", "equal"
            ),
            "status": prize_status(diff, tolerance),
        }
    )


def reconcile_two_sided(
    parents: DataFrame,
    children: DataFrame,
    breakdown: DataFrame,
    parent: str,
    pool: str,
    amount: str,
) -> DataFrame:
    """The pool against its children and against its breakdown rows."""
    rows = breakdown.groupBy(parent).agg(F.sum(amount).alias("breakdown_cents"))
    return (
        parents.join(child_totals(children, parent, amount), parent, "left")
        .join(rows, parent, "left")
        .withColumns(
            {
                "child_diff_cents": F.col("child_cents") - F.col(pool),
                "breakdown_diff_cents": F.col("breakdown_cents") - F.col(pool),
            }
        )
        .withColumn(
            "breakdown_check",
            F.when(F.col("breakdown_cents").isNull(), F.lit("unavailable"))
            .when(F.col("breakdown_diff_cents") == 0, F.lit("matches_pool"))
            .otherwise(F.lit("differs_from_pool")),
        )
    )


def audit_breakdown(
    rows: DataFrame,
    parents: DataFrame,
    parent: str,
    code: str,
    amount: str,
    pool: str,
    tolerance: int = TOLERANCE_CENTS,
) -> DataFrame:
    """One audit row per parent: reconciled / total_mismatch / unavailable.

    Repeated codes or no rows make the table unavailable with an error.
    """
    per_parent = (
        rows.groupBy(parent, code)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_sum"))
        .groupBy(parent)
        .agg(
            F.sum("_n").alias("row_count"),
            F.max("_n").alias("_most"),
            F.sum("_sum").alias("breakdown_cents"),
        )
    )
    bad = F.col("row_count").isNull() | (F.col("_most") > 1)
    return (
        parents.join(per_parent, parent, "left")
        .withColumns(
            {
                "error": F.when(bad, F.lit("empty_or_duplicate_country_rows")),
                "status": F.when(bad, F.lit("unavailable"))
                .when(
                    F.abs(F.col("breakdown_cents") - F.col(pool)) <= tolerance,
                    F.lit("reconciled"),
                )
                .otherwise(F.lit("total_mismatch")),
                "row_count": F.coalesce("row_count", F.lit(0)),
            }
        )
        .drop("_most")
    )


def accept_breakdown(
    rows: DataFrame, audit: DataFrame, parent: str
) -> tuple[DataFrame, DataFrame]:
    """(rows of reconciled parents, rows kept for review with their status)."""
    accepted = audit.where(F.col("status") == "reconciled").select(parent)
    kept = rows.join(accepted, parent, "left_semi")
    review = rows.join(audit.select(parent, "status"), parent, "inner")
    return kept, review
