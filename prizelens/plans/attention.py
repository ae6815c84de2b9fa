"""Attention series: category map, quality status, scope window and panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prizelens.functions.text import label_or
from prizelens.operators.checks import checked_table, run_checks
from prizelens.operators.joins import apply_null_policy, assert_unique, enrich, split_by_keys
from prizelens.operators.rules import flag_duplicates
from prizelens.operators.stats import monthly_rollup, pct

# Attention categories that belong to a family, and their role.
CATEGORIES = {
    "League of Legends": ("League of Legends", "main"),
    "Dota 2": ("Dota 2", "main"),
    "VALORANT": ("Valorant", "main"),
    "Counter-Strike: Global Offensive": ("Counter-Strike", "main"),
    "Counter-Strike": ("Counter-Strike", "main"),
    "Counter-Strike 2": ("Counter-Strike", "supplementary"),
    "Counter-Strike 2 Limited Test": ("Counter-Strike", "supplementary"),
}


def map_category(
    df: DataFrame, col: str, mapping: dict[str, tuple[str, str]] = CATEGORIES
) -> DataFrame:
    """Add family and role from a fixed map; unmapped categories are dropped."""
    family, role = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (f, r) in mapping.items():
        family = F.when(F.col(col) == name, F.lit(f)).otherwise(family)
        role = F.when(F.col(col) == name, F.lit(r)).otherwise(role)
    return df.where(F.col(col).isin(*mapping)).withColumns(
        {"family": family, "role": role}
    )


def quality_status(df: DataFrame, category: str, period: str) -> DataFrame:
    """usable / ambiguous_category_month / missing_category; every row is kept."""
    named = df.withColumn(category, F.trim(category))
    flagged = flag_duplicates(named, [category, period], "_repeated")
    return flagged.withColumn(
        "quality_status",
        F.when(label_or(F.col(category), "") == "", F.lit("missing_category"))
        .when(F.col("_repeated"), F.lit("ambiguous_category_month"))
        .otherwise(F.lit("usable")),
    ).drop("_repeated")


def peak_check(df: DataFrame, key: str, peak: str, average: str) -> DataFrame:
    """Check result: a peak is never below the average."""
    return run_checks(df, {"peak_below_average": F.col(peak) < F.col(average)}, key)


def common_window(df: DataFrame, period: str, low: str, high: str) -> DataFrame:
    """Rows of the months both sources cover."""
    return df.where(
        F.col(period).between(F.lit(low).cast("date"), F.lit(high).cast("date"))
    )


def monthly_panel(
    attention: DataFrame,
    parents: DataFrame,
    platform: DataFrame,
    hours: str = "hours",
) -> tuple[DataFrame, DataFrame]:
    """(game-month panel, parents outside the attention months).

    ``attention`` and ``platform`` have ``month_start``; parents bring family,
    start_date, pool_cents, eligible, quality_note and version. Months without a
    parent keep null money and zero counts.
    """
    keys = ["family", "month_start"]
    assert_unique(attention, keys, "attention")
    dated = parents.withColumn("month_start", F.trunc("start_date", "month"))
    inside, outside = split_by_keys(dated, attention, keys)
    money = monthly_rollup(
        inside, "family", "start_date", "pool_cents", "eligible", "quality_note", "version"
    )
    # The roll-up is unique on its keys by construction.
    joined = attention.join(
        money.withColumn("_seen", F.lit(True)), keys, "left"
    ).withColumn("month_observed", F.col("_seen").isNotNull()).drop("_seen")
    counts = ["observed_count", "known_pool_count", "reconciled_count", "flagged_count"]
    panel = enrich(
        apply_null_policy(joined, counts),
        platform.select("month_start", F.col(hours).alias("platform_hours")),
        ["month_start"],
    )
    return (
        panel.withColumn(
            "share_of_platform_pct", pct(F.col(hours), F.col("platform_hours"))
        ),
        outside,
    )


def checked_panel(panel: DataFrame) -> DataFrame:
    """The panel, stored once and proven: a platform total for each row, share within 0-100."""
    return checked_table(
        panel,
        {
            "platform_missing": F.col("platform_hours").isNull(),
            "platform_not_positive": F.col("platform_hours") <= 0,
            "share_out_of_range": ~F.col("share_of_platform_pct").between(0, 100),
        },
        "family",
    )
