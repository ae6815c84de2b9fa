"""Complete calendars: an unobserved period is a row with nulls, never zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prizelens.functions.calendar import (
    STEPS,
    period_of,
    quarter_label,
    shift_period,
    time_split,
)
from prizelens.functions.money import cents_to_usd


def calendar_rows(
    families: DataFrame, period: str, start: str, end: str, step: str
) -> DataFrame:
    """Every period of the calendar for every listed family (no cross join)."""
    return families.withColumn(
        period,
        F.explode(
            F.sequence(
                F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(STEPS[step])
            )
        ),
    )


def complete_grid(
    facts: DataFrame, family: str, period: str, start: str, end: str, step: str
) -> DataFrame:
    """Fill the gaps of an aggregated (family, period) table.

    Each fact row emits itself and the missing periods up to the next fact, so
    the aggregate below is read once and nothing is joined. ``facts`` must be
    unique on (family, period): a window partition is then at most as long as
    the calendar. ``start`` and ``end`` are period starts.
    """
    ordered = W.partitionBy(family).orderBy(period)
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    low = F.when(F.lag(period).over(ordered).isNull(), first).otherwise(
        F.greatest(first, F.col(period))
    )
    following = F.lead(period).over(ordered)
    high = F.when(following.isNull(), last).otherwise(
        F.least(last, shift_period(following, step, -1))
    )
    measures = [c for c in facts.columns if c not in (family, period)]
    spread = (
        facts.withColumns({"_low": low, "_high": high})
        .where("_low <= _high")
        .withColumn(
            "_at",
            F.explode(F.sequence(F.col("_low"), F.col("_high"), F.expr(STEPS[step]))),
        )
    )
    own = F.col("_at") == F.col(period)
    return spread.select(
        family,
        F.col("_at").alias(period),
        *[F.when(own, F.col(c)).alias(c) for c in measures],
    )


def quarterly_totals(
    df: DataFrame, family: str, day: str, pool: str, strict: str
) -> DataFrame:
    """Counts and money per (family, quarter); strict money null when no strict row."""
    return (
        df.withColumn("period_start", period_of(F.col(day), "quarter"))
        .groupBy(family, "period_start")
        .agg(
            F.count(F.lit(1)).alias("observed_count"),
            F.sum(pool).alias("pool_cents"),
            F.count_if(F.col(strict)).alias("strict_count"),
            F.sum(F.when(F.col(strict), F.col(pool))).alias("strict_pool_cents"),
        )
    )


def quarterly_grid(
    df: DataFrame,
    family: str,
    day: str,
    pool: str,
    strict: str,
    start: str,
    end: str,
    train_end: int,
    validation_end: int,
) -> DataFrame:
    """The forecasting grid: totals on a complete quarter calendar plus splits."""
    grid = complete_grid(
        quarterly_totals(df, family, day, pool, strict),
        family,
        "period_start",
        start,
        end,
        "quarter",
    )
    return grid.withColumns(
        {
            "quarter": quarter_label(F.col("period_start")),
            "target_usd": cents_to_usd(F.col("pool_cents")),
            "strict_target_usd": cents_to_usd(F.col("strict_pool_cents")),
            "period_observed": F.col("observed_count").isNotNull(),
            "split": time_split(F.col("period_start"), train_end, validation_end),
        }
    )


def missing_periods(df: DataFrame, family: str, period: str, step: str) -> DataFrame:
    """Per family: rows, first, last and the list of absent periods in between."""
    return (
        df.groupBy(family, period)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(family)
        .agg(
            F.sum("_n").alias("row_count"),
            F.min(period).alias("first_period"),
            F.max(period).alias("last_period"),
            F.collect_list(period).alias("_seen"),
        )
        .withColumn(
            "missing",
            F.array_sort(
                F.array_except(
                    F.sequence("first_period", "last_period", F.expr(STEPS[step])),
                    F.col("_seen"),
                )
            ),
        )
        .drop("_seen")
    )


def regularity(df: DataFrame, family: str, period: str, step: str) -> DataFrame:
    """Per family: does it hold each period from first to last exactly once?"""
    return (
        df.groupBy(family)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct(period).alias("n_periods"),
            F.min(period).alias("first_period"),
            F.max(period).alias("last_period"),
        )
        .withColumn(
            "expected",
            F.size(
                F.sequence("first_period", "last_period", F.expr(STEPS[step]))
            ).cast("bigint"),
        )
        .withColumn(
            "regular",
            (F.col("n_rows") == F.col("expected"))
            & (F.col("n_periods") == F.col("expected")),
        )
    )
