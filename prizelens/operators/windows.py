"""Series features. Every input here has one row per (family, period), so a
window partition is bounded by the calendar; ranking operators that may see raw
rows keep only their top rows per map task before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prizelens.functions.calendar import shift_period
from prizelens.operators.joins import lookup
from prizelens.operators.quantiles import value_counts_with_start
from prizelens.session import ensure_checkpoint_dir


def series(family: str, period: str):
    return W.partitionBy(family).orderBy(period)


def add_lags(df: DataFrame, family: str, period: str, x: str, lags: Sequence[int]):
    """``lag_k`` on the complete grid, so a gap gives null."""
    at = series(family, period)
    return df.withColumns({f"lag_{k}": F.lag(x, k).over(at) for k in lags})


def add_trailing(
    df: DataFrame, family: str, period: str, x: str, n: int = 4, min_periods: int = 2
) -> DataFrame:
    """Mean, median and sample deviation of the ``n`` previous periods."""
    before = series(family, period).rowsBetween(-n, -1)
    enough = F.count(x).over(before) >= min_periods
    return df.withColumns(
        {
            f"rolling_mean_{n}": F.when(enough, F.avg(x).over(before)),
            f"rolling_median_{n}": F.when(
                enough, F.percentile(F.col(x), F.lit(0.5)).over(before)
            ),
            f"rolling_std_{n}": F.when(enough, F.stddev_samp(x).over(before)),
        }
    )


def time_index(df: DataFrame, family: str, period: str) -> DataFrame:
    return df.withColumn(
        "time_index", F.row_number().over(series(family, period)) - F.lit(1)
    )


def growth(
    df: DataFrame,
    family: str,
    period: str,
    x: str,
    step: str = "month",
    consecutive: bool = False,
) -> DataFrame:
    """Change to the previous row in percent.

    ``consecutive`` demands that the previous row is exactly the previous period
    and positive.
    """
    at = series(family, period)
    previous = F.lag(x).over(at)
    change = F.try_divide(F.col(x) - previous, previous) * F.lit(100.0)
    if consecutive:
        adjacent = shift_period(F.lag(period).over(at), step, 1) == F.col(period)
        change = F.when(adjacent & (previous > 0), change)
    return df.withColumn(f"{x}_growth_pct", change)


def rolling_mean(
    df: DataFrame, family: str, period: str, x: str, n: int = 12, min_periods: int = 6
) -> DataFrame:
    """Mean of this and the ``n - 1`` previous rows."""
    span = series(family, period).rowsBetween(-(n - 1), 0)
    return df.withColumn(
        f"{x}_rolling_{n}",
        F.when(F.count(x).over(span) >= min_periods, F.avg(x).over(span)),
    )


def from_first_observed(df: DataFrame, family: str, period: str, x: str) -> DataFrame:
    """Drop the periods before the family's first non-null value."""
    first = F.min(F.when(F.col(x).isNotNull(), F.col(period))).over(
        W.partitionBy(family)
    )
    return (
        df.withColumn("_first", first).where(F.col(period) >= F.col("_first")).drop("_first")
    )


def share_of(df: DataFrame, within: Sequence[str], x: str, name: str) -> DataFrame:
    """Percent of the group total; null when the total is not positive.

    The totals are a pre-aggregated table joined back, so a group that holds a
    large part of the rows is never sent to one task.
    """
    within = list(within)
    totals = df.groupBy(*within).agg(F.sum(x).alias("_total"))
    return lookup(df, totals, within).withColumn(
        name,
        F.when(F.col("_total") > 0, F.col(x) / F.col("_total") * F.lit(100.0)),
    ).drop("_total")


def top_n(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows per group. Spark limits each map task to ``n`` per group."""
    at = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(at)).where(F.col(rank) <= n)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]):
    """Keep the first row per key in a stated order."""
    return top_n(df, keys, order, 1, "_rank").drop("_rank")


def argmax_by(df: DataFrame, by: Sequence[str], measure: str, tie: str, least=False):
    """The row with the largest (or smallest) measure; ties go to the smaller key."""
    main = F.col(measure).asc_nulls_last() if least else F.col(measure).desc_nulls_last()
    return dedupe_first(df.where(F.col(measure).isNotNull()), by, [main, F.col(tie)])


def avg_rank(df: DataFrame, by: Sequence[str], x: str, name: str) -> DataFrame:
    """Rank with ties sharing the mean rank; null stays null.

    Ranks are worked out on distinct values (see ``quantiles``) and joined back.
    """
    by = list(by)
    ranks = value_counts_with_start(df, by, x).select(
        *by,
        x,
        (F.col("n_smaller") + (F.col("n_equal") + 1) / F.lit(2.0)).alias(name),
    )
    return lookup(df, ranks, [*by, x])


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1..n over the whole table without a single-task window.

    A range-partitioned sort spreads the rows (ties are split by the later sort
    keys); a checkpoint fixes that layout; one count per partition gives the
    offset of each partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = (
        df.orderBy(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    return _number_by_id(placed, name)


def _number_by_id(placed: DataFrame, name: str) -> DataFrame:
    part = F.shiftright(F.col("_id"), 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition: the only window without a key, bounded by task count.
    offsets = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_size").over(
                W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_offset"),
    )
    keyed = placed.withColumn("_part", part)
    return keyed.join(F.broadcast(offsets), "_part").select(
        *[c for c in placed.columns if c != "_id"],
        (
            F.col("_offset") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
        ).alias(name),
    )


# Positions per stretch when a document is cut into pieces of bounded length.
STRETCH = 100_000


def carry_forward(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    col: str,
    name: str,
    stretch: int = STRETCH,
) -> DataFrame:
    """Last non-null value so far in position order (a heading over its items).

    ``by`` is the document, ``pos`` a whole number. A document is cut into
    stretches of positions, so a huge one is spread over many tasks: each stretch
    carries its own values forward, and the last value of the stretches before it
    fills the items ahead of its first one.
    """
    by = list(by)
    keys = [*by, "_stretch"]
    cut = df.withColumn("_stretch", F.floor(F.col(pos) / stretch))
    inside = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn("_local", F.last(col, ignorenulls=True).over(inside))
    known = F.col(col).isNotNull()
    ends = cut.groupBy(*keys).agg(
        F.max_by(F.when(known, F.col(col)), F.when(known, F.col(pos))).alias("_end")
    )
    before = W.partitionBy(*by).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        *keys, F.last("_end", ignorenulls=True).over(before).alias("_before")
    )
    return (
        lookup(local, carried, keys)
        .withColumn(name, F.coalesce("_local", "_before"))
        .drop("_local", "_before", "_stretch")
    )


def surge(
    df: DataFrame, family: str, period: str, x: str, step: str = "month", k: float = 1.5
) -> DataFrame:
    """Rows above the family's upper fence that also grew over the previous period."""
    from prizelens.operators.rules import iqr_fences

    grown = growth(df, family, period, x, step, consecutive=True)
    fences = iqr_fences(df, [family], x, k)
    return (
        lookup(grown, fences, [family])
        .where((F.col(x) > F.col("upper_fence")) & (F.col(f"{x}_growth_pct") > 0))
        .drop("lower_fence", "upper_fence")
    )
