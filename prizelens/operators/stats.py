"""Descriptive statistics, coverage, sensitivity and KPI tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prizelens.operators.joins import lookup, union_all
from prizelens.operators.quantiles import (
    counted_values,
    moments_of_counts,
    quantiles_of_counts,
)
from prizelens.operators.windows import (
    add_lags,
    from_first_observed,
    share_of,
    top_n,
)

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole, null on a zero or null whole."""
    return F.try_divide(part, whole) * F.lit(100.0)


def sum_or_null(col: str) -> Column:
    """Sum that is null when every value is null (Spark's own rule)."""
    return F.sum(col)


# --- roll-ups -----------------------------------------------------------------


def monthly_rollup(
    df: DataFrame,
    family: str,
    day: str,
    pool: str,
    eligible: str,
    note: str,
    version: str,
) -> DataFrame:
    """Game-month money table: counts, sums, flagged rows and versions present.

    ``version`` is a short configured vocabulary, so the joined list is short.
    """
    return (
        df.withColumn("month_start", F.trunc(F.col(day), "month"))
        .groupBy(family, "month_start")
        .agg(
            F.count(F.lit(1)).alias("observed_count"),
            F.count(pool).alias("known_pool_count"),
            F.sum(pool).alias("pool_cents"),
            F.count_if(F.col(eligible)).alias("reconciled_count"),
            F.sum(F.when(F.col(eligible), F.col(pool))).alias("reconciled_pool_cents"),
            F.count_if(F.coalesce(F.col(note), F.lit("")) != "").alias("flagged_count"),
            F.array_join(F.sort_array(F.collect_set(version)), " | ").alias(
                "versions_present"
            ),
        )
    )


def annual_counts(df: DataFrame, family: str, day: str) -> DataFrame:
    return (
        df.groupBy(family, F.year(day).alias("year"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def pivot_counts(df: DataFrame, family: str, day: str, years: Sequence[int]):
    """Family x year matrix with a fixed column list; absent cells are 0."""
    return (
        df.groupBy(family)
        .pivot("year", list(years))
        .count()
        .na.fill(0)
        if "year" in df.columns
        else pivot_counts(df.withColumn("year", F.year(day)), family, day, years)
    )


def value_counts(df: DataFrame, col: str, default: str = "no_flag") -> DataFrame:
    """Rows per value; null and empty text count as ``default``."""
    value = F.coalesce(F.nullif(F.col(col).cast("string"), F.lit("")), F.lit(default))
    return df.groupBy(value.alias(col)).agg(F.count(F.lit(1)).alias("n_rows"))


# --- coverage, share, concentration -------------------------------------------


def coverage(
    df: DataFrame, by: Sequence[str], accepted: Column, money: str
) -> DataFrame:
    """Rows and money in total and accepted, with both percentages."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(accepted).alias("accepted_rows"),
        F.sum(money).alias("total_cents"),
        F.coalesce(F.sum(F.when(accepted, F.col(money))), F.lit(0)).alias(
            "accepted_cents"
        ),
    ).withColumns(
        {
            "money_coverage_pct": pct(F.col("accepted_cents"), F.col("total_cents")),
            "row_coverage_pct": pct(F.col("accepted_rows"), F.col("n_rows")),
        }
    )


def share_by(
    df: DataFrame, keys: Sequence[str], within: Sequence[str], money: str
) -> DataFrame:
    """Money per key and its percent of the surrounding total."""
    sums = df.groupBy(*keys).agg(F.sum(money).alias(money))
    return share_of(sums, within, money, "share_pct")


def country_totals(
    df: DataFrame, family: str, code: str, name: str, money: str
) -> DataFrame:
    """Per (family, code): one name, money, share of the family and rank-ready order."""
    sums = df.groupBy(family, code).agg(
        F.min(name).alias(name), F.sum(money).alias(money)
    )
    return share_of(sums, [family], money, "share_pct")


def topk_share(
    df: DataFrame, by: Sequence[str], money: str, tie: Sequence[str], k: int
) -> DataFrame:
    """Percent of a group's money held by its ``k`` largest rows.

    The total is one pre-aggregated pass; the top rows are limited per map task.
    """
    by = list(by)
    order = [F.col(money).desc_nulls_last(), *[F.col(t) for t in tie]]
    best = top_n(df.select(*by, money, *tie), by, order, k, "_rank")
    heads = best.groupBy(*by).agg(F.sum(money).alias("top_cents"))
    totals = df.groupBy(*by).agg(F.sum(money).alias("total_cents"))
    return (
        totals.join(heads, by)
        .withColumn("top_share_pct", pct(F.col("top_cents"), F.col("total_cents")))
    )


def histogram_pct(
    df: DataFrame,
    by: str,
    x: str,
    bins: int,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """Percent of a family's rows per equal bin; the last bin includes ``high``.

    Without bounds the bins span all values. Rows below ``low`` are bin 0 and rows above
    ``high`` bin ``bins + 1``: they stay and count in the percent base. Null is no value.
    """
    rows = df.where(F.col(x).isNotNull())
    if low is None or high is None:
        ends = rows.agg(F.min(x).cast("double"), F.max(x).cast("double")).first()
        low = (ends[0] or 0.0) if low is None else low
        high = (ends[1] or 0.0) if high is None else high
    value = F.col(x).cast("double")
    width = max((high - low) / bins, 1e-300)
    inside = F.least(F.floor((value - low) / width) + 1, F.lit(bins))
    slot = F.when(value < low, 0).when(value > high, bins + 1).otherwise(inside)
    counts = rows.groupBy(by, slot.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return share_of(counts, [by], "n_rows", "pct_of_family")


# --- description --------------------------------------------------------------


def describe_by(df: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per family and metric.

    All come from one table of distinct values with counts, so the input is read once.
    Whole numbers (cents) stay whole: their moments are exact sums, free of any order.
    """
    types = {df.schema[m].dataType.typeName() for m in metrics}
    kind = "bigint" if types <= {"byte", "short", "integer", "long"} else "double"
    long = df.select(by, *[F.col(m).cast(kind).alias(m) for m in metrics]).unpivot(
        [by], list(metrics), "metric", "value"
    )
    keys = [by, "metric"]
    counts = counted_values(long, keys, "value")
    basics = moments_of_counts(counts, keys, "value")
    return lookup(basics, quantiles_of_counts(counts, keys, "value", QUARTILES), keys)


def robust_summary(df: DataFrame, by: str, x: str) -> DataFrame:
    """size, mean, median, quartiles, max, std and iqr of one measure."""
    table = describe_by(df, by, [x])
    return table.select(
        by,
        F.col("n").alias("size"),
        "mean",
        F.col("q50").alias("median"),
        F.col("q25").alias("q1"),
        F.col("q75").alias("q3"),
        "max",
        "std",
        (F.col("q75") - F.col("q25")).alias("iqr"),
    )


def attention_summary(
    df: DataFrame, family: str, hours: str, average: str, peak: str
) -> DataFrame:
    """Hours add up; averages and peaks do not, so only median and max are given."""
    half = F.lit(0.5)
    return df.groupBy(family).agg(
        F.count(F.lit(1)).alias("periods"),
        F.sum(hours).alias("total_hours"),
        F.percentile(F.col(hours), half).alias("median_hours"),
        F.percentile(F.col(average), half).alias("median_average"),
        F.max(peak).alias("max_peak"),
    )


def missingness(tables: dict[str, DataFrame]) -> DataFrame:
    """Null count and percent per table and column, one pass per table."""
    parts = []
    for name, df in tables.items():
        cols = df.columns
        wide = df.agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.count_if(F.col(c).isNull()).alias(c) for c in cols],
        )
        parts.append(
            wide.unpivot(["_rows"], cols, "column_name", "missing_count").select(
                F.lit(name).alias("table_name"),
                "column_name",
                "missing_count",
                pct(F.col("missing_count"), F.col("_rows")).alias("missing_pct"),
            )
        )
    return union_all(*parts)


def data_dictionary(tables: dict[str, DataFrame]) -> DataFrame:
    """Table, column, type, whether nulls occur, and a unit hint from the suffix."""
    profile = missingness(tables)
    spark = profile.sparkSession
    types = spark.createDataFrame(
        [
            (name, field.name, field.dataType.simpleString())
            for name, df in tables.items()
            for field in df.schema.fields
        ],
        "table_name string, column_name string, data_type string",
    )
    col = F.col("column_name")
    unit = (
        F.when(col.endswith("cents"), "USD cents")
        .when(col.endswith("usd"), "USD")
        .when(col.endswith("pct"), "percent")
        .otherwise("see schema")
    )
    return types.join(profile, ["table_name", "column_name"]).select(
        "table_name",
        "column_name",
        "data_type",
        (F.col("missing_count") > 0).alias("has_nulls"),
        unit.alias("unit_hint"),
    )


# --- correlation --------------------------------------------------------------


def pearson(x: str, y: str) -> Column:
    """Correlation that is null, not an error, on zero variance.

    Both columns must already be null together.
    """
    return F.try_divide(
        F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)
    )


def series_rank(x: str, *part: str) -> Column:
    """Tie-averaged rank inside a series; null stays null.

    For tables with one row per (family, period): the window is as long as the
    calendar. Raw rows are ranked by ``windows.avg_rank``.
    """
    place = F.rank().over(W.partitionBy(*part).orderBy(F.col(x).asc_nulls_last()))
    ties = F.count(F.lit(1)).over(W.partitionBy(*part, x))
    rank = place.cast("double") + (ties.cast("double") - 1) / F.lit(2.0)
    return F.when(F.col(x).isNotNull(), rank)


def corr_by(
    df: DataFrame,
    by: str,
    pairs: Sequence[tuple[str, str, str]],
    method: str = "pearson",
) -> DataFrame:
    """Correlations per family over rows complete in every named measure.

    ``pairs`` holds (output, x, y); ``df`` has one row per (family, period). One
    shuffle by family serves the ranks and the aggregate.
    """
    cols = sorted({c for _, x, y in pairs for c in (x, y)})
    rows = df.select(by, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(
        subset=cols
    )
    if method == "spearman":
        rows = rows.select(by, *[series_rank(c, by).alias(c) for c in cols])
    elif method != "pearson":
        raise ValueError("method must be pearson or spearman")
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), *[pearson(x, y).alias(o) for o, x, y in pairs]
    ).withColumn("method", F.lit(method))


def corr_trimmed(df: DataFrame, by: str, x: str, y: str, k: float = 1.5) -> DataFrame:
    """Both correlations on all rows and on rows inside both fences.

    Fewer than three rows or no variance gives null. ``df`` has one row per
    (family, period); everything runs on one shuffle by family.
    """
    rows = df.select(
        by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    ).dropna(subset=["_x", "_y"])
    family = W.partitionBy(by)
    inside = F.lit(True)
    for c in ("_x", "_y"):
        q = F.percentile(F.col(c), F.array(F.lit(0.25), F.lit(0.75))).over(family)
        spread = F.lit(k) * (q[1] - q[0])
        inside = inside & F.col(c).between(q[0] - spread, q[1] + spread)
    rows = rows.withColumn("_in", inside)
    rows = rows.withColumns(
        {
            "_rx": series_rank("_x", by),
            "_ry": series_rank("_y", by),
            "_tx": series_rank("_x", by, "_in"),
            "_ty": series_rank("_y", by, "_in"),
        }
    )
    kept = {c: F.when(F.col("_in"), F.col(c)) for c in ("_x", "_y", "_tx", "_ty")}
    rows = rows.withColumns({f"_k{c}": v for c, v in kept.items()})
    wide = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if("_in").alias("n_in"),
        pearson("_x", "_y").alias("p_all"),
        pearson("_rx", "_ry").alias("s_all"),
        pearson("_k_x", "_k_y").alias("p_in"),
        pearson("_k_tx", "_k_ty").alias("s_in"),
    )
    entries = [
        F.struct(
            F.lit(sample).alias("sample"),
            F.lit(method).alias("method"),
            F.col(f"n_{part}").alias("n"),
            F.when(F.col(f"n_{part}") >= 3, F.col(f"{letter}_{part}")).alias("corr"),
        )
        for sample, part in (("all_rows", "all"), ("inside_fences", "in"))
        for method, letter in (("pearson", "p"), ("spearman", "s"))
    ]
    return wide.select(by, F.inline(F.array(*entries))).where(F.col("n") > 0)


def autocorr_by(
    df: DataFrame, family: str, period: str, x: str, lags: Sequence[int]
) -> DataFrame:
    """Autocorrelation of a grid at each lag over pairs where both are present."""
    lagged = add_lags(df, family, period, x, lags)
    parts = []
    for k in lags:
        other = f"lag_{k}"
        both = F.col(x).isNotNull() & F.col(other).isNotNull()
        rows = lagged.select(
            family,
            F.when(both, F.col(x)).alias("_x"),
            F.when(both, F.col(other)).alias("_y"),
            F.col(x),
        )
        parts.append(
            rows.groupBy(family).agg(
                F.lit(k).cast("int").alias("lag"),
                pearson("_x", "_y").alias("autocorrelation"),
                F.count(x).alias("observed_periods"),
            )
        )
    return union_all(*parts)


# --- sensitivity --------------------------------------------------------------


def quality_sensitivity(
    df: DataFrame, by: Sequence[str], strict: str, money: str
) -> DataFrame:
    """All rows against strict rows in one pass."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("all_rows"),
        F.sum(money).alias("all_cents"),
        F.count_if(F.col(strict)).alias("strict_rows"),
        F.sum(F.when(F.col(strict), F.col(money))).alias("strict_cents"),
    ).withColumns(
        {
            "strict_money_pct": pct(F.col("strict_cents"), F.col("all_cents")),
            "strict_rows_pct": pct(F.col("strict_rows"), F.col("all_rows")),
        }
    )


def split_sensitivity(
    grid: DataFrame, family: str, period: str, target: str, strict: str
) -> DataFrame:
    """Source against strict money per split and family, plus Overall rows.

    Only periods from the family's first observed one count.
    """
    rows = from_first_observed(grid, family, period, target)
    out = rows.groupingSets(
        [["split", family], ["split"]], "split", family
    ).agg(
        F.count(F.lit(1)).alias("total_periods"),
        F.count(target).alias("observed_periods"),
        F.count_if(F.col(target).isNull()).alias("missing_periods"),
        F.sum(target).alias("source_total"),
        F.sum(strict).alias("strict_total"),
        F.grouping(family).alias("_overall"),
    )
    return out.select(
        "split",
        F.when(F.col("_overall") == 1, F.lit("Overall"))
        .otherwise(F.col(family))
        .alias(family),
        "total_periods",
        "observed_periods",
        "missing_periods",
        "source_total",
        "strict_total",
        pct(F.col("strict_total"), F.col("source_total")).alias("strict_share_pct"),
    )


def readiness(
    grid: DataFrame, family: str, period: str, target: str
) -> DataFrame:
    """Forecast readiness of each series from its first observed period.

    The grid is calendar-bounded, so ``percentile`` holds one series at a time.
    """
    rows = from_first_observed(grid, family, period, target)
    train = F.when(F.col("split") == "train", F.col(target))
    return rows.groupBy(family).agg(
        F.min(period).alias("first_observed_period"),
        F.max(period).alias("last_period"),
        F.count(F.lit(1)).alias("periods"),
        F.count_if(F.col(target).isNull()).alias("missing_periods"),
        F.count_if(F.col(target) == 0).alias("zero_periods"),
        F.percentile(train, F.lit(0.5)).alias("train_median"),
        F.percentile(train, F.lit(0.95)).alias("train_p95"),
        *[
            F.count(F.when(F.col("split") == s, F.col(target))).alias(f"{s}_observed")
            for s in ("train", "validation", "test")
        ],
    ).withColumn("needs_missing_policy", F.col("missing_periods") > 0)


def forecast_status(
    grid: DataFrame, family: str, label: str, target: str, split: str = "test"
) -> DataFrame:
    """Missing periods of the test split and a status per family."""
    absent = F.when(
        (F.col("split") == split) & F.col(target).isNull(), F.col(label)
    )
    return grid.groupBy(family).agg(
        F.array_join(F.sort_array(F.collect_list(absent)), " | ").alias(
            "missing_test_periods"
        )
    ).withColumns(
        {
            "test_complete": F.col("missing_test_periods") == "",
            "status": F.when(
                F.col("missing_test_periods") == "",
                F.lit("structurally_complete_but_source_coverage_unverified"),
            ).otherwise(F.lit("blocked_test_missing_observations")),
        }
    )


# --- seasonality --------------------------------------------------------------


def seasonality(
    grid: DataFrame, family: str, part: Column, part_name: str, x: str
) -> DataFrame:
    """Mean, median and count of a measure by part of the year (train rows)."""
    return (
        grid.where(F.col("split") == "train")
        .groupBy(family, part.alias(part_name))
        .agg(
            F.try_divide(F.sum(x), F.count(x)).alias("mean"),
            F.percentile(F.col(x), F.lit(0.5)).alias("median"),
            F.count(x).alias("n"),
        )
    )


def seasonal_matrix(
    df: DataFrame, family: str, part: Column, values: Sequence[int], x: str
) -> DataFrame:
    """Family x part-of-year matrix of medians with fixed columns."""
    return (
        df.withColumn("_part", part)
        .groupBy(family)
        .pivot("_part", list(values))
        .agg(F.percentile(F.col(x), F.lit(0.5)))
    )


# --- small summaries ----------------------------------------------------------


def pair_availability(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("periods"),
        F.count_if(complete).alias("complete_pairs"),
        F.count_if(~complete).alias("incomplete"),
    )


def identity_summary(df: DataFrame, parent: str, status: str) -> DataFrame:
    bad = F.col(status) == "ambiguous_source_id"
    return df.agg(
        F.count_if(bad).alias("ambiguous_rows"),
        F.count_distinct(F.when(bad, F.col(parent))).alias("ambiguous_parents"),
    )


def run_summary(df: DataFrame, code: str) -> DataFrame:
    """Rows per code, and one row without code for all (``is_total``)."""
    out = df.groupingSets([[code], []], code).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.grouping(code) == 1).alias("is_total")
    )
    return out.select(code, "is_total", "n_rows")


def discovery_coverage(
    listed: DataFrame,
    audit: DataFrame,
    found: DataFrame,
    key: str,
    item: str,
    status: str,
    done: str,
    reported_total: DataFrame,
) -> DataFrame:
    """One row on how much of a listing was worked through.

    ``audit`` holds one row per key; ``reported_total`` is a one-row table whose
    ``reported`` column is the source's own total.
    """
    state = (
        listed.select(key)
        .distinct()
        .join(audit.select(key, status), key, "left")
        .agg(
            F.count(F.lit(1)).alias("listed"),
            F.count_if(F.col(status) == done).alias("done"),
            F.count_if(F.col(status).isNull()).alias("pending"),
            F.count_if(F.col(status).isNotNull() & (F.col(status) != done)).alias(
                "issues"
            ),
        )
    )
    items = found.agg(
        F.count(F.lit(1)).alias("item_rows"),
        F.count_distinct(item).alias("distinct_items"),
    )
    one = F.lit(1).alias("_one")
    return (
        state.select("*", one)
        .join(items.select("*", one), "_one")
        .join(reported_total.select("reported", one), "_one")
        .drop("_one")
        .withColumns(
            {
                "duplicate_item_rows": F.col("item_rows") - F.col("distinct_items"),
                "found_minus_reported": F.col("distinct_items") - F.col("reported"),
            }
        )
    )


def section_profile(df: DataFrame, section: str, event: str, item: str) -> DataFrame:
    return df.groupBy(section).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(event).alias("distinct_events"),
        F.count_distinct(item).alias("distinct_items"),
    )


def consolidate_urls(df: DataFrame, url: str, source: str) -> DataFrame:
    """One row per URL and source: its observations, those of the URL, and the number of
    sources the URL has. A URL of any number of sources is rows, never one cell."""
    pairs = df.groupBy(url, source).agg(F.count(F.lit(1)).alias("observations"))
    urls = pairs.groupBy(url).agg(
        F.sum("observations").alias("url_observations"), F.count(F.lit(1)).alias("n_sources")
    )
    return lookup(pairs, urls, [url], "inner")
