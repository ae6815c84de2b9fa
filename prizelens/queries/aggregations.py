"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from prizelens.functions.calendar import time_split
from prizelens.functions.money import log10p1
from prizelens.operators import reconcile as rec
from prizelens.operators import scoring as sc
from prizelens.operators import stats as st
from prizelens.operators.grid import missing_periods
from prizelens.operators.rules import null_ambiguous_ids
from prizelens.operators.windows import argmax_by, top_n
from prizelens.plans.release import Release, kpi_table
from prizelens.queries.registry import query
from prizelens.queries.shapes import (
    ATTENTION,
    BREAKDOWN,
    CHILDREN,
    GRID,
    MONTHS,
    OWNER_COUNTRY,
    PANEL,
    PARENTS,
    POOLS,
    PREDICTIONS,
    USER_DAYS,
    USER_GRID,
    attention,
    breakdown,
    children,
    grid,
    long_predictions,
    months,
    owner_country,
    panel,
    parents,
    pools,
    table,
    user_days,
    user_grid,
)


def rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(
    "a01_monthly_rollup",
    f"""
    WITH {PARENTS}
    SELECT family, CAST(date_trunc('month', start_date) AS DATE) AS month_start, count(*) AS observed_count,
           count(pool_cents) AS known_pool_count, CAST(sum(pool_cents) AS BIGINT) AS pool_cents,
           count(*) FILTER (eligible) AS reconciled_count,
           CAST(sum(pool_cents) FILTER (eligible) AS BIGINT) AS reconciled_pool_cents,
           count(*) FILTER (quality_note IS NOT NULL) AS flagged_count,
           string_agg(DISTINCT version, ' | ' ORDER BY version) AS versions_present
    FROM parents GROUP BY ALL
    """,
)
def monthly_rollup(spark, sf):
    return st.monthly_rollup(
        parents(spark, sf), "family", "start_date", "pool_cents", "eligible",
        "quality_note", "version",
    )


@query(
    "a02_quarterly_rollup",
    f"""
    WITH {GRID}
    SELECT family, quarter, split, period_observed, observed_count, pool_cents, strict_count, strict_pool_cents
    FROM grid
    """,
)
def quarterly_rollup(spark, sf):
    return grid(spark, sf).select(
        "family", "quarter", "split", "period_observed", "observed_count", "pool_cents",
        "strict_count", "strict_pool_cents",
    )


@query(
    "a03_annual_counts",
    f"WITH {PARENTS} SELECT family, CAST(year(start_date) AS INTEGER) AS year, count(*) AS n_rows FROM parents GROUP BY ALL",
)
def annual_counts(spark, sf):
    return st.annual_counts(parents(spark, sf), "family", "start_date")


@query(
    "a04_null_preserving_sum",
    f"WITH {USER_GRID} SELECT family, CAST(sum(hours) FILTER (day > DATE '2024-01-28') AS BIGINT) AS late_hours FROM user_grid GROUP BY family",
)
def null_preserving_sum(spark, sf):
    late = F.when(F.col("day") > "2024-01-28", F.col("hours"))
    return (
        user_grid(spark, sf)
        .withColumn("late", late)
        .groupBy("family")
        .agg(st.sum_or_null("late").alias("late_hours"))
    )


@query(
    "a05_coverage",
    f"""
    WITH {OWNER_COUNTRY}
    SELECT family, year, count(*) AS n_rows, count(*) FILTER (eligible) AS accepted_rows,
           CAST(sum(pool_cents) AS BIGINT) AS total_cents,
           CAST(coalesce(sum(pool_cents) FILTER (eligible), 0) AS BIGINT) AS accepted_cents,
           round(coalesce(sum(pool_cents) FILTER (eligible), 0) / sum(pool_cents) * 100, 6) AS money_coverage_pct,
           round(count(*) FILTER (eligible) / count(*) * 100, 6) AS row_coverage_pct
    FROM owner_country GROUP BY family, year
    """,
)
def coverage(spark, sf):
    rows = parents(spark, sf).withColumn("year", F.year("start_date"))
    out = st.coverage(rows, ["family", "year"], F.col("eligible"), "pool_cents")
    return rounded(out, 6, "money_coverage_pct", "row_coverage_pct")


@query(
    "a06_country_year_share",
    f"""
    WITH {OWNER_COUNTRY}
    SELECT family, year, country_code, CAST(sum(pool_cents) AS BIGINT) AS pool_cents,
           round(sum(pool_cents) / sum(sum(pool_cents)) OVER (PARTITION BY family, year) * 100, 6) AS share_pct
    FROM owner_country GROUP BY family, year, country_code
    """,
)
def country_year_share(spark, sf):
    out = st.share_by(
        owner_country(spark, sf), ["family", "year", "country_code"], ["family", "year"],
        "pool_cents",
    )
    return rounded(out, 6, "share_pct")


@query(
    "a07_country_totals",
    f"""
    WITH {OWNER_COUNTRY}
    SELECT * FROM (SELECT family, country_code, min(country_name) AS country_name,
           CAST(sum(pool_cents) AS BIGINT) AS pool_cents,
           round(sum(pool_cents) / sum(sum(pool_cents)) OVER (PARTITION BY family) * 100, 6) AS share_pct,
           CAST(row_number() OVER (PARTITION BY family ORDER BY sum(pool_cents) DESC, country_code) AS INTEGER) AS rank
    FROM owner_country GROUP BY family, country_code) WHERE rank <= 5
    """,
)
def country_totals(spark, sf):
    out = st.country_totals(
        owner_country(spark, sf), "family", "country_code", "country_name", "pool_cents"
    )
    best = top_n(out, ["family"], [F.col("pool_cents").desc(), F.col("country_code")], 5)
    return rounded(best, 6, "share_pct")


DESCRIBE = """SELECT {key} AS family, '{m}' AS metric, count({m}) AS n, round(sum({m}) / count({m}), 3) AS mean,
    round(stddev_samp({m}), 2) AS std, CAST(min({m}) AS DOUBLE) AS min, CAST(max({m}) AS DOUBLE) AS max,
    round(quantile_cont({m}, 0.25), 3) AS q25, round(quantile_cont({m}, 0.5), 3) AS q50,
    round(quantile_cont({m}, 0.75), 3) AS q75 FROM {t} GROUP BY {key}"""


@query(
    "a08_describe",
    f"WITH {CHILDREN} "
    + " UNION ALL ".join(
        DESCRIBE.format(key="flag", m=m, t="children") for m in ("prize_cents", "quantity")
    ),
)
def describe(spark, sf):
    rows = children(spark, sf).withColumnRenamed("flag", "family")
    out = st.describe_by(rows, "family", ["prize_cents", "quantity"])
    return rounded(rounded(out, 3, "mean", "q25", "q50", "q75"), 2, "std")


@query(
    "a09_robust_summary",
    f"""
    WITH {PARENTS}
    SELECT family, count(*) AS size, round(sum(pool_cents) / count(*), 3) AS mean,
           round(quantile_cont(pool_cents, 0.5), 3) AS median, round(quantile_cont(pool_cents, 0.25), 3) AS q1,
           round(quantile_cont(pool_cents, 0.75), 3) AS q3, CAST(max(pool_cents) AS DOUBLE) AS max,
           round(stddev_samp(pool_cents), 2) AS std,
           round(quantile_cont(pool_cents, 0.75) - quantile_cont(pool_cents, 0.25), 3) AS iqr
    FROM parents GROUP BY family
    """,
)
def robust_summary(spark, sf):
    out = st.robust_summary(parents(spark, sf), "family", "pool_cents")
    return rounded(rounded(out, 3, "mean", "median", "q1", "q3", "iqr"), 2, "std")


@query(
    "a10_attention_summary",
    f"""
    WITH {ATTENTION}
    SELECT family, count(*) AS periods, CAST(sum(hours) AS BIGINT) AS total_hours,
           round(quantile_cont(hours, 0.5), 3) AS median_hours, round(quantile_cont(average, 0.5), 3) AS median_average,
           max(peak) AS max_peak FROM attention GROUP BY family
    """,
)
def attention_summary(spark, sf):
    out = st.attention_summary(attention(spark, sf), "family", "hours", "average", "peak")
    return rounded(out, 3, "median_hours", "median_average")


MISSING = """SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing_count,
    round(count(*) FILTER ({c} IS NULL) / count(*) * 100, 6) AS missing_pct FROM {t}"""


@query(
    "a11_missingness",
    f"WITH {PARENTS}, {PANEL} "
    + " UNION ALL ".join(
        MISSING.format(t=t, c=c)
        for t, cols in {
            "parents": "parent_id quality_note pool_cents",
            "panel": "family day hours pool tournaments",
        }.items()
        for c in cols.split()
    ),
)
def missingness(spark, sf):
    out = st.missingness(
        {
            "parents": parents(spark, sf).select("parent_id", "quality_note", "pool_cents"),
            "panel": panel(spark, sf),
        }
    )
    return rounded(out, 6, "missing_pct")


PAIRS = [("hours_vs_pool", "hours", "pool"), ("hours_vs_tournaments", "hours", "tournaments")]
COMPLETE = "c AS (SELECT * FROM panel WHERE hours IS NOT NULL AND pool IS NOT NULL AND tournaments IS NOT NULL)"
SAFE_CORR = """CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0
    THEN round(covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})), 5) END"""


def _corr(x, y):
    return SAFE_CORR.format(x=x, y=y)


@query(
    "a12_pearson",
    f"""
    WITH {PANEL}, {COMPLETE}
    SELECT family, count(*) AS n, {_corr('hours', 'pool')} AS hours_vs_pool,
           {_corr('hours', 'tournaments')} AS hours_vs_tournaments, 'pearson' AS method FROM c GROUP BY family
    """,
)
def pearson(spark, sf):
    out = st.corr_by(panel(spark, sf), "family", PAIRS)
    return rounded(out, 5, "hours_vs_pool", "hours_vs_tournaments")


RANKED = """r AS (SELECT family,
    rank() OVER (PARTITION BY family ORDER BY hours) + (count(*) OVER (PARTITION BY family, hours) - 1) / 2 AS hours,
    rank() OVER (PARTITION BY family ORDER BY pool) + (count(*) OVER (PARTITION BY family, pool) - 1) / 2 AS pool,
    rank() OVER (PARTITION BY family ORDER BY tournaments)
      + (count(*) OVER (PARTITION BY family, tournaments) - 1) / 2 AS tournaments FROM c)"""


@query(
    "a13_spearman",
    f"""
    WITH {PANEL}, {COMPLETE}, {RANKED}
    SELECT family, count(*) AS n, {_corr('hours', 'pool')} AS hours_vs_pool,
           {_corr('hours', 'tournaments')} AS hours_vs_tournaments, 'spearman' AS method FROM r GROUP BY family
    """,
)
def spearman(spark, sf):
    out = st.corr_by(panel(spark, sf), "family", PAIRS, "spearman")
    return rounded(out, 5, "hours_vs_pool", "hours_vs_tournaments")


@query(
    "a14_quality_sensitivity",
    f"""
    WITH {PARENTS}
    SELECT family, count(*) AS all_rows, CAST(sum(pool_cents) AS BIGINT) AS all_cents,
           count(*) FILTER (strict) AS strict_rows, CAST(sum(pool_cents) FILTER (strict) AS BIGINT) AS strict_cents,
           round(sum(pool_cents) FILTER (strict) / sum(pool_cents) * 100, 6) AS strict_money_pct,
           round(count(*) FILTER (strict) / count(*) * 100, 6) AS strict_rows_pct
    FROM parents GROUP BY family
    """,
)
def quality_sensitivity(spark, sf):
    out = st.quality_sensitivity(parents(spark, sf), ["family"], "strict", "pool_cents")
    return rounded(out, 6, "strict_money_pct", "strict_rows_pct")


@query(
    "a15_split_sensitivity",
    f"""
    WITH {GRID}, e AS (SELECT * FROM (SELECT *, min(CASE WHEN target_usd IS NOT NULL THEN period_start END)
        OVER (PARTITION BY family) AS f FROM grid) WHERE period_start >= f)
    SELECT split, CASE WHEN grouping(family) = 1 THEN 'Overall' ELSE family END AS family,
           count(*) AS total_periods, count(target_usd) AS observed_periods,
           count(*) - count(target_usd) AS missing_periods, round(sum(target_usd), 2) AS source_total,
           round(sum(strict_target_usd), 2) AS strict_total,
           round(sum(strict_target_usd) / sum(target_usd) * 100, 6) AS strict_share_pct
    FROM e GROUP BY GROUPING SETS ((split, family), (split))
    """,
)
def split_sensitivity(spark, sf):
    out = st.split_sensitivity(
        grid(spark, sf), "family", "period_start", "target_usd", "strict_target_usd"
    )
    return rounded(rounded(out, 2, "source_total", "strict_total"), 6, "strict_share_pct")


TRIM_RANKS = """{o} AS (SELECT family,
    rank() OVER (PARTITION BY family ORDER BY hours) + (count(*) OVER (PARTITION BY family, hours) - 1) / 2 AS hours,
    rank() OVER (PARTITION BY family ORDER BY pool) + (count(*) OVER (PARTITION BY family, pool) - 1) / 2 AS pool
    FROM {i})"""
TRIM_OUT = """SELECT family, '{sample}' AS sample, '{method}' AS method, count(*) AS n,
    CASE WHEN count(*) >= 3 THEN {corr} END AS corr FROM {t} GROUP BY family"""


@query(
    "a16_trimmed_correlation",
    f"""
    WITH {PANEL}, c AS (SELECT * FROM panel WHERE hours IS NOT NULL AND pool IS NOT NULL),
    q AS (SELECT family, quantile_cont(hours, 0.25) AS h1, quantile_cont(hours, 0.75) AS h3,
          quantile_cont(pool, 0.25) AS p1, quantile_cont(pool, 0.75) AS p3 FROM c GROUP BY family),
    i AS (SELECT family, hours, pool FROM c JOIN q USING (family)
          WHERE hours BETWEEN h1 - 1.5 * (h3 - h1) AND h3 + 1.5 * (h3 - h1)
            AND pool BETWEEN p1 - 1.5 * (p3 - p1) AND p3 + 1.5 * (p3 - p1)),
    {TRIM_RANKS.format(o='cr', i='c')}, {TRIM_RANKS.format(o='ir', i='i')}
    """
    + " UNION ALL ".join(
        TRIM_OUT.format(sample=s, method=m, t=t, corr=_corr("hours", "pool"))
        for s, m, t in [
            ("all_rows", "pearson", "c"), ("all_rows", "spearman", "cr"),
            ("inside_fences", "pearson", "i"), ("inside_fences", "spearman", "ir"),
        ]
    ),
)
def trimmed_correlation(spark, sf):
    return rounded(st.corr_trimmed(panel(spark, sf), "family", "hours", "pool"), 5, "corr")


@query(
    "a17_autocorrelation",
    f"""
    WITH {GRID}, t AS (SELECT * FROM (SELECT *, min(CASE WHEN target_usd IS NOT NULL THEN period_start END)
        OVER (PARTITION BY family) AS f FROM grid) WHERE period_start >= f AND split = 'train'),
    l AS (SELECT family, target_usd AS x, lag(target_usd, 1) OVER w AS y1, lag(target_usd, 4) OVER w AS y4
          FROM t WINDOW w AS (PARTITION BY family ORDER BY period_start))
    SELECT family, 1 AS lag, round(corr(x, y1), 6) AS autocorrelation, count(x) AS observed_periods FROM l GROUP BY family
    UNION ALL SELECT family, 4, round(corr(x, y4), 6), count(x) FROM l GROUP BY family
    """,
)
def autocorrelation(spark, sf):
    from prizelens.operators.windows import from_first_observed

    g = from_first_observed(grid(spark, sf), "family", "period_start", "target_usd")
    out = st.autocorr_by(
        g.where(F.col("split") == "train"), "family", "period_start", "target_usd", [1, 4]
    )
    return rounded(out, 6, "autocorrelation")


@query(
    "a18_model_scores",
    f"""
    WITH {PREDICTIONS}, e AS (SELECT *, CASE WHEN evaluation_available THEN actual_usd END AS a,
        CASE WHEN evaluation_available THEN residual_usd END AS r FROM long)
    SELECT target_policy, split, model, CASE WHEN grouping(family) = 1 THEN 'Overall' ELSE family END AS family,
           count(*) AS n_total, count(a) AS n_evaluated, round(avg(abs(r)), 6) AS mae_usd,
           round(sqrt(avg(r * r)), 6) AS rmse_usd, round(count(a) / count(*) * 100, 6) AS coverage_pct,
           CASE WHEN count(a) >= 4 THEN round(1 - sum(r * r) / (var_pop(a) * count(a)), 5) END AS r2_diagnostic
    FROM e GROUP BY GROUPING SETS ((target_policy, split, model, family), (target_policy, split, model))
    """,
)
def model_scores(spark, sf):
    out = sc.score(long_predictions(spark, sf), ["target_policy", "split", "model"], "family")
    return rounded(
        rounded(rounded(out, 6, "mae_usd", "rmse_usd"), 6, "coverage_pct"), 5, "r2_diagnostic"
    )


@query(
    "a19_forecast_summary",
    f"""
    WITH {PREDICTIONS}
    SELECT target_policy, split, model, model_label,
           CASE WHEN grouping(family) = 1 THEN 'Overall' ELSE family END AS family,
           count(*) AS total_periods, count(*) FILTER (evaluation_available) AS evaluated_periods,
           round(sum(actual_usd) FILTER (evaluation_available), 6) AS actual_usd,
           round(sum(predicted_usd) FILTER (evaluation_available), 6) AS predicted_evaluated_usd,
           round(sum(predicted_usd), 6) AS predicted_all_usd, round(avg(residual_usd), 6) AS mean_residual_usd,
           round(avg(abs(residual_usd)), 6) AS mae_usd, round(sqrt(avg(residual_usd ** 2)), 6) AS rmse_usd,
           round(count(*) FILTER (evaluation_available) / count(*) * 100, 6) AS coverage_pct
    FROM long GROUP BY GROUPING SETS ((target_policy, split, model, model_label, family),
                                      (target_policy, split, model, model_label))
    """,
)
def forecast_summary(spark, sf):
    out = sc.forecast_summary(
        long_predictions(spark, sf), ["target_policy", "split", "model", "model_label"], "family"
    )
    money = [c for c in out.columns if c.endswith("_usd")]
    return rounded(rounded(out, 6, *money), 6, "coverage_pct")


BASELINE_SQL = f"""
    WITH {GRID}, p AS (SELECT *, lag(target_usd, 4) OVER (PARTITION BY family ORDER BY period_start) AS prediction FROM grid)
    SELECT family, split, count(prediction - target_usd) AS n, round(avg(abs(prediction - target_usd)), 6) AS mae,
           round(sqrt(avg((prediction - target_usd) ** 2)), 6) AS rmse
    FROM p WHERE split <> 'train' GROUP BY ALL
    """


@query("a20_baseline_scores", BASELINE_SQL)
def baseline_scores(spark, sf):
    predicted = sc.seasonal_naive(grid(spark, sf), "family", "period_start", "target_usd", 4)
    rows = predicted.where(F.col("split") != "train")
    return rounded(sc.baseline_scores(rows, ["family", "split"], "target_usd"), 6, "mae", "rmse")


@query(
    "a20_monthly_baseline_scores",
    f"""
    WITH {MONTHS}, s AS (SELECT *, CASE WHEN year(month_start) <= 1999 THEN 'train'
        WHEN year(month_start) <= 2000 THEN 'validation' ELSE 'test' END AS split FROM months),
    u AS (SELECT family, month_start, split, 'n_rows' AS metric, CAST(n_rows AS DOUBLE) AS x FROM s
          UNION ALL SELECT family, month_start, split, 'pool_cents', CAST(pool_cents AS DOUBLE) FROM s),
    p AS (SELECT *, lag(x, 12) OVER (PARTITION BY family, metric ORDER BY month_start) AS y FROM u)
    SELECT family, metric, split, count(y - x) AS n, round(avg(abs(y - x)), 6) AS mae,
           round(sqrt(avg((y - x) ** 2)), 6) AS rmse FROM p WHERE split <> 'train' GROUP BY ALL
    """,
)
def monthly_baseline_scores(spark, sf):
    series = months(spark, sf).withColumn("split", time_split(F.col("month_start"), 1999, 2000))
    parts = []
    for metric in ("n_rows", "pool_cents"):
        predicted = sc.seasonal_naive(series, "family", "month_start", metric, 12)
        scores = sc.baseline_scores(
            predicted.where(F.col("split") != "train"), ["family", "split"], metric
        )
        parts.append(scores.withColumn("metric", F.lit(metric)))
    return rounded(st.union_all(*parts), 6, "mae", "rmse")


@query(
    "a21_readiness",
    f"""
    WITH {GRID}, e AS (SELECT * FROM (SELECT *, min(CASE WHEN target_usd IS NOT NULL THEN period_start END)
        OVER (PARTITION BY family) AS f FROM grid) WHERE period_start >= f)
    SELECT family, min(period_start) AS first_observed_period, max(period_start) AS last_period, count(*) AS periods,
           count(*) - count(target_usd) AS missing_periods, count(*) FILTER (target_usd = 0) AS zero_periods,
           round(quantile_cont(target_usd, 0.5) FILTER (split = 'train'), 4) AS train_median,
           round(quantile_cont(target_usd, 0.95) FILTER (split = 'train'), 4) AS train_p95,
           count(target_usd) FILTER (split = 'train') AS train_observed,
           count(target_usd) FILTER (split = 'validation') AS validation_observed,
           count(target_usd) FILTER (split = 'test') AS test_observed,
           count(*) > count(target_usd) AS needs_missing_policy
    FROM e GROUP BY family
    """,
)
def readiness(spark, sf):
    out = st.readiness(grid(spark, sf), "family", "period_start", "target_usd")
    return rounded(out, 4, "train_median", "train_p95")


@query(
    "a22_forecast_status",
    f"""
    WITH {GRID}
    SELECT family, m AS missing_test_periods, m = '' AS test_complete,
           CASE WHEN m = '' THEN 'structurally_complete_but_source_coverage_unverified'
                ELSE 'blocked_test_missing_observations' END AS status
    FROM (SELECT family, coalesce(string_agg(quarter, ' | ' ORDER BY quarter)
            FILTER (split = 'test' AND target_usd IS NULL), '') AS m FROM grid GROUP BY family)
    """,
)
def forecast_status(spark, sf):
    return st.forecast_status(grid(spark, sf), "family", "quarter", "target_usd")


@query(
    "a23_data_dictionary",
    f"""
    WITH {PARENTS}, {PANEL}
    SELECT 'parents' AS table_name, * FROM (VALUES
      ('parent_id', 'bigint', (SELECT count(*) > count(parent_id) FROM parents), 'see schema'),
      ('pool_cents', 'bigint', (SELECT count(*) > count(pool_cents) FROM parents), 'USD cents'),
      ('quality_note', 'string', (SELECT count(*) > count(quality_note) FROM parents), 'see schema'))
      v(column_name, data_type, has_nulls, unit_hint)
    UNION ALL SELECT 'panel', * FROM (VALUES
      ('day', 'date', false, 'see schema'), ('pool', 'bigint', (SELECT count(*) > count(pool) FROM panel), 'see schema'))
    """,
)
def data_dictionary(spark, sf):
    return st.data_dictionary(
        {
            "parents": parents(spark, sf).select("parent_id", "pool_cents", "quality_note"),
            "panel": panel(spark, sf).select("day", "pool"),
        }
    )


STATUS_SQL = """CASE WHEN d = 0 THEN 'matched' WHEN abs(d) <= 2 THEN 'rounding_difference'
    WHEN d IS NOT NULL THEN 'needs_review' END"""


@query(
    "a24_reconciliation",
    f"""
    WITH {CHILDREN}, {POOLS}, s AS (SELECT parent_id, CAST(sum(prize_cents) AS BIGINT) AS child_cents,
        count(*) AS child_rows FROM children GROUP BY parent_id)
    SELECT *, {STATUS_SQL.replace('d ', 'diff_cents ').replace('(d)', '(diff_cents)')} AS status FROM (
      SELECT parent_id, pool_cents, child_cents, child_rows, child_cents - pool_cents AS diff_cents
      FROM pools LEFT JOIN s USING (parent_id))
    """,
)
def reconciliation(spark, sf):
    return rec.reconcile(
        pools(spark, sf), children(spark, sf), "parent_id", "pool_cents", "prize_cents"
    )


@query(
    "a24_reconciliation_of_orders",
    f"""
    WITH {PARENTS}, {CHILDREN}
    SELECT family, CASE WHEN d = 0 THEN 'matched' WHEN abs(d) <= 2 THEN 'rounding_difference'
        WHEN d IS NOT NULL THEN 'needs_review' END AS status, count(*) AS n_rows
    FROM (SELECT family, s - pool_cents AS d FROM parents LEFT JOIN (
        SELECT parent_id, sum(prize_cents) AS s FROM children GROUP BY parent_id) USING (parent_id)) GROUP BY ALL
    """,
)
def reconciliation_of_orders(spark, sf):
    out = rec.reconcile(
        parents(spark, sf), children(spark, sf), "parent_id", "pool_cents", "prize_cents"
    )
    return out.groupBy("family", "status").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "a25_reconciliation_review",
    f"""
    WITH {CHILDREN}, {POOLS}, n AS (SELECT parent_id, line, count(*) AS k, sum(prize_cents) AS s FROM children GROUP BY ALL),
    t AS (SELECT parent_id, CAST(sum(s) AS BIGINT) AS child_cents, CAST(sum(k) AS BIGINT) AS child_rows,
          count(*) FILTER (k > 1) AS duplicate_names FROM n GROUP BY parent_id)
    SELECT *, abs(diff_cents) AS abs_diff_cents, round(abs(diff_cents) / abs(pool_cents) * 100, 4) AS abs_diff_pct,
           CASE WHEN diff_cents < 0 THEN 'placements_below_pool' WHEN diff_cents > 0 THEN 'placements_above_pool'
                ELSE 'equal' END AS direction,
           CASE WHEN diff_cents = 0 THEN 'matched' WHEN abs(diff_cents) <= 2 THEN 'rounding_difference'
                ELSE 'needs_review' END AS status, CAST(0 AS BIGINT) AS negative_amounts
    FROM (SELECT parent_id, pool_cents, child_cents, child_rows, duplicate_names, child_cents - pool_cents AS diff_cents
          FROM pools JOIN t USING (parent_id))
    """,
)
def reconciliation_review(spark, sf):
    return rec.reconcile_review(
        pools(spark, sf), children(spark, sf), "parent_id", "pool_cents", "prize_cents", "line"
    )


@query(
    "a26_two_sided_check",
    f"""
    WITH {CHILDREN}, {POOLS}, {BREAKDOWN},
    s AS (SELECT parent_id, CAST(sum(prize_cents) AS BIGINT) AS child_cents, count(*) AS child_rows FROM children GROUP BY ALL),
    b AS (SELECT parent_id, CAST(sum(prize_cents) AS BIGINT) AS breakdown_cents FROM breakdown GROUP BY ALL)
    SELECT parent_id, pool_cents, child_cents, child_rows, breakdown_cents,
           child_cents - pool_cents AS child_diff_cents, breakdown_cents - pool_cents AS breakdown_diff_cents,
           CASE WHEN breakdown_cents IS NULL THEN 'unavailable' WHEN breakdown_cents = pool_cents THEN 'matches_pool'
                ELSE 'differs_from_pool' END AS breakdown_check
    FROM pools LEFT JOIN s USING (parent_id) LEFT JOIN b USING (parent_id)
    """,
)
def two_sided_check(spark, sf):
    return rec.reconcile_two_sided(
        pools(spark, sf), children(spark, sf), breakdown(spark, sf),
        "parent_id", "pool_cents", "prize_cents",
    )


def _planted_breakdown(spark, sf):
    """Breakdown rows in which nation 24 carries the code of nation 23."""
    code = F.col("country_code")
    return breakdown(spark, sf).withColumn(
        "country_code", F.when(code == 24, F.lit(23)).otherwise(code)
    )


AUDIT = f"""{CHILDREN}, {POOLS}, {BREAKDOWN},
    rows AS (SELECT * REPLACE (CASE WHEN country_code = 24 THEN 23 ELSE country_code END AS country_code) FROM breakdown),
    p AS (SELECT parent_id, count(*) AS k, count(DISTINCT country_code) AS d, CAST(sum(prize_cents) AS BIGINT) AS breakdown_cents
          FROM rows GROUP BY parent_id),
    audit AS (SELECT parent_id, pool_cents, coalesce(k, 0) AS row_count, breakdown_cents,
          CASE WHEN k IS NULL OR k > d THEN 'empty_or_duplicate_country_rows' END AS error,
          CASE WHEN k IS NULL OR k > d THEN 'unavailable' WHEN abs(breakdown_cents - pool_cents) <= 2 THEN 'reconciled'
               ELSE 'total_mismatch' END AS status
          FROM pools LEFT JOIN p USING (parent_id))"""


@query("a27_breakdown_audit", f"WITH {AUDIT} SELECT * FROM audit")
def breakdown_audit(spark, sf):
    return rec.audit_breakdown(
        _planted_breakdown(spark, sf), pools(spark, sf),
        "parent_id", "country_code", "prize_cents", "pool_cents",
    )


@query(
    "a27_accepted_breakdown",
    f"""
    WITH {AUDIT}
    SELECT 'accepted' AS part, 'reconciled' AS status, count(*) AS n_rows, CAST(sum(prize_cents) AS BIGINT) AS prize_cents
    FROM rows WHERE parent_id IN (SELECT parent_id FROM audit WHERE status = 'reconciled')
    UNION ALL
    SELECT 'review', status, count(*), CAST(sum(prize_cents) AS BIGINT) FROM rows JOIN audit USING (parent_id) GROUP BY status
    """,
)
def accepted_breakdown(spark, sf):
    rows = _planted_breakdown(spark, sf)
    audit = breakdown_audit(spark, sf)
    kept, review = rec.accept_breakdown(rows, audit, "parent_id")
    both = kept.select(
        F.lit("accepted").alias("part"), F.lit("reconciled").alias("status"), "prize_cents"
    ).unionByName(review.select(F.lit("review").alias("part"), "status", "prize_cents"))
    return both.groupBy("part", "status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("prize_cents").alias("prize_cents")
    )


@query(
    "a28_seasonality",
    f"""
    WITH {GRID}
    SELECT family, CAST(quarter(period_start) AS INTEGER) AS quarter_of_year,
           round(sum(target_usd) / count(target_usd), 4) AS mean, round(quantile_cont(target_usd, 0.5), 4) AS median,
           count(target_usd) AS n FROM grid WHERE split = 'train' GROUP BY ALL
    """,
)
def seasonality(spark, sf):
    out = st.seasonality(
        grid(spark, sf), "family", F.quarter("period_start"), "quarter_of_year", "target_usd"
    )
    return rounded(out, 4, "mean", "median")


@query(
    "a29_seasonal_matrix",
    f"WITH {MONTHS} SELECT family, "
    + ", ".join(
        f'round(quantile_cont(pool_cents, 0.5) FILTER (month(month_start) = {m}), 3) AS "{m}"'
        for m in range(1, 13)
    )
    + " FROM months GROUP BY family",
)
def seasonal_matrix(spark, sf):
    out = st.seasonal_matrix(
        months(spark, sf), "family", F.month("month_start"), range(1, 13), "pool_cents"
    )
    return out.select("family", *[F.round(f"`{m}`", 3).alias(str(m)) for m in range(1, 13)])


@query(
    "a30_count_matrix",
    f"WITH {PARENTS} SELECT family, "
    + ", ".join(
        f'count(*) FILTER (year(start_date) = {y}) AS "{y}"' for y in range(1995, 2002)
    )
    + " FROM parents GROUP BY family",
)
def count_matrix(spark, sf):
    return st.pivot_counts(parents(spark, sf), "family", "start_date", range(1995, 2002))


@query(
    "a31_value_counts",
    f"WITH {PARENTS} SELECT coalesce(quality_note, 'no_flag') AS quality_note, count(*) AS n_rows FROM parents GROUP BY ALL",
)
def value_counts(spark, sf):
    return st.value_counts(parents(spark, sf), "quality_note")


@query(
    "a32_concentration",
    f"""
    WITH {PARENTS}
    SELECT family, CAST(sum(pool_cents) AS BIGINT) AS total_cents,
           CAST(sum(pool_cents) FILTER (rn <= 10) AS BIGINT) AS top_cents,
           round(sum(pool_cents) FILTER (rn <= 10) / sum(pool_cents) * 100, 6) AS top_share_pct
    FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY pool_cents DESC, parent_id) AS rn FROM parents)
    GROUP BY family
    """,
)
def concentration(spark, sf):
    out = st.topk_share(parents(spark, sf), ["family"], "pool_cents", ["parent_id"], 10)
    return rounded(out, 6, "top_share_pct")


@query(
    "a33_peak_and_lowest_period",
    f"""
    WITH {GRID}
    SELECT family, 'peak' AS kind, quarter, pool_cents FROM grid WHERE pool_cents IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY family ORDER BY pool_cents DESC, period_start) = 1
    UNION ALL
    SELECT family, 'lowest', quarter, pool_cents FROM grid WHERE pool_cents IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY family ORDER BY pool_cents, period_start) = 1
    """,
)
def peak_and_lowest_period(spark, sf):
    g = grid(spark, sf).select("family", "quarter", "period_start", "pool_cents")
    peak = argmax_by(g, ["family"], "pool_cents", "period_start")
    low = argmax_by(g, ["family"], "pool_cents", "period_start", least=True)
    return (
        peak.withColumn("kind", F.lit("peak"))
        .unionByName(low.withColumn("kind", F.lit("lowest")))
        .drop("period_start")
    )


@query(
    "a34_error_share",
    f"""
    WITH {PREDICTIONS}, e AS (SELECT * FROM long WHERE evaluation_available AND model = 'trailing_mean')
    SELECT family, round(sum(absolute_error_usd), 4) AS abs_error_usd,
           round(sum(absolute_error_usd) / (SELECT sum(absolute_error_usd) FROM e) * 100, 6) AS error_share_pct
    FROM e GROUP BY family
    """,
)
def error_share(spark, sf):
    rows = long_predictions(spark, sf).where(F.col("model") == "trailing_mean")
    out = sc.error_share(rows, ["family"])
    return rounded(rounded(out, 4, "abs_error_usd"), 6, "error_share_pct")


@query(
    "a35_pair_availability",
    f"""
    WITH {PANEL}
    SELECT family, count(*) AS periods, count(*) FILTER (hours IS NOT NULL AND pool IS NOT NULL) AS complete_pairs,
           count(*) FILTER (hours IS NULL OR pool IS NULL) AS incomplete FROM panel GROUP BY family
    """,
)
def pair_availability(spark, sf):
    return st.pair_availability(panel(spark, sf), "family", ["hours", "pool"])


@query(
    "a36_missing_periods",
    f"""
    WITH {USER_DAYS}, span AS (SELECT family, count(*) AS row_count, min(day) AS first_period, max(day) AS last_period
        FROM user_days GROUP BY family),
    cal AS (SELECT family, CAST(unnest(generate_series(first_period, last_period, INTERVAL 1 DAY)) AS DATE) AS day FROM span)
    SELECT span.*, coalesce(m.missing, '') AS missing FROM span LEFT JOIN (
      SELECT family, string_agg(CAST(day AS VARCHAR), ' | ' ORDER BY day) AS missing
      FROM cal ANTI JOIN user_days USING (family, day) GROUP BY family) m USING (family)
    """,
)
def absent_periods(spark, sf):
    out = missing_periods(user_days(spark, sf), "family", "day", "day")
    return out.withColumn(
        "missing", F.array_join(F.transform("missing", lambda d: d.cast("string")), " | ")
    )


@query(
    "a37_run_summary",
    """
    SELECT o_orderstatus, false AS is_total, count(*) AS n_rows FROM orders GROUP BY ALL
    UNION ALL SELECT NULL, true, count(*) FROM orders
    """,
)
def run_summary(spark, sf):
    return st.run_summary(table(spark, sf, "orders"), "o_orderstatus")


KPI_YEAR = 2001
KPI_SQL = f"""
    WITH {PREDICTIONS}, {CHILDREN}, {ATTENTION}, {PANEL}, {OWNER_COUNTRY[len(PARENTS) + 2:]},
    y AS (SELECT family, year(start_date) AS y, count(*) AS n, CAST(sum(pool_cents) AS DOUBLE) AS pool,
                 CAST(coalesce(sum(pool_cents) FILTER (strict), 0) AS DOUBLE) AS strict,
                 CAST(coalesce(sum(pool_cents) FILTER (eligible), 0) AS DOUBLE) AS reconciled,
                 min(start_date) AS first, max(start_date) AS last FROM parents GROUP BY ALL),
    f AS (SELECT family, sum(n) AS n, sum(pool) AS pool, sum(strict) AS strict, sum(reconciled) AS reconciled,
                 min(reconciled / pool * 100) AS least, coalesce(sum(n) FILTER (y = {KPI_YEAR}), 0) AS of_year FROM y GROUP BY family),
    a AS (SELECT sum(n) AS n, sum(pool) AS pool, sum(strict) AS strict, sum(reconciled) AS reconciled,
                 CAST(min(first) AS VARCHAR) AS first, CAST(max(last) AS VARCHAR) AS last FROM y),
    med AS (SELECT family, quantile_cont(pool_cents, 0.5) / 100 AS v FROM parents GROUP BY family),
    pan AS (SELECT family, count(*) FILTER (pool IS NOT NULL) AS n, count(hours) AS h, quantile_cont(hours, 0.5) AS med,
                   CASE WHEN stddev_pop(hours) FILTER (pool IS NOT NULL) * stddev_pop(pool) > 0 THEN
                     covar_pop(CAST(hours AS DOUBLE), CAST(pool AS DOUBLE)) / (stddev_pop(hours) FILTER (pool IS NOT NULL) * stddev_pop(pool)) END AS r
            FROM panel GROUP BY family),
    att AS (SELECT family, count(*) AS n, min(day) || ' to ' || max(day) AS note FROM attention GROUP BY family),
    top AS (SELECT family, country_code, m / sum(m) OVER (PARTITION BY family) * 100 AS v,
                   row_number() OVER (PARTITION BY family ORDER BY m DESC, country_code) AS k
            FROM (SELECT family, country_code, sum(pool_cents) AS m FROM owner_country WHERE eligible GROUP BY ALL)),
    g AS (SELECT family, sum(target_usd) AS total, max(target_usd) AS peak, max_by(quarter, (target_usd, quarter)) FILTER (target_usd IS NOT NULL) AS peak_at,
                 string_agg(quarter, ' | ' ORDER BY quarter) FILTER (target_usd IS NULL AND quarter LIKE '{KPI_YEAR}%') AS missing FROM grid GROUP BY family),
    e AS (SELECT * FROM long WHERE is_primary_model AND absolute_error_usd IS NOT NULL
          ORDER BY absolute_error_usd DESC, family, quarter LIMIT 10),
    k(section, family, metric, period, value, text, unit, note) AS (
    SELECT 'release', 'All', 'release_folder', '', NULL, 'v1', 'text', 'newest release'
    UNION ALL SELECT 'release', 'All', 'release_stage', '', NULL, 'policy_clean', 'text', 'coverage not verified'
    UNION ALL SELECT 'scope', 'All', 'tournaments', '', n, NULL, 'rows', 'one row per tournament' FROM a
    UNION ALL SELECT 'scope', 'All', 'total_source_pool', '', pool / 100, NULL, 'USD', 'nominal, not inflation-adjusted' FROM a
    UNION ALL SELECT 'scope', 'All', 'earliest_tournament', '', NULL, first, 'date', 'first day in scope' FROM a
    UNION ALL SELECT 'scope', 'All', 'latest_tournament', '', NULL, last, 'date', 'source coverage not verified' FROM a
    UNION ALL SELECT 'quality', 'All', 'strict_pool_retained', '', strict / pool * 100, NULL, 'percent', 'what the strict filter keeps' FROM a
    UNION ALL SELECT 'quality', 'All', 'country_pool_coverage', '', reconciled / pool * 100, NULL, 'percent', 'of the source pool, not the market' FROM a
    UNION ALL SELECT 'scope', 'All', 'placements', '', count(*), NULL, 'rows', 'accepted team results' FROM children
    UNION ALL SELECT 'scope', 'All', 'attention_observations', '', count(*), NULL, 'family-months', 'main category, not per tournament' FROM attention
    UNION ALL SELECT 'scope', 'All', 'country_observations', '', count(*), NULL, 'rows', 'reconciled tables only' FROM owner_country WHERE eligible
    UNION ALL SELECT 'family', family, 'tournaments', '', n, NULL, 'rows', 'observed tournaments' FROM f
    UNION ALL SELECT 'family', family, 'source_pool', '', pool / 100, NULL, 'USD', 'nominal source total' FROM f
    UNION ALL SELECT 'family', family, 'strict_pool_retained', '', strict / pool * 100, NULL, 'percent', 'sensitivity to the quality policy' FROM f
    UNION ALL SELECT 'family', family, 'least_country_coverage', '', least, NULL, 'percent', 'lowest year of reconciled money' FROM f
    UNION ALL SELECT 'family', family, 'tournaments_of_year', '{KPI_YEAR}', of_year, NULL, 'rows', 'may reflect incomplete coverage' FROM f
    UNION ALL SELECT 'countries', family, 'country_pool_coverage', 'all observed', reconciled / pool * 100, NULL, 'percent', 'reconciled over source money' FROM f
    UNION ALL SELECT 'family', family, 'median_pool', '', v, NULL, 'USD', 'typical tournament' FROM med
    UNION ALL SELECT 'family', family, 'attention_months', '', n, NULL, 'months', note FROM att
    UNION ALL SELECT 'attention', CAST(family AS VARCHAR), 'pearson_hours_pool', 'matched periods', r, NULL, 'coefficient', 'descriptive, n=' || n FROM pan
    UNION ALL SELECT 'attention', CAST(family AS VARCHAR), 'median_hours', 'n=' || h, med, NULL, 'hours', 'per period' FROM pan
    UNION ALL SELECT 'countries', family, 'top_country_' || country_code || '_share', 'all observed', v, NULL, 'percent', 'share of reconciled money' FROM top WHERE k = 1
    UNION ALL SELECT 'forecast', family, 'missing_quarters', '{KPI_YEAR}', NULL, coalesce(missing, 'no missing quarters'), 'quarters', 'never imputed as zero' FROM g
    UNION ALL SELECT 'prizes', family, 'total_source_pool', 'all observed', total, NULL, 'USD', 'sum of observed quarters' FROM g
    UNION ALL SELECT 'prizes', family, 'peak_quarter_pool', peak_at, peak, NULL, 'USD', 'largest observed quarter' FROM g
    UNION ALL SELECT 'errors', family, 'absolute_error', quarter, absolute_error_usd, NULL, 'USD', 'largest errors of the primary model' FROM e)
    SELECT section, family, metric, period, round(CAST(value AS DOUBLE), CASE unit WHEN 'USD' THEN 2 ELSE 5 END) AS value, text, unit, note FROM k
"""


@query("a38_kpi_table", KPI_SQL)
def kpi(spark, sf):
    release = Release(
        "v1", "policy_clean",
        parents=parents(spark, sf).withColumn("reconciled", F.col("eligible")),
        children=children(spark, sf).withColumnRenamed("flag", "family"),
        attention=attention(spark, sf).withColumnRenamed("day", "month_start"),
        countries=owner_country(spark, sf).where("eligible").withColumnRenamed("pool_cents", "prize_cents"),
        panel=panel(spark, sf),
        grid=grid(spark, sf),
        errors=long_predictions(spark, sf).where("is_primary_model"),
        year=KPI_YEAR,
    )
    digits = F.when(F.col("unit") == "USD", F.round("value", 2)).otherwise(F.round("value", 5))
    return kpi_table(release).withColumn("value", digits)


@query(
    "a39_histogram",
    f"""
    WITH {PARENTS}, v AS (SELECT family, round(log10(1 + pool_cents), 6) AS x FROM parents),
    b AS (SELECT family, CAST(CASE WHEN x < 5.5 THEN 0 WHEN x > 7.5 THEN 13
                                   ELSE least(floor((x - 5.5) / (CAST(2 AS DOUBLE) / 12)) + 1, 12) END AS INTEGER) AS bin, count(*) AS n_rows
          FROM v GROUP BY ALL)
    SELECT family, bin, n_rows, round(n_rows / sum(n_rows) OVER (PARTITION BY family) * 100, 6) AS pct_of_family FROM b
    """,
)
def histogram(spark, sf):
    rows = parents(spark, sf).select(
        "family", F.round(log10p1(F.col("pool_cents")), 6).alias("x")
    )
    return rounded(st.histogram_pct(rows, "family", "x", 12, 5.5, 7.5), 6, "pct_of_family")


@query(
    "a40_identity_summary",
    f"""
    WITH {CHILDREN}, amb AS (SELECT parent_id, flag FROM children GROUP BY ALL HAVING count(DISTINCT team_name) > 1)
    SELECT count(*) AS ambiguous_rows, count(DISTINCT parent_id) AS ambiguous_parents
    FROM children JOIN amb USING (parent_id, flag)
    """,
)
def identity_summary(spark, sf):
    rows = null_ambiguous_ids(children(spark, sf), "parent_id", "flag", "team_name")
    return st.identity_summary(rows, "parent_id", "identity_status")


@query(
    "a41_discovery_coverage",
    """
    WITH audit AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')
    SELECT count(*) AS listed, count(*) FILTER (s = 'F') AS done, count(*) FILTER (s IS NULL) AS pending,
           count(*) FILTER (s <> 'F') AS issues, (SELECT count(*) FROM lineitem) AS item_rows,
           (SELECT count(DISTINCT l_partkey) FROM lineitem) AS distinct_items,
           (SELECT count(*) FROM part) AS reported,
           (SELECT count(*) - count(DISTINCT l_partkey) FROM lineitem) AS duplicate_item_rows,
           (SELECT count(DISTINCT l_partkey) FROM lineitem) - (SELECT count(*) FROM part) AS found_minus_reported
    FROM orders LEFT JOIN audit ON k = o_orderkey
    """,
)
def discovery_coverage(spark, sf):
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey").alias("key")
    return st.discovery_coverage(
        orders.select(key),
        orders.where(F.col("o_orderdate") < "2000-01-01").select(
            key, F.col("o_orderstatus").alias("status")
        ),
        table(spark, sf, "lineitem"),
        "key", "l_partkey", "status", "F",
        table(spark, sf, "part").agg(F.count(F.lit(1)).alias("reported")),
    )


@query(
    "a42_section_profile",
    """
    SELECT CAST(year(l_shipdate) AS INTEGER) AS section, count(*) AS n_rows,
           count(DISTINCT l_orderkey) AS distinct_events, count(DISTINCT l_partkey) AS distinct_items
    FROM lineitem GROUP BY ALL
    """,
)
def section_profile(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("section", F.year("l_shipdate"))
    return st.section_profile(rows, "section", "l_orderkey", "l_partkey")


@query(
    "a43_url_consolidation",
    """
    WITH p AS (SELECT '/user/' || user_id AS url, event_type AS source, count(*) AS observations FROM events GROUP BY ALL)
    SELECT *, CAST(sum(observations) OVER (PARTITION BY url) AS BIGINT) AS url_observations,
           count(*) OVER (PARTITION BY url) AS n_sources FROM p
    """,
)
def url_consolidation(spark, sf):
    """The page of a user, as seen by each kind of event."""
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("/user/"), F.col("user_id")).alias("url"), F.col("event_type").alias("source")
    )
    return st.consolidate_urls(rows, "url", "source")
