"""Window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from prizelens.operators import windows as w
from prizelens.operators.scoring import error_analysis
from prizelens.queries.aggregations import rounded
from prizelens.queries.registry import query
from prizelens.queries.shapes import (
    CHILDREN,
    GRID,
    MONTHS,
    PARENTS,
    PREDICTIONS,
    USER_DAYS,
    USER_GRID,
    children,
    grid,
    long_predictions,
    months,
    parents,
    table,
    user_days,
    user_grid,
)


@query(
    "w01_lags_on_grid",
    f"""
    WITH {USER_GRID}
    SELECT family, day, hours, lag(hours, 1) OVER w AS lag_1, lag(hours, 2) OVER w AS lag_2,
           lag(hours, 4) OVER w AS lag_4
    FROM user_grid WINDOW w AS (PARTITION BY family ORDER BY day)
    """,
)
def lags_on_grid(spark, sf):
    return w.add_lags(user_grid(spark, sf), "family", "day", "hours", [1, 2, 4]).drop("n_rows")


@query(
    "w02_trailing_statistics",
    f"""
    WITH {USER_GRID}
    SELECT family, day,
      CASE WHEN count(hours) OVER b >= 2 THEN round(avg(hours) OVER b, 4) END AS rolling_mean_4,
      CASE WHEN count(hours) OVER b >= 2 THEN round(quantile_cont(hours, 0.5) OVER b, 4) END AS rolling_median_4,
      CASE WHEN count(hours) OVER b >= 2 THEN round(stddev_samp(hours) OVER b, 4) END AS rolling_std_4
    FROM user_grid WINDOW b AS (PARTITION BY family ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)
    """,
)
def trailing_statistics(spark, sf):
    out = w.add_trailing(user_grid(spark, sf), "family", "day", "hours")
    return rounded(
        out.drop("n_rows", "hours"), 4, "rolling_mean_4", "rolling_median_4", "rolling_std_4"
    )


@query(
    "w03_time_index",
    f"""
    WITH {GRID}
    SELECT family, quarter, CAST(row_number() OVER (PARTITION BY family ORDER BY period_start) - 1 AS INTEGER) AS time_index FROM grid
    """,
)
def time_index(spark, sf):
    return w.time_index(grid(spark, sf), "family", "period_start").select(
        "family", "quarter", "time_index"
    )


@query(
    "w04_growth",
    f"""
    WITH {MONTHS}
    SELECT family, month_start, round((pool_cents - p) / p * 100, 6) AS pool_cents_growth_pct
    FROM (SELECT *, lag(pool_cents) OVER (PARTITION BY family ORDER BY month_start) AS p FROM months)
    """,
)
def growth(spark, sf):
    out = w.growth(months(spark, sf), "family", "month_start", "pool_cents")
    return rounded(out, 6, "pool_cents_growth_pct").drop("n_rows", "pool_cents")


CONSECUTIVE = """CASE WHEN d + 1 = day AND p > 0 THEN (hours - p) / p * 100 END"""
STEP = f"""{USER_DAYS}, step AS (SELECT family, day, hours, {CONSECUTIVE} AS g FROM (
    SELECT *, lag(hours) OVER w AS p, lag(day) OVER w AS d FROM user_days
    WINDOW w AS (PARTITION BY family ORDER BY day)))"""


@query(
    "w05_consecutive_growth",
    f"WITH {STEP} SELECT family, day, round(g, 6) AS hours_growth_pct FROM step",
)
def consecutive_growth(spark, sf):
    out = w.growth(user_days(spark, sf), "family", "day", "hours", "day", consecutive=True)
    return rounded(out, 6, "hours_growth_pct").drop("n_rows", "hours")


@query(
    "w06_surge",
    f"""
    WITH {STEP}, q AS (SELECT family, quantile_cont(hours, 0.25) AS q1, quantile_cont(hours, 0.75) AS q3
        FROM user_days GROUP BY family)
    SELECT family, day, hours, round(g, 6) AS hours_growth_pct FROM step JOIN q USING (family)
    WHERE g > 0 AND hours > q3 + 1.5 * (q3 - q1)
    """,
)
def surge(spark, sf):
    out = w.surge(user_days(spark, sf), "family", "day", "hours", "day")
    return rounded(out, 6, "hours_growth_pct").drop("n_rows")


@query(
    "w07_share_of_total",
    f"""
    WITH {PARENTS}
    SELECT parent_id, round(pool_cents / sum(pool_cents) OVER (PARTITION BY family, year(start_date)) * 100, 8) AS share_pct
    FROM parents
    """,
)
def share_of_total(spark, sf):
    rows = parents(spark, sf).withColumn("year", F.year("start_date"))
    out = w.share_of(rows, ["family", "year"], "pool_cents", "share_pct")
    return rounded(out, 8, "share_pct").select("parent_id", "share_pct")


@query(
    "w08_top_per_family",
    f"""
    WITH {PARENTS}
    SELECT family, parent_id, pool_cents, CAST(rn AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY family ORDER BY pool_cents DESC, parent_id) AS rn FROM parents)
    WHERE rn <= 10
    """,
)
def top_per_family(spark, sf):
    p = parents(spark, sf).select("family", "parent_id", "pool_cents")
    return w.top_n(p, ["family"], [F.col("pool_cents").desc(), F.col("parent_id")], 10)


@query(
    "w09_average_rank",
    f"""
    WITH {CHILDREN}
    SELECT parent_id, line, team_id, team_name, prize_cents,
           rank() OVER (PARTITION BY flag ORDER BY quantity)
             + (count(*) OVER (PARTITION BY flag, quantity) - 1) / 2 AS quantity_rank
    FROM children
    """,
)
def average_rank(spark, sf):
    return w.avg_rank(children(spark, sf), ["flag"], "quantity", "quantity_rank").select(
        "parent_id", "line", "team_id", "team_name", "prize_cents", "quantity_rank"
    )


@query(
    "w10_global_error_rank",
    f"""
    WITH {PREDICTIONS}, e AS (SELECT * FROM long WHERE evaluation_available AND model = 'trailing_mean')
    SELECT row_number() OVER (ORDER BY absolute_error_usd DESC, family, quarter) AS absolute_error_rank,
           family, quarter, round(absolute_error_usd, 4) AS absolute_error_usd,
           round(absolute_error_usd / (SELECT sum(absolute_error_usd) FROM e) * 100, 6) AS absolute_error_share_pct
    FROM e
    """,
)
def global_error_rank(spark, sf):
    rows = long_predictions(spark, sf).where(F.col("model") == "trailing_mean")
    out = error_analysis(rows, ["family", "quarter"]).select(
        "absolute_error_rank", "family", "quarter", "absolute_error_usd",
        "absolute_error_share_pct",
    )
    return rounded(rounded(out, 4, "absolute_error_usd"), 6, "absolute_error_share_pct")


@query(
    "w10_global_rank_of_rows",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
           row_number() OVER (ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place
    FROM lineitem
    """,
)
def global_rank_of_rows(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf, "lineitem").select(*keys, "l_quantity")
    return w.global_rank(rows, [F.col("l_quantity").desc(), *keys], "place")


@query(
    "w11_rolling_mean",
    f"""
    WITH {MONTHS}
    SELECT family, month_start, CASE WHEN count(pool_cents) OVER b >= 6 THEN round(avg(pool_cents) OVER b, 2) END AS pool_cents_rolling_12
    FROM months WINDOW b AS (PARTITION BY family ORDER BY month_start ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
    """,
)
def rolling_mean(spark, sf):
    out = w.rolling_mean(months(spark, sf), "family", "month_start", "pool_cents")
    return rounded(out, 2, "pool_cents_rolling_12").drop("n_rows", "pool_cents")


@query(
    "w12_from_first_observed",
    f"""
    WITH {USER_GRID}
    SELECT family, day, hours FROM (SELECT *, min(CASE WHEN hours IS NOT NULL THEN day END) OVER (PARTITION BY family) AS f
      FROM user_grid) WHERE day >= f
    """,
)
def from_first_observed(spark, sf):
    return w.from_first_observed(user_grid(spark, sf), "family", "day", "hours").select(
        "family", "day", "hours"
    )


@query(
    "w13_keep_first",
    """
    SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1
    """,
)
def keep_first(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_suppkey"]
    rows = table(spark, sf, "lineitem").select("l_partkey", *order)
    return w.dedupe_first(rows, ["l_partkey"], [F.col(c) for c in order])


@query(
    "w14_carry_heading_forward",
    """
    SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS)
        OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading
    FROM conversations
    """,
)
def carry_heading_forward(spark, sf):
    rows = table(spark, sf, "conversations").withColumn(
        "asked", F.when(F.col("role") == "user", F.col("turn"))
    )
    return w.carry_forward(rows, ["conv_id"], "turn", "asked", "heading").select(
        "conv_id", "turn", "heading"
    )
