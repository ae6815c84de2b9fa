"""The driver tables in the shape of the money and attention data model.

Each builder has a SQL twin (a chain of common table expressions) for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prizelens.functions.money import cents
from prizelens.functions.text import strict_quality
from prizelens.operators.grid import complete_grid, quarterly_grid

GRID_START, GRID_END = "1995-01-01", "2001-10-01"
TRAIN_END, VALIDATION_END = 1999, 2000
DAY_START, DAY_END = "2024-01-01", "2024-01-30"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parents(spark: SparkSession, sf: str) -> DataFrame:
    """orders as tournaments; the strict rule uses the note and the eligibility."""
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("parent_id"),
        F.col("o_custkey").alias("owner_id"),
        F.col("o_orderpriority").alias("family"),
        status.alias("version"),
        F.col("o_orderdate").cast("date").alias("start_date"),
        cents(F.col("o_totalprice")).alias("pool_cents"),
        F.when(status == "P", F.lit("pending")).alias("quality_note"),
        (status != "F").alias("eligible"),
        strict_quality(F.when(status == "P", F.lit("pending")), status != "F").alias(
            "strict"
        ),
    )


PARENTS = """parents AS (
    SELECT o_orderkey AS parent_id, o_custkey AS owner_id, o_orderpriority AS family,
           o_orderstatus AS version, CAST(o_orderdate AS DATE) AS start_date,
           CAST(round(o_totalprice * 100) AS BIGINT) AS pool_cents,
           CASE WHEN o_orderstatus = 'P' THEN 'pending' END AS quality_note,
           o_orderstatus <> 'F' AS eligible,
           o_orderstatus NOT IN ('F', 'P') AS strict
    FROM orders)"""


def children(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as placements; ``pos`` is the source order inside a parent."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("parent_id"),
        F.col("l_suppkey").alias("team_id"),
        F.col("l_partkey").alias("team_name"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"),
        F.col("l_linenumber").alias("line"),
        cents(F.col("l_extendedprice")).alias("prize_cents"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_discount").alias("discount"),
    )


CHILDREN = """children AS (
    SELECT l_orderkey AS parent_id, l_suppkey AS team_id, l_partkey AS team_name,
           l_linenumber AS line,
           (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
           CAST(round(l_extendedprice * 100) AS BIGINT) AS prize_cents,
           l_quantity AS quantity, l_returnflag AS flag, l_discount AS discount
    FROM lineitem)"""


def pool_offset(key: Column) -> Column:
    """Planted difference between a parent's pool and its children."""
    values = F.array(*[F.lit(v) for v in (0, 2, -2, 3, -150)])
    return F.element_at(values, (F.pmod(key, F.lit(5)) + 1).cast("int"))


def pools(spark: SparkSession, sf: str) -> DataFrame:
    """Parents whose pool is the sum of their lines plus a planted difference."""
    kids = children(spark, sf)
    return kids.groupBy("parent_id").agg(
        (F.sum("prize_cents") + pool_offset(F.col("parent_id"))).alias("pool_cents")
    )


POOLS = """pools AS (
    SELECT parent_id,
           CAST(sum(prize_cents) AS BIGINT)
             + [0, 2, -2, 3, -150][(parent_id % 5) + 1] AS pool_cents
    FROM children GROUP BY parent_id)"""


def breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Money of a parent by nation of the supplier (one row per parent, nation)."""
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", cents(F.col("l_extendedprice")).alias("prize_cents")
    )
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (
        items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(
            F.col("l_orderkey").alias("parent_id"),
            F.col("n_nationkey").alias("country_code"),
            F.col("n_name").alias("country_name"),
        )
        .agg(F.sum("prize_cents").alias("prize_cents"))
    )


BREAKDOWN = """breakdown AS (
    SELECT l_orderkey AS parent_id, n_nationkey AS country_code, n_name AS country_name,
           CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS prize_cents
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey
    GROUP BY ALL)"""


def owner_country(spark: SparkSession, sf: str) -> DataFrame:
    """Parents with the nation of their owner."""
    owners = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (
        parents(spark, sf)
        .join(owners, F.col("owner_id") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("year", F.year("start_date"))
        .withColumnsRenamed({"n_nationkey": "country_code", "n_name": "country_name"})
        .drop("c_custkey", "c_nationkey")
    )


OWNER_COUNTRY = (
    PARENTS
    + """, owner_country AS (
    SELECT parents.*, n_nationkey AS country_code, n_name AS country_name,
           CAST(year(start_date) AS INTEGER) AS year
    FROM parents JOIN customer ON owner_id = c_custkey
    JOIN nation ON c_nationkey = n_nationkey)"""
)


def attention(spark: SparkSession, sf: str) -> DataFrame:
    """events per (event_type, day): hours add up, average and peak do not."""
    return (
        table(spark, sf, "events")
        .groupBy(
            F.col("event_type").alias("family"), F.col("ts").cast("date").alias("day")
        )
        .agg(
            F.count(F.lit(1)).alias("streams"),
            F.sum(cents(F.col("value"))).alias("hours"),
            F.max(cents(F.col("value"))).alias("peak"),
        )
        .withColumn("average", F.col("hours") / F.col("streams"))
    )


ATTENTION = """attention AS (
    SELECT *, hours / streams AS average FROM (
      SELECT event_type AS family, CAST(ts AS DATE) AS day, count(*) AS streams,
             CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS hours,
             max(CAST(round(value * 100) AS BIGINT)) AS peak
      FROM events GROUP BY ALL))"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Attention (views) with money (purchases) per (user, day); money may be null."""
    kind, value = F.col("event_type"), cents(F.col("value"))
    return (
        table(spark, sf, "events")
        .groupBy(
            F.col("user_id").alias("family"), F.col("ts").cast("date").alias("day")
        )
        .agg(
            F.sum(F.when(kind == "view", value)).alias("hours"),
            F.sum(F.when(kind == "purchase", value)).alias("pool"),
            F.count_if(kind == "purchase").alias("tournaments"),
        )
        .where("hours IS NOT NULL")
    )


PANEL = """panel AS (
    SELECT user_id AS family, CAST(ts AS DATE) AS day,
           CAST(sum(CAST(round(value * 100) AS BIGINT))
                FILTER (event_type = 'view') AS BIGINT) AS hours,
           CAST(sum(CAST(round(value * 100) AS BIGINT))
                FILTER (event_type = 'purchase') AS BIGINT) AS pool,
           count(*) FILTER (event_type = 'purchase') AS tournaments
    FROM events GROUP BY ALL HAVING hours IS NOT NULL)"""


def user_days(spark: SparkSession, sf: str) -> DataFrame:
    """events per (user, day): a series with natural gaps."""
    return (
        table(spark, sf, "events")
        .groupBy(
            F.col("user_id").alias("family"), F.col("ts").cast("date").alias("day")
        )
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(cents(F.col("value"))).alias("hours"),
        )
    )


USER_DAYS = """user_days AS (
    SELECT user_id AS family, CAST(ts AS DATE) AS day, count(*) AS n_rows,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS hours
    FROM events GROUP BY ALL)"""


def user_grid(spark: SparkSession, sf: str) -> DataFrame:
    return complete_grid(
        user_days(spark, sf), "family", "day", DAY_START, DAY_END, "day"
    )


USER_GRID = (
    USER_DAYS
    + f""", user_grid AS (
    SELECT f.family, CAST(d.day AS DATE) AS day, n_rows, hours
    FROM (SELECT DISTINCT family FROM user_days) f
    CROSS JOIN (SELECT unnest(generate_series(DATE '{DAY_START}', DATE '{DAY_END}',
                                              INTERVAL 1 DAY)) AS day) d
    LEFT JOIN user_days u ON u.family = f.family AND u.day = CAST(d.day AS DATE))"""
)


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Quarterly money grid of the parents with splits."""
    return quarterly_grid(
        parents(spark, sf),
        "family",
        "start_date",
        "pool_cents",
        "strict",
        GRID_START,
        GRID_END,
        TRAIN_END,
        VALIDATION_END,
    )


GRID = (
    PARENTS
    + f""", totals AS (
    SELECT family, CAST(date_trunc('quarter', start_date) AS DATE) AS period_start,
           count(*) AS observed_count, CAST(sum(pool_cents) AS BIGINT) AS pool_cents,
           count(*) FILTER (strict) AS strict_count,
           CAST(sum(pool_cents) FILTER (strict) AS BIGINT) AS strict_pool_cents
    FROM parents GROUP BY ALL), calendar AS (
    SELECT f.family, CAST(q.period_start AS DATE) AS period_start
    FROM (SELECT DISTINCT family FROM parents) f
    CROSS JOIN (SELECT unnest(generate_series(DATE '{GRID_START}', DATE '{GRID_END}',
                                              INTERVAL 3 MONTH)) AS period_start) q),
    grid AS (
    SELECT c.family, c.period_start, observed_count, pool_cents, strict_count,
           strict_pool_cents,
           year(c.period_start) || 'Q' || quarter(c.period_start) AS quarter,
           pool_cents / 100.0::DOUBLE AS target_usd,
           strict_pool_cents / 100.0::DOUBLE AS strict_target_usd,
           observed_count IS NOT NULL AS period_observed,
           CASE WHEN year(c.period_start) <= {TRAIN_END} THEN 'train'
                WHEN year(c.period_start) <= {VALIDATION_END} THEN 'validation'
                ELSE 'test' END AS split
    FROM calendar c LEFT JOIN totals t
      ON t.family = c.family AND t.period_start = c.period_start)"""
)

# Three predictors that SQL can state; they stand in for the wide model columns.
PREDICTORS = {
    "seasonal_naive": "Seasonal naive (t-4)",
    "last_value": "Last value (t-1)",
    "trailing_mean": "Trailing mean",
}


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Wide prediction table (validation and test rows with a lag-4 value)."""
    from prizelens.operators.scoring import prediction_table
    from prizelens.operators.windows import add_lags, add_trailing

    g = add_lags(grid(spark, sf), "family", "period_start", "target_usd", [1, 4])
    g = add_trailing(g, "family", "period_start", "target_usd")
    g = g.where((F.col("split") != "train") & F.col("lag_4").isNotNull()).withColumns(
        {
            "target_policy": F.lit("source"),
            "prediction_seasonal_naive": F.col("lag_4"),
            "prediction_last_value": F.coalesce("lag_1", "lag_4"),
            "prediction_trailing_mean": F.coalesce("rolling_mean_4", "lag_4"),
        }
    )
    return prediction_table(
        g,
        ["family", "quarter", "period_start", "split", "target_policy"],
        "target_usd",
        list(PREDICTORS),
    )


PREDICTIONS = (
    GRID
    + """, lagged AS (
    SELECT *, lag(target_usd, 1) OVER w AS lag_1, lag(target_usd, 4) OVER w AS lag_4,
           CASE WHEN count(target_usd) OVER b >= 2 THEN avg(target_usd) OVER b END AS rolling_mean_4
    FROM grid
    WINDOW w AS (PARTITION BY family ORDER BY period_start),
           b AS (PARTITION BY family ORDER BY period_start
                 ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)), wide AS (
    SELECT family, quarter, period_start, split, 'source' AS target_policy,
           target_usd AS actual_usd, lag_4 AS prediction_seasonal_naive,
           coalesce(lag_1, lag_4) AS prediction_last_value,
           coalesce(rolling_mean_4, lag_4) AS prediction_trailing_mean,
           target_usd IS NOT NULL AS evaluation_available,
           CASE WHEN target_usd IS NOT NULL THEN 'evaluated'
                ELSE 'target_missing_prediction_only' END AS evaluation_status,
           'rolling_one_step' AS protocol
    FROM lagged WHERE split <> 'train' AND lag_4 IS NOT NULL), long AS (
    SELECT family, quarter, period_start, split, target_policy, actual_usd,
           evaluation_available, evaluation_status, protocol, model,
           predicted AS predicted_usd,
           CASE model WHEN 'seasonal_naive' THEN 'Seasonal naive (t-4)'
                      WHEN 'last_value' THEN 'Last value (t-1)'
                      ELSE 'Trailing mean' END AS model_label,
           actual_usd - predicted AS residual_usd,
           abs(actual_usd - predicted) AS absolute_error_usd,
           CASE WHEN actual_usd - predicted < 0 THEN 'overprediction'
                WHEN actual_usd - predicted > 0 THEN 'underprediction'
                ELSE 'not_evaluated_or_exact' END AS error_direction,
           model = 'trailing_mean' AS is_primary_model,
           model = 'seasonal_naive' AS is_baseline_model
    FROM (SELECT *, 'seasonal_naive' AS model, prediction_seasonal_naive AS predicted FROM wide
          UNION ALL SELECT *, 'last_value', prediction_last_value FROM wide
          UNION ALL SELECT *, 'trailing_mean', prediction_trailing_mean FROM wide))"""
)


def long_predictions(spark: SparkSession, sf: str) -> DataFrame:
    from prizelens.operators.scoring import predictions_long

    return predictions_long(
        predictions(spark, sf), PREDICTORS, "trailing_mean", "seasonal_naive"
    )


def months(spark: SparkSession, sf: str) -> DataFrame:
    """Parents per (family, month): a short monthly series."""
    return (
        parents(spark, sf)
        .groupBy("family", F.trunc("start_date", "month").alias("month_start"))
        .agg(F.sum("pool_cents").alias("pool_cents"), F.count(F.lit(1)).alias("n_rows"))
    )


MONTHS = (
    PARENTS
    + """, months AS (
    SELECT family, CAST(date_trunc('month', start_date) AS DATE) AS month_start,
           CAST(sum(pool_cents) AS BIGINT) AS pool_cents, count(*) AS n_rows
    FROM parents GROUP BY ALL)"""
)
