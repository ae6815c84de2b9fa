"""Joins, set operations and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from prizelens.functions.money import cents
from prizelens.operators import joins as j
from prizelens.operators import scoring as s
from prizelens.operators.checks import check_close, run_checks
from prizelens.operators.grid import calendar_rows
from prizelens.operators.stats import quality_sensitivity
from prizelens.plans.attention import monthly_panel, checked_panel
from prizelens.queries.registry import query
from prizelens.queries.shapes import (
    ATTENTION,
    CHILDREN,
    GRID,
    PARENTS,
    PREDICTIONS,
    USER_GRID,
    attention,
    children,
    grid,
    long_predictions,
    parents,
    predictions,
    table,
    user_grid,
)
from prizelens.session import ensure_checkpoint_dir


@query(
    "j01_checked_inner_join",
    f"""
    WITH {PARENTS}, {CHILDREN}
    SELECT parent_id, line, team_id, team_name, prize_cents, strict
    FROM children JOIN parents USING (parent_id)
    """,
)
def checked_inner_join(spark, sf):
    p = parents(spark, sf).select("parent_id", "strict")
    kids = children(spark, sf).select(
        "parent_id", "line", "team_id", "team_name", "prize_cents"
    )
    return j.checked_join(kids, p, ["parent_id"], "inner", "many_to_one")


@query(
    "j02_one_to_one_with_indicator",
    f"""
    WITH {PARENTS}, {CHILDREN}, s AS (SELECT parent_id, CAST(sum(prize_cents) AS BIGINT) AS child_cents
      FROM children GROUP BY parent_id)
    SELECT parent_id, pool_cents, child_cents, child_cents IS NOT NULL AS observed
    FROM parents LEFT JOIN s USING (parent_id)
    """,
)
def one_to_one_with_indicator(spark, sf):
    sums = children(spark, sf).groupBy("parent_id").agg(
        F.sum("prize_cents").alias("child_cents")
    )
    p = parents(spark, sf).select("parent_id", "pool_cents")
    return j.checked_join(p, sums, ["parent_id"], "left", "one_to_one", indicator="observed")


@query(
    "j03_enrich_with_platform_total",
    f"""
    WITH {ATTENTION}, platform AS (SELECT CAST(ts AS DATE) AS day,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS platform_hours FROM events GROUP BY ALL)
    SELECT family, day, hours, platform_hours FROM attention LEFT JOIN platform USING (day)
    """,
)
def enrich_with_platform_total(spark, sf):
    platform = (
        table(spark, sf, "events")
        .groupBy(F.col("ts").cast("date").alias("day"))
        .agg(F.sum(cents(F.col("value"))).alias("platform_hours"))
    )
    return j.enrich(
        attention(spark, sf).select("family", "day", "hours"), platform, ["day"]
    )


@query(
    "j03_monthly_panel",
    f"""
    WITH {PARENTS}, att AS (
      SELECT o_orderpriority AS family,
             CAST(date_trunc('month', l_shipdate) AS DATE) AS month_start,
             CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS hours
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
    platform AS (SELECT month_start, CAST(sum(hours) AS BIGINT) AS platform_hours FROM att GROUP BY ALL),
    money AS (SELECT family, CAST(date_trunc('month', start_date) AS DATE) AS month_start,
        count(*) AS observed_count, count(pool_cents) AS known_pool_count,
        CAST(sum(pool_cents) AS BIGINT) AS pool_cents,
        count(*) FILTER (eligible) AS reconciled_count,
        CAST(sum(pool_cents) FILTER (eligible) AS BIGINT) AS reconciled_pool_cents,
        count(*) FILTER (quality_note IS NOT NULL) AS flagged_count,
        string_agg(DISTINCT version, ' | ' ORDER BY version) AS versions_present
      FROM parents GROUP BY ALL)
    SELECT family, month_start, hours, platform_hours,
           round(hours / platform_hours * 100, 6) AS share_of_platform_pct,
           coalesce(observed_count, 0) AS observed_count, coalesce(known_pool_count, 0) AS known_pool_count,
           coalesce(reconciled_count, 0) AS reconciled_count, coalesce(flagged_count, 0) AS flagged_count,
           pool_cents, reconciled_pool_cents, versions_present, money.family IS NOT NULL AS month_observed
    FROM att LEFT JOIN money USING (family, month_start) LEFT JOIN platform USING (month_start)
    """,
)
def game_monthly_panel(spark, sf):
    """Attention = lines shipped per month; money = orders per month."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    att = (
        table(spark, sf, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(
            F.col("o_orderpriority").alias("family"),
            F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month_start"),
        )
        .agg(F.sum(F.round("l_quantity").cast("bigint")).alias("hours"))
    )
    # The attention table is written once; checks and panel read it several times.
    ensure_checkpoint_dir(spark)
    att = att.checkpoint()
    platform = att.groupBy("month_start").agg(F.sum("hours").alias("hours"))
    panel, _ = monthly_panel(att, parents(spark, sf), platform)
    panel = checked_panel(panel)
    return panel.withColumn("share_of_platform_pct", F.round("share_of_platform_pct", 6))


@query(
    "j04_split_by_keys",
    f"""
    WITH {PARENTS}, k AS (SELECT family, start_date FROM parents GROUP BY ALL HAVING count(*) > 1)
    SELECT CASE WHEN (family, start_date) IN (SELECT (family, start_date) FROM k) THEN 'kept' ELSE 'excluded' END AS part,
           count(*) AS n_rows, CAST(sum(pool_cents) AS BIGINT) AS pool_cents FROM parents GROUP BY ALL
    """,
)
def split_by_keys(spark, sf):
    p = parents(spark, sf)
    busy = j.duplicate_keys(p, ["family", "start_date"])
    kept, excluded = j.split_by_keys(p, busy, ["family", "start_date"])
    both = kept.withColumn("part", F.lit("kept")).unionByName(
        excluded.withColumn("part", F.lit("excluded"))
    )
    return both.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("pool_cents").alias("pool_cents")
    )


@query(
    "j05_attach_child_totals",
    f"""
    WITH {PARENTS}, {CHILDREN}
    SELECT parent_id, pool_cents, child_cents, child_rows FROM parents LEFT JOIN (
      SELECT parent_id, CAST(sum(prize_cents) AS BIGINT) AS child_cents, count(*) AS child_rows
      FROM children GROUP BY parent_id) USING (parent_id)
    """,
)
def attach_child_totals(spark, sf):
    return j.attach(
        parents(spark, sf).select("parent_id", "pool_cents"),
        children(spark, sf),
        ["parent_id"],
        [F.sum("prize_cents").alias("child_cents"), F.count(F.lit(1)).alias("child_rows")],
    )


@query(
    "j06_align_counts",
    """
    SELECT key, coalesce(a.orders, 0) AS orders, coalesce(b.lines, 0) AS lines
    FROM (SELECT o_custkey AS key, count(*) AS orders FROM orders GROUP BY ALL) a
    FULL JOIN (SELECT l_partkey AS key, count(*) AS lines FROM lineitem GROUP BY ALL) b USING (key)
    """,
)
def align_counts(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    b = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(
        F.count(F.lit(1)).alias("lines")
    )
    return j.align_counts(a, b, ["key"])


@query(
    "j07_join_config",
    "SELECT c_custkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def join_config(spark, sf):
    config = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "nation")
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return j.join_config(rows, config, "nation", list(range(25))).drop("nation")


@query("j08_complete_quarter_grid", f"WITH {GRID} SELECT * FROM grid")
def complete_quarter_grid(spark, sf):
    return grid(spark, sf)


@query("j08_complete_day_grid", f"WITH {USER_GRID} SELECT * FROM user_grid")
def complete_day_grid(spark, sf):
    return user_grid(spark, sf)


@query(
    "j08_listed_family_calendar",
    """
    SELECT n_name AS family, CAST(m AS DATE) AS month_start FROM nation,
      (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS m)
    """,
)
def listed_family_calendar(spark, sf):
    families = table(spark, sf, "nation").select(F.col("n_name").alias("family"))
    return calendar_rows(families, "month_start", "1995-01-01", "2001-12-01", "month")


@query(
    "j09_predictions_against_actuals",
    "SELECT 'actual_usd' AS column_name, CAST(0 AS BIGINT) AS bad_rows, true AS passed",
)
def predictions_against_actuals(spark, sf):
    stored = predictions(spark, sf).select("family", "quarter", "actual_usd")
    actual = grid(spark, sf).select("family", "quarter", F.col("target_usd").alias("actual_usd"))
    kept = actual.join(stored.select("family", "quarter"), ["family", "quarter"], "left_semi")
    return check_close(stored, kept, ["family", "quarter"], ["actual_usd"], 1e-6)


@query(
    "j10_full_and_strict_in_one_pass",
    f"""
    WITH {PARENTS}
    SELECT family, count(*) AS all_rows, CAST(sum(pool_cents) AS BIGINT) AS all_cents,
           count(*) FILTER (strict) AS strict_rows, CAST(sum(pool_cents) FILTER (strict) AS BIGINT) AS strict_cents
    FROM parents GROUP BY family
    """,
)
def full_and_strict_in_one_pass(spark, sf):
    return quality_sensitivity(parents(spark, sf), ["family"], "strict", "pool_cents").select(
        "family", "all_rows", "all_cents", "strict_rows", "strict_cents"
    )


@query(
    "j11_pages_with_labels",
    """
    SELECT doc_id, source, quality, toxic FROM documents JOIN labels USING (doc_id)
    """,
)
def pages_with_labels(spark, sf):
    """Content joined to its metadata record on the shared id; both are required."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return docs.join(table(spark, sf, "labels"), "doc_id", "inner")


# --- set operations ---------------------------------------------------------------


@query(
    "t01_union_of_policies",
    f"""
    WITH {PARENTS}
    SELECT 'source' AS policy, family, CAST(sum(pool_cents) AS BIGINT) AS pool_cents FROM parents GROUP BY ALL
    UNION ALL
    SELECT 'strict', family, CAST(sum(pool_cents) AS BIGINT) FROM parents WHERE strict GROUP BY ALL
    """,
)
def union_of_policies(spark, sf):
    p = parents(spark, sf)

    def total(policy, rows):
        return rows.groupBy("family").agg(F.sum("pool_cents").alias("pool_cents")).withColumn(
            "policy", F.lit(policy)
        )

    return j.union_all(total("source", p), total("strict", p.where(F.col("strict"))))


@query(
    "t02_set_difference",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def set_difference(spark, sf):
    pending = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P")
    return j.minus(
        table(spark, sf, "customer"),
        pending.select(F.col("o_custkey").alias("c_custkey")),
        ["c_custkey"],
    )


@query(
    "t03_set_intersection",
    """
    SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT
    SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
    """,
)
def set_intersection(spark, sf):
    o = table(spark, sf, "orders")
    return j.common(
        o.where(F.col("o_orderstatus") == "P"),
        o.where(F.col("o_orderpriority") == "1-URGENT"),
        ["o_custkey"],
    )


@query(
    "t04_set_equality",
    """
    SELECT *, only_left = 0 AND only_right = 0 AS same_set FROM (SELECT
      (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS only_left,
      (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS only_right)
    """,
)
def set_equality(spark, sf):
    return j.set_difference_sizes(
        table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")),
        table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")),
        ["k"],
    )


@query("t05_distinct_rows", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query(
    "t06_predictions_long",
    f"""
    WITH {PREDICTIONS}
    SELECT family, quarter, period_start, split, target_policy, round(actual_usd, 4) AS actual_usd,
           evaluation_available, evaluation_status, protocol, model, model_label,
           round(predicted_usd, 4) AS predicted_usd, round(residual_usd, 4) AS residual_usd,
           round(absolute_error_usd, 4) AS absolute_error_usd, error_direction,
           is_primary_model, is_baseline_model
    FROM long
    """,
)
def predictions_in_long_form(spark, sf):
    out = long_predictions(spark, sf).drop("squared_error_usd2")
    money = ["actual_usd", "predicted_usd", "residual_usd", "absolute_error_usd"]
    return out.withColumns({c: F.round(c, 4) for c in money})


@query(
    "t07_status_columns",
    """
    SELECT o_orderpriority AS family, count(*) FILTER (o_orderstatus = 'F') AS "F",
           count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P"
    FROM orders GROUP BY ALL
    """,
)
def status_columns(spark, sf):
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("family"))
        .pivot("o_orderstatus", ["F", "O", "P"])
        .count()
        .na.fill(0)
    )


@query(
    "t08_overall_group",
    f"""
    WITH {PARENTS}
    SELECT version, CASE WHEN grouping(family) = 1 THEN 'Overall' ELSE family END AS family,
           count(*) AS n_rows, CAST(sum(pool_cents) AS BIGINT) AS pool_cents
    FROM parents GROUP BY GROUPING SETS ((version, family), (version))
    """,
)
def overall_group(spark, sf):
    out = parents(spark, sf).groupingSets(
        [["version", "family"], ["version"]], "version", "family"
    ).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("pool_cents").alias("pool_cents"),
        F.grouping("family").alias("g"),
    )
    return out.withColumn(
        "family", F.when(F.col("g") == 1, F.lit("Overall")).otherwise(F.col("family"))
    ).drop("g")


# --- ordering ------------------------------------------------------------------------


@query(
    "o1_multi_key_order",
    "SELECT o_orderpriority, o_orderdate::DATE AS day, o_orderkey FROM orders ORDER BY 1, 2, 3",
)
def multi_key_order(spark, sf):
    return (
        table(spark, sf, "orders")
        .select("o_orderpriority", F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
        .orderBy("o_orderpriority", "day", "o_orderkey")
    )


@query(
    "o2_largest_parents",
    f"WITH {PARENTS} SELECT parent_id, pool_cents FROM parents ORDER BY pool_cents DESC, parent_id LIMIT 20",
)
def largest_parents(spark, sf):
    return s.top_k(
        parents(spark, sf).select("parent_id", "pool_cents"),
        [F.col("pool_cents").desc(), F.col("parent_id")],
        20,
    )


@query(
    "o3_largest_differences",
    f"""
    WITH {PARENTS}, {CHILDREN}
    SELECT parent_id, abs(child_cents - pool_cents) AS abs_diff_cents FROM parents JOIN (
      SELECT parent_id, CAST(sum(prize_cents) AS BIGINT) AS child_cents FROM children GROUP BY parent_id)
      USING (parent_id) ORDER BY abs_diff_cents DESC, parent_id LIMIT 15
    """,
)
def largest_differences(spark, sf):
    from prizelens.operators.reconcile import reconcile_review

    review = reconcile_review(
        parents(spark, sf).select("parent_id", "pool_cents"),
        children(spark, sf), "parent_id", "pool_cents", "prize_cents", "team_name",
    )
    return s.top_k(
        review.select("parent_id", "abs_diff_cents"),
        [F.col("abs_diff_cents").desc(), F.col("parent_id")],
        15,
    )


@query(
    "o4_sample_of_bad_ids",
    """
    SELECT 'outside_scope' AS "check", count(*) AS bad_rows,
      (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM (
        SELECT o_orderkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' ORDER BY k LIMIT 20)) AS sample_ids
    FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'
    """,
)
def sample_of_bad_ids(spark, sf):
    out = run_checks(
        table(spark, sf, "orders"),
        {"outside_scope": F.col("o_orderdate") < "1996-01-01"},
        "o_orderkey",
    )
    return out.select("check", "bad_rows", F.array_join("sample_ids", ",").alias("sample_ids"))


@query(
    "o5_best_candidate",
    f"""
    WITH {PREDICTIONS}
    SELECT model, round(sqrt(avg((predicted_usd - actual_usd) ** 2)), 2) AS rmse FROM long
    WHERE split = 'validation' AND actual_usd IS NOT NULL GROUP BY model ORDER BY 2, 1 LIMIT 1
    """,
)
def best_candidate(spark, sf):
    rows = long_predictions(spark, sf).where(F.col("split") == "validation")
    scores = s.baseline_scores(rows, ["model"], "actual_usd", "predicted_usd")
    best = s.select_best(scores, [F.col("rmse"), F.col("mae"), F.col("model")])
    return best.select("model", F.round("rmse", 2).alias("rmse"))
