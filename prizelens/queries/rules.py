"""Rules, quarantine and checks (Q1-Q26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prizelens.functions.calendar import with_calendar
from prizelens.operators import checks as c
from prizelens.operators import rules as r
from prizelens.operators.grid import regularity
from prizelens.plans.attention import peak_check, quality_status
from prizelens.plans.audit import audit_clean_log
from prizelens.plans.cleaning import CleanLog, clean_log, judge_log, split_log
from prizelens.queries.registry import query
from prizelens.queries.shapes import (
    ATTENTION,
    CHILDREN,
    GRID,
    PARENTS,
    POOLS,
    USER_DAYS,
    attention,
    children,
    grid,
    parents,
    pools,
    table,
    user_days,
)
from prizelens.queries.sources import STATUS_OF, result_log
from prizelens.session import ensure_checkpoint_dir, new_run_dir

RULES = [
    ("too_large", "quantity > 48"),
    ("too_cheap", "discount >= 0.1"),
    ("returned", "flag = 'R' AND line = 1"),
]

REASON = """CASE WHEN quantity > 48 THEN 'too_large' WHEN discount >= 0.1 THEN 'too_cheap'
         WHEN flag = 'R' AND line = 1 THEN 'returned' END"""


def _judged(spark, sf):
    rules = [(code, F.expr(condition)) for code, condition in RULES]
    return children(spark, sf).withColumn("reason", r.first_reason(rules))


@query(
    "q01_first_failing_rule",
    f"""
    WITH {CHILDREN}
    SELECT parent_id, line, team_id, team_name, prize_cents, {REASON} AS reason FROM children
    """,
)
def first_failing_rule(spark, sf):
    return _judged(spark, sf).select(
        "parent_id", "line", "team_id", "team_name", "prize_cents", "reason"
    )


@query(
    "q02_group_veto",
    f"""
    WITH {CHILDREN}, judged AS (SELECT *, {REASON} AS reason FROM children), veto AS (
      SELECT parent_id, reason AS veto_reason FROM judged WHERE reason IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY pos) = 1)
    SELECT parent_id, max(veto_reason) AS veto_reason, count(*) AS rejected_rows
    FROM children JOIN veto USING (parent_id) GROUP BY parent_id
    """,
)
def group_veto(spark, sf):
    judged = _judged(spark, sf)
    veto = r.group_veto(judged, "parent_id", F.col("pos"), "reason")
    sizes = judged.groupBy("parent_id").agg(F.count(F.lit(1)).alias("rejected_rows"))
    return veto.join(sizes, "parent_id")


@query(
    "q02_children_without_veto",
    f"""
    WITH {CHILDREN}, judged AS (SELECT *, {REASON} AS reason FROM children)
    SELECT parent_id, line, team_id, team_name, prize_cents FROM children
    WHERE parent_id NOT IN (SELECT parent_id FROM judged WHERE reason IS NOT NULL)
    """,
)
def children_without_veto(spark, sf):
    judged = _judged(spark, sf)
    veto = r.group_veto(judged, "parent_id", F.col("pos"), "reason")
    return r.apply_veto(judged, veto, "parent_id").select(
        "parent_id", "line", "team_id", "team_name", "prize_cents"
    )


# --- the whole cleaning flow on a log with planted faults ------------------------

FAULTS = """faults AS (
    SELECT p.parent_id, p.family, p.owner_id, p.version, p.start_date, pool_cents,
           CAST(owner_id % 10 AS INTEGER) AS fault,
           CASE p.version WHEN 'P' THEN 'needs_review'
             ELSE CASE WHEN p.parent_id % 5 = 0 THEN 'matched'
                       WHEN p.parent_id % 5 IN (1, 2) THEN 'rounding_difference'
                       ELSE 'matched' END END AS status
    FROM (SELECT parent_id, family, owner_id, version, start_date FROM parents) p
    LEFT JOIN pools USING (parent_id)),
  bad AS (
    SELECT parent_id, reason FROM (
      SELECT parent_id, pos, CASE
        WHEN repeated THEN 'duplicate_team_name'
        WHEN line = 7 AND flag = 'R' THEN 'supplementary_roster_allocation_needs_review'
        WHEN line = 6 AND flag = 'N' AND quantity > 25 THEN 'missing_rank_and_outcome'
        END AS reason
      FROM (SELECT *, row_number() OVER (PARTITION BY parent_id, team_name, line = 7 AND flag = 'R'
                                         ORDER BY pos) > 1 AS repeated FROM children))
    WHERE reason IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY pos) = 1),
  judged AS (
    SELECT faults.*, bad.reason AS child_reason, CASE
        WHEN family = '1-URGENT' THEN 'game_outside_scope'
        WHEN fault = 0 THEN 'failed_or_missing_tournament'
        WHEN fault = 1 THEN 'tournament_id_mismatch'
        WHEN fault = 2 THEN 'game_id_mismatch'
        WHEN fault = 3 THEN 'source_url_mismatch'
        WHEN fault = 4 THEN 'missing_tournament_name'
        WHEN fault = 5 THEN 'invalid_date'
        WHEN pool_cents IS NULL THEN 'missing_money'
        WHEN fault = 6 THEN 'invalid_money'
        WHEN start_date NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' THEN 'start_date_outside_scope'
        WHEN family = '2-HIGH' AND year(start_date) < 1998 THEN 'game_version_date_needs_review'
        END AS parent_reason
    FROM faults LEFT JOIN bad USING (parent_id)),
  final AS (
    SELECT *, CASE WHEN parent_reason IS NULL THEN CASE
        WHEN status = 'needs_review' THEN 'prize_allocation_pending_review'
        WHEN child_reason IS NOT NULL THEN child_reason
        WHEN parent_id % 5 IN (3, 4) THEN 'stored_reconciliation_status_mismatch' END END AS note
    FROM judged)"""


def _faulty_log(spark, sf):
    """Log rows with faults planted by owner, plus natural child faults."""
    p = parents(spark, sf).select(
        "parent_id", "owner_id", "family", "version", "start_date"
    ).join(pools(spark, sf), "parent_id", "left")
    key = F.col("parent_id").cast("string")
    url = F.concat(F.lit("https://example.org/tournaments/"), key)
    fault = F.pmod(F.col("owner_id"), F.lit(10))
    line, flag = F.col("line"), F.col("flag")
    coach = (line == 7) & (flag == "R")
    item_url = F.concat(
        F.lit("https://example.org/tournaments/"), F.col("parent_id").cast("string")
    )
    unranked = (line == 6) & (flag == "N")
    rank = F.when(~unranked, line.cast("string"))
    usd = (F.col("prize_cents").cast("decimal(20,0)") / 100).cast("decimal(18,2)")
    families = parents(spark, sf).select("parent_id", F.col("family").alias("slug"))
    items = (
        children(spark, sf)
        .join(families, "parent_id")
        .groupBy("parent_id")
        .agg(
            F.to_json(
                F.transform(
                    F.array_sort(
                        F.collect_list(
                            F.struct(
                                "pos",
                                F.col("parent_id").cast("string").alias("source_tournament_id"),
                                item_url.alias("source_url"),
                                F.col("slug").alias("game_slug"),
                                F.col("team_id").cast("string").alias("source_team_id"),
                                F.concat(
                                    F.when(coach, F.lit(" Team Coaches  ")).otherwise(F.lit("Team ")),
                                    F.col("team_name"),
                                ).alias("team_name_raw"),
                                usd.cast("string").alias("prize_money_usd"),
                                rank.alias("rank_min"),
                                rank.alias("rank_max"),
                                F.when(
                                    unranked & (F.col("quantity") <= 25), F.lit("WIN")
                                ).alias("result_outcome"),
                            )
                        )
                    ),
                    lambda i: i.dropFields("pos"),
                )
            ).alias("placements_json")
        )
    )
    day = F.col("start_date")
    pool = (F.col("pool_cents").cast("decimal(20,0)") / 100).cast("decimal(18,2)")
    status = (
        F.when(F.col("version") == "P", F.lit("needs_review"))
        .when(F.pmod("parent_id", F.lit(5)).isin(1, 2), F.lit("rounding_difference"))
        .otherwise(F.lit("matched"))
    )
    return p.join(items, "parent_id", "left").select(
        key.alias("tournament_id"),
        F.col("family").alias("game_slug"),
        F.concat(F.lit("g"), F.substring("family", 1, 1)).alias("source_game_id"),
        url.alias("source_url"),
        F.when(fault == 0, F.lit("failed")).otherwise(status).alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("html_file"),
        F.lit(None).cast("string").alias("crawled_at"),
        F.lit(None).cast("string").alias("updated_at"),
        F.to_json(
            F.struct(
                F.when(fault == 1, F.lit("0x")).otherwise(key).alias("source_tournament_id"),
                F.when(fault == 2, F.lit("other"))
                .otherwise(F.concat(F.lit("g"), F.substring("family", 1, 1)))
                .alias("source_game_id"),
                F.when(fault == 3, F.lit("http://elsewhere")).otherwise(url).alias("source_url"),
                F.when(fault == 4, F.lit("  ")).otherwise(F.concat(F.lit("Cup "), key)).alias(
                    "tournament_name_raw"
                ),
                day.cast("string").alias("start_date"),
                F.when(fault == 5, F.date_sub(day, 1)).otherwise(F.date_add(day, 2))
                .cast("string").alias("end_date"),
                F.when(fault == 6, -pool).otherwise(pool).cast("string").alias("prize_pool_usd"),
            )
        ).alias("tournament_json"),
        "placements_json",
        F.lit(None).cast("string").alias("audit_json"),
    )


def _config(spark, sf):
    return (
        table(spark, sf, "orders")
        .select(F.col("o_orderpriority").alias("game_slug"))
        .distinct()
        .where(F.col("game_slug") != "1-URGENT")
        .select(
            "game_slug",
            F.col("game_slug").alias("game_id"),
            F.concat(F.lit("g"), F.substring("game_slug", 1, 1)).alias("earnings_game_id"),
            F.col("game_slug").alias("game_family"),
            F.col("game_slug").alias("game_name"),
        )
    )


def _cleaned(spark, sf):
    return clean_log(
        _faulty_log(spark, sf), _config(spark, sf), "1996-01-01", "2000-12-31", {"2-HIGH": 1998}
    )


def _stored_cleaned(spark, sf):
    """``_cleaned`` for flows that read several outputs: the log is judged and stored once."""
    path = new_run_dir(spark, "judged")
    judge_log(
        _faulty_log(spark, sf), _config(spark, sf), "1996-01-01", "2000-12-31", {"2-HIGH": 1998}
    ).write.parquet(path)
    return split_log(spark.read.parquet(path))


@query(
    "q03_cleaning_quarantine",
    f"""
    WITH {PARENTS}, {CHILDREN}, {POOLS}, {FAULTS}
    SELECT CAST(parent_id AS VARCHAR) AS tournament_id, parent_reason AS reason, 'both' AS affected_table
    FROM final WHERE parent_reason NOT IN ('game_outside_scope', 'start_date_outside_scope')
    UNION ALL
    SELECT CAST(parent_id AS VARCHAR), note, 'placements' FROM final WHERE note IS NOT NULL
    UNION ALL
    SELECT CAST(parent_id AS VARCHAR), 'ambiguous_source_team_id', 'team_identity' FROM final
    WHERE parent_reason IS NULL AND note IS NULL AND parent_id IN (
        SELECT parent_id FROM children GROUP BY parent_id, team_id HAVING count(DISTINCT team_name) > 1)
    """,
)
def cleaning_quarantine(spark, sf):
    return _cleaned(spark, sf).quarantine.select("tournament_id", "reason", "affected_table")


@query(
    "q02_cleaning_parents",
    f"""
    WITH {PARENTS}, {CHILDREN}, {POOLS}, {FAULTS}
    SELECT 'earnings:' || parent_id AS tournament_id, start_date, pool_cents,
           year(start_date) || 'Q' || quarter(start_date) AS quarter, note IS NULL AS eligible,
           coalesce(note, CASE WHEN parent_id IN (
               SELECT parent_id FROM children GROUP BY parent_id, team_id
               HAVING count(DISTINCT team_name) > 1) THEN 'ambiguous_source_team_id' END) AS quality_note
    FROM final WHERE parent_reason IS NULL
    """,
)
def cleaning_parents(spark, sf):
    return _cleaned(spark, sf).parents.select(
        "tournament_id", "start_date", "pool_cents", "quarter", "eligible", "quality_note"
    )


@query(
    "q02_cleaning_children",
    f"""
    WITH {PARENTS}, {CHILDREN}, {POOLS}, {FAULTS}
    SELECT 'earnings:' || parent_id AS tournament_id, count(*) AS n_rows,
           CAST(sum(prize_cents) AS BIGINT) AS prize_cents,
           max(final.status) AS validation_status
    FROM final JOIN children USING (parent_id)
    WHERE parent_reason IS NULL AND note IS NULL GROUP BY ALL
    """,
)
def cleaning_children(spark, sf):
    return (
        _cleaned(spark, sf)
        .children.groupBy("tournament_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("prize_cents").alias("prize_cents"),
            F.max("validation_status").alias("validation_status"),
        )
    )


@query(
    "q04_complete_cleaning_partition",
    f"""
    WITH {PARENTS}
    SELECT count(*) AS n_input, CAST(0 AS BIGINT) AS misplaced FROM parents
    """,
)
def complete_cleaning_partition(spark, sf):
    log = _faulty_log(spark, sf)
    out = _stored_cleaned(spark, sf)
    blocked = out.quarantine.where(F.col("affected_table") == "both")
    clean = out.parents.select(
        F.regexp_replace("tournament_id", "^earnings:", "").alias("tournament_id")
    )
    misplaced = c.partition_check(
        log, {"clean": clean, "out": out.out_of_scope, "blocked": blocked}, "tournament_id"
    )
    one = F.lit(1).alias("one")
    return (
        log.agg(F.count(F.lit(1)).alias("n_input"))
        .select("*", one)
        .join(misplaced.agg(F.count(F.lit(1)).alias("misplaced")).select("*", one), "one")
        .drop("one")
    )


@query(
    "q10_clean_log_audit",
    f"""
    WITH {PARENTS}, {CHILDREN}, {POOLS}, {FAULTS},
    p AS (SELECT * FROM final WHERE parent_reason IS NULL),
    bad_year AS (SELECT count(*) AS n FROM p WHERE parent_id % 97 = 0),
    bad_sum AS (SELECT count(*) AS n FROM p WHERE note IS NULL AND parent_id % 89 = 0),
    lost AS (SELECT count(*) AS n FROM p WHERE note IS NULL AND parent_id % 83 = 0 AND parent_id % 89 <> 0)
    SELECT name AS "check", n = 0 AS passed, n AS bad_rows FROM (
      SELECT unnest(['parents: key_empty_or_repeated', 'children: key_empty_or_repeated', 'parents: id_without_source',
        'parents: game_out_of_scope', 'parents: start_date_out_of_scope', 'parents: quarter_differs', 'parents: range_invalid',
        'parents: money_invalid', 'children: id_without_source', 'children: game_out_of_scope', 'children: start_date_out_of_scope',
        'children: ambiguous_id_kept', 'children: name_empty_or_repeated', 'children: status_not_accepted', 'children: money_invalid',
        'children: parent_missing', 'children: differs_from_parent', 'places: not_in_exactly_one', 'places: blocked_but_clean',
        'places: review_but_children', 'children: fewer_than_required']) AS name, 0 AS n
      UNION ALL SELECT 'parents: year_differs', n FROM bad_year
      UNION ALL SELECT 'totals: sum_or_status_differs', n FROM bad_sum
      UNION ALL SELECT 'totals: eligible_without_children', n FROM lost)
    """,
)
def clean_log_audit(spark, sf):
    """The audit finds what was done to the cleaned tables: years, amounts and lost children."""
    ensure_checkpoint_dir(spark)
    log, out = _faulty_log(spark, sf), _stored_cleaned(spark, sf)
    number = F.regexp_replace("tournament_id", "^earnings:", "").cast("bigint")
    changed = CleanLog(
        parents=out.parents.withColumn("year", F.col("year") + (number % 97 == 0).cast("int")).checkpoint(),
        children=out.children.where((number % 83 != 0) | (number % 89 == 0)).withColumn(
            "prize_cents", F.col("prize_cents") + F.when(number % 89 == 0, 1000).otherwise(0)
        ).checkpoint(),
        quarantine=out.quarantine.select("tournament_id", "reason", "affected_table").checkpoint(),
        out_of_scope=out.out_of_scope.checkpoint(),
    )
    slugs = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return audit_clean_log(log, changed, slugs, "1996-01-01", "2000-12-31").drop("sample_ids")


@query(
    "q03_quarantine_record",
    f"""
    WITH {PARENTS}
    SELECT CAST(parent_id AS VARCHAR) AS record_id, quality_note AS reason,
           'placements' AS affected_table, version AS source,
           '{{"parent_id":' || parent_id || ',"family":"' || family || '","pool_cents":' || pool_cents || '}}' AS payload
    FROM parents WHERE quality_note IS NOT NULL
    """,
)
def quarantine_record(spark, sf):
    return r.to_quarantine(
        parents(spark, sf), "parent_id", "quality_note", "placements", "version",
        ["parent_id", "family", "pool_cents"],
    )


@query(
    "q04_complete_partition",
    f"""
    WITH {PARENTS} SELECT parent_id, CAST(1 AS BIGINT) AS in_input, CAST(2 AS BIGINT) AS in_parts FROM parents WHERE version = 'F'
    """,
)
def complete_partition(spark, sf):
    p = parents(spark, sf)
    return c.partition_check(
        p,
        {
            "clean": p.where(F.col("strict")),
            "out": p.where(~F.col("eligible")),
            "blocked": p.where(F.col("version").isin("P", "F")),
        },
        "parent_id",
    )


@query(
    "q05_ambiguous_ids",
    f"""
    WITH {CHILDREN}, amb AS (
      SELECT parent_id, flag FROM children GROUP BY ALL HAVING count(DISTINCT team_name) > 1)
    SELECT c.parent_id, line, team_name, prize_cents, c.flag AS flag_raw,
           CASE WHEN a.flag IS NULL THEN c.flag END AS flag,
           CASE WHEN a.flag IS NOT NULL THEN 'ambiguous_source_id'
                ELSE 'source_provided_not_verified' END AS identity_status
    FROM children c LEFT JOIN amb a USING (parent_id, flag)
    """,
)
def ambiguous_ids(spark, sf):
    return r.null_ambiguous_ids(children(spark, sf), "parent_id", "flag", "team_name").select(
        "parent_id", "line", "team_name", "prize_cents", "flag_raw", "flag", "identity_status"
    )


@query(
    "q06_duplicate_within_parent",
    f"""
    WITH {CHILDREN}
    SELECT parent_id, line, team_id, team_name, prize_cents,
           row_number() OVER (PARTITION BY parent_id, line ORDER BY pos) > 1 AS is_repeat
    FROM children
    """,
)
def duplicate_within_parent(spark, sf):
    return r.duplicate_within(children(spark, sf), ["parent_id", "line"], "pos").select(
        "parent_id", "line", "team_id", "team_name", "prize_cents", "is_repeat"
    )


@query(
    "q07_duplicate_key_flag",
    f"""
    WITH {CHILDREN}
    SELECT parent_id, line, team_id, team_name, prize_cents,
           count(*) OVER (PARTITION BY parent_id, line) > 1 AS is_duplicated
    FROM children
    """,
)
def duplicate_key_flag(spark, sf):
    return r.flag_duplicates(children(spark, sf), ["parent_id", "line"]).select(
        "parent_id", "line", "team_id", "team_name", "prize_cents", "is_duplicated"
    )


@query(
    "q07_category_quality_status",
    """
    WITH cats AS (SELECT event_id, CAST(ts AS DATE) AS day,
        CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN ''
             ELSE event_type || user_id END AS category FROM events)
    SELECT event_id, CASE WHEN coalesce(category, '') = '' THEN 'missing_category'
        WHEN count(*) OVER (PARTITION BY category, day) > 1 THEN 'ambiguous_category_month'
        ELSE 'usable' END AS quality_status FROM cats
    """,
)
def category_quality_status(spark, sf):
    kind = F.col("event_type")
    cats = table(spark, sf, "events").select(
        "event_id",
        F.col("ts").cast("date").alias("day"),
        F.when(kind == "signup", F.lit("  "))
        .when(kind != "error", F.concat(F.lit(" "), kind, "user_id"))
        .alias("category"),
    )
    return quality_status(cats, "category", "day").select("event_id", "quality_status")


IQR = """SELECT family, {id} {x}, {x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1) AS {x}_iqr_flag
    FROM {t} JOIN (SELECT family, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3
                   FROM {t} GROUP BY family) USING (family)"""


@query(
    "q08_iqr_flag",
    f"WITH {ATTENTION} " + IQR.format(id="day,", x="hours", t="attention"),
)
def iqr_flag(spark, sf):
    return r.iqr_flag(attention(spark, sf), ["family"], "hours").select(
        "family", "day", "hours", "hours_iqr_flag"
    )


@query(
    "q08_iqr_flag_raw_rows",
    f"WITH {CHILDREN}, t AS (SELECT flag AS family, * EXCLUDE (flag) FROM children) "
    + IQR.format(id="parent_id, line, team_id, team_name,", x="prize_cents", t="t"),
)
def iqr_flag_raw_rows(spark, sf):
    rows = children(spark, sf).withColumnRenamed("flag", "family")
    return r.iqr_flag(rows, ["family"], "prize_cents").select(
        "family", "parent_id", "line", "team_id", "team_name", "prize_cents",
        "prize_cents_iqr_flag",
    )


@query(
    "q09_peak_at_least_average",
    f"""
    WITH {ATTENTION}
    SELECT 'peak_below_average' AS "check", count(*) FILTER (peak < average) = 0 AS passed,
           count(*) FILTER (peak < average) AS bad_rows FROM attention
    """,
)
def peak_at_least_average(spark, sf):
    return peak_check(attention(spark, sf), "day", "peak", "average").select(
        "check", "passed", "bad_rows"
    )


SAMPLE_SQL = """SELECT '{name}' AS "check", count(*) = 0 AS passed, count(*) AS bad_rows,
    coalesce((SELECT string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FROM (
        SELECT DISTINCT parent_id AS i FROM parents WHERE {cond} ORDER BY i LIMIT 20)), '') AS sample_ids
    FROM parents WHERE {cond}"""


@query(
    "q10_check_suite",
    f"WITH {PARENTS} "
    + " UNION ALL ".join(
        SAMPLE_SQL.format(name=n, cond=x)
        for n, x in {
            "pool_missing": "pool_cents IS NULL",
            "pool_above_limit": "pool_cents > 49000000",
            "strict_but_noted": "strict AND quality_note IS NOT NULL",
            "not_eligible": "NOT eligible",
        }.items()
    ),
)
def check_suite(spark, sf):
    return c.run_checks(
        parents(spark, sf),
        {
            "pool_missing": F.col("pool_cents").isNull(),
            "pool_above_limit": F.col("pool_cents") > 49000000,
            "strict_but_noted": F.col("strict") & F.col("quality_note").isNotNull(),
            "not_eligible": ~F.col("eligible"),
        },
        "parent_id",
    ).withColumn("sample_ids", F.array_join("sample_ids", ","))


@query(
    "q11_key_check",
    """
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS empty_key_rows, count(*) FILTER (n > 1) AS repeated_keys,
           count(*) FILTER (n > 1) = 0 AS passed
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
    """,
)
def key_check(spark, sf):
    return c.check_key(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "q12_orphans",
    f"""
    WITH {PARENTS}, {CHILDREN}
    SELECT parent_id, count(*) AS orphan_rows FROM children
    WHERE parent_id NOT IN (SELECT parent_id FROM parents WHERE eligible) GROUP BY parent_id
    """,
)
def orphans(spark, sf):
    eligible = parents(spark, sf).where(F.col("eligible"))
    return c.check_parent(children(spark, sf), eligible, "parent_id")


@query(
    "q13_inherited_attributes",
    f"""
    WITH {PARENTS}, {CHILDREN}
    SELECT 'family' AS column_name, count(*) FILTER (line = 7) AS differing_rows,
           count(*) FILTER (line = 7) = 0 AS passed FROM children
    UNION ALL SELECT 'start_date', 0, true
    UNION ALL SELECT 'quality_note', count(*) FILTER (quality_note IS NOT NULL AND line = 6),
           count(*) FILTER (quality_note IS NOT NULL AND line = 6) = 0
    FROM children JOIN parents USING (parent_id)
    """,
)
def inherited_attributes(spark, sf):
    p = parents(spark, sf).select("parent_id", "family", "start_date", "quality_note")
    kids = children(spark, sf).select("parent_id", "line").join(p, "parent_id")
    line = F.col("line")
    kids = kids.withColumns(
        {
            "family": F.when(line == 7, F.lit("other")).otherwise(F.col("family")),
            "quality_note": F.when(line != 6, F.col("quality_note")),
        }
    )
    return c.check_inherited(kids, p, "parent_id", ["family", "start_date", "quality_note"])


@query(
    "q14_calendar_consistency",
    f"""
    WITH {PARENTS}
    SELECT 'year_differs' AS "check", count(*) FILTER (version = 'P') AS bad_rows FROM parents
    UNION ALL SELECT 'quarter_differs', 0
    """,
)
def calendar_consistency(spark, sf):
    dated = with_calendar(parents(spark, sf), "start_date")
    stored = dated.withColumn(
        "year", F.when(F.col("version") == "P", F.col("year") + 1).otherwise(F.col("year"))
    )
    return c.run_checks(stored, c.check_calendar(stored, "start_date"), "parent_id").select(
        "check", "bad_rows"
    )


@query(
    "q15_mapping_consistency",
    """
    SELECT event_type, CASE WHEN user_id = 1 THEN 'x' ELSE upper(event_type) END AS label, count(*) AS n_rows,
           CASE WHEN event_type IN ('view', 'click', 'purchase') THEN upper(event_type) END AS expected,
           CASE WHEN user_id = 1 THEN 'x' ELSE upper(event_type) END IS NOT DISTINCT FROM
           CASE WHEN event_type IN ('view', 'click', 'purchase') THEN upper(event_type) END AS consistent
    FROM events GROUP BY ALL
    """,
)
def mapping_consistency(spark, sf):
    df = table(spark, sf, "events").withColumn(
        "label",
        F.when(F.col("user_id") == 1, F.lit("x")).otherwise(F.upper("event_type")),
    )
    return c.check_mapping(
        df, "event_type", "label",
        {"view": "VIEW", "click": "CLICK", "purchase": "PURCHASE"},
    )


@query(
    "q16_conservation",
    f"""
    WITH {PARENTS}
    SELECT 'money' AS measure, CAST(sum(pool_cents) AS BIGINT) AS total_before,
           CAST(sum(pool_cents) AS BIGINT) AS total_after, true AS conserved FROM parents
    UNION ALL SELECT 'rows', count(*), count(*), true FROM parents
    """,
)
def conservation(spark, sf):
    return c.check_conserved(
        parents(spark, sf),
        grid(spark, sf),
        {
            "money": (F.sum("pool_cents"), F.sum("pool_cents")),
            "rows": (F.count(F.lit(1)), F.sum("observed_count")),
        },
    )


@query(
    "q17_table_equality",
    """
    SELECT count(*) FILTER (l_linenumber = 7) AS only_left, count(*) FILTER (l_linenumber = 7) AS only_right,
           count(*) FILTER (l_linenumber = 7) = 0 AS equal FROM lineitem
    """,
)
def table_equality(spark, sf):
    a = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    line = F.col("l_linenumber")
    b = a.withColumn("l_linenumber", F.when(line == 7, F.lit(8)).otherwise(line))
    return c.check_equal(a, b, a.columns)


@query(
    "q18_close_values",
    f"""
    WITH {USER_DAYS}
    SELECT 'hours' AS column_name, count(*) FILTER (n_rows % 3 = 2) AS bad_rows,
           count(*) FILTER (n_rows % 3 = 2) = 0 AS passed FROM user_days
    UNION ALL SELECT 'n_rows', 0, true
    """,
)
def close_values(spark, sf):
    a = user_days(spark, sf)
    b = a.withColumn("hours", F.col("hours") + F.col("n_rows") % 3 * 0.01)
    return c.check_close(a, b, ["family", "day"], ["hours", "n_rows"], 0.015)


@query(
    "q19_expected_counts",
    """
    SELECT metric, coalesce(a.n, 0) AS actual, coalesce(b.n, 0) AS expected,
           coalesce(a.n, 0) - coalesce(b.n, 0) AS difference,
           CASE WHEN coalesce(a.n, 0) = coalesce(b.n, 0) THEN 'match' ELSE 'mismatch' END AS verdict
    FROM (SELECT o_orderstatus AS metric, count(*) AS n FROM orders GROUP BY ALL) a
    FULL JOIN (SELECT l_linestatus AS metric, count(*) AS n FROM lineitem GROUP BY ALL) b USING (metric)
    """,
)
def expected_counts(spark, sf):
    actual = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("metric")).agg(
        F.count(F.lit(1)).alias("value")
    )
    expected = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("metric")).agg(
        F.count(F.lit(1)).alias("value")
    )
    return c.compare_counts(actual, expected)


@query(
    "q20_regular_grid",
    f"""
    WITH {USER_DAYS}
    SELECT *, n_rows = expected AND n_periods = expected AS regular FROM (
      SELECT family, count(*) AS n_rows, count(DISTINCT day) AS n_periods, min(day) AS first_period,
             max(day) AS last_period, CAST(max(day) - min(day) + 1 AS BIGINT) AS expected
      FROM user_days GROUP BY family)
    """,
)
def regular_grid(spark, sf):
    return regularity(user_days(spark, sf), "family", "day", "day")


@query(
    "q20_regular_quarter_grid",
    f"""
    WITH {GRID}
    SELECT family, count(*) AS n_rows, true AS regular FROM grid GROUP BY family
    """,
)
def regular_quarter_grid(spark, sf):
    return regularity(grid(spark, sf), "family", "period_start", "quarter").select(
        "family", "n_rows", "regular"
    )


@query(
    "q21_reference_values",
    """
    SELECT s_suppkey, CASE s_nationkey WHEN 5 THEN 'missing_in_reference' WHEN 6 THEN 'missing_in_data'
                      ELSE concat_ws(' | ', CASE WHEN s_nationkey = 3 THEN 's_acctbal' END,
                                            CASE WHEN s_nationkey IN (3, 4) THEN 's_name' END) END AS differing_fields,
           s_nationkey NOT IN (3, 4, 5, 6) AS accepted FROM supplier
    """,
)
def reference_values(spark, sf):
    df = table(spark, sf, "supplier")
    nation = F.col("s_nationkey")
    reference = df.withColumns(
        {
            "s_acctbal": F.when(nation == 3, F.col("s_acctbal") + 0.5).otherwise(
                F.col("s_acctbal") + 1e-8
            ),
            "s_name": F.when(nation.isin(3, 4), F.lit("?")).otherwise(F.col("s_name")),
        }
    )
    # Keys of one side only: neither side may lose them.
    reference, df = reference.where(nation != 5), df.where(nation != 6)
    return c.compare_reference(df, reference, "s_suppkey", ["s_acctbal"], ["s_name"])


@query(
    "q22_conflicting_metadata",
    """
    SELECT l_partkey, count(*) AS observations, count(DISTINCT (l_returnflag, l_linestatus)) AS variants,
           CASE WHEN count(DISTINCT (l_returnflag, l_linestatus)) > 1 THEN 'needs_metadata_review'
                ELSE 'consistent' END AS review_status
    FROM lineitem GROUP BY l_partkey
    """,
)
def conflicting_metadata(spark, sf):
    return r.flag_conflicts(
        table(spark, sf, "lineitem"), ["l_partkey"], ["l_returnflag", "l_linestatus"]
    )


@query(
    "q23_same_content_sets",
    """
    WITH s AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n_items,
               string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS items
               FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, n_items, CASE WHEN m <> l_orderkey THEN m END AS same_set_as
    FROM (SELECT *, min(l_orderkey) OVER (PARTITION BY items) AS m FROM s)
    """,
)
def same_content_sets(spark, sf):
    return r.duplicate_sets(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "q24_review_queue",
    f"""
    WITH {PARENTS}, s AS (SELECT family, {STATUS_OF} AS status FROM parents)
    SELECT family AS game_slug, count(*) AS n_rows, count(*) FILTER (status = 'needs_review') AS needs_review,
           count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'failed') AS failed
    FROM s GROUP BY family
    """,
)
def review_queue(spark, sf):
    return c.review_queue(
        result_log(spark, sf), "game_slug", "status", ["needs_review", "matched", "failed"]
    )


@query(
    "q25_disjoint_sets",
    f"WITH {PARENTS} SELECT count(*) AS shared_keys, count(*) = 0 AS disjoint FROM parents WHERE version = 'P'",
)
def disjoint_sets(spark, sf):
    p = parents(spark, sf)
    return c.check_disjoint(
        p.where(F.col("eligible")), p.where(F.col("quality_note").isNotNull()), "parent_id"
    )


@query(
    "q26_minimum_rows",
    "SELECT count(*) AS n_rows, CAST(2000 AS BIGINT) AS minimum, count(*) >= 2000 AS met FROM lineitem",
)
def minimum_rows(spark, sf):
    return c.check_min_rows(table(spark, sf, "lineitem"), 2000)
