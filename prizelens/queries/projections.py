"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from prizelens.functions import calendar as cal
from prizelens.functions import money as m
from prizelens.functions import text as t
from prizelens.functions.urls import canonical_url, url_matches_id
from prizelens.operators.checks import numeric_checks, run_checks
from prizelens.operators.joins import apply_null_policy, complete_pairs
from prizelens.operators.stats import data_dictionary
from prizelens.queries.registry import query
from prizelens.queries.shapes import (
    ATTENTION,
    CHILDREN,
    PANEL,
    PARENTS,
    attention,
    children,
    panel,
    parents,
    table,
)
from prizelens.sources.tables import lower_columns, with_literals, with_source_file

BLANK_SQL = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(
    "p01_clean_text",
    f"""
    SELECT doc_id, sha256(x) AS cleaned_sha256, CAST(length(x) AS INTEGER) AS n FROM (
      SELECT doc_id, nullif(trim(regexp_replace(nfc_normalize(text), '{BLANK_SQL}', ' ', 'g')), '') AS x
      FROM documents)
    """,
)
def clean_text(spark, sf):
    x = t.clean_text(F.col("text"))
    return (
        table(spark, sf, "documents")
        .select("doc_id", x.alias("x"))
        .select("doc_id", F.sha2("x", 256).alias("cleaned_sha256"), F.length("x").alias("n"))
    )


@query(
    "p02_name_key",
    """
    SELECT conv_id, turn, sha256(replace(lower(text), 'ß', 'ss')) AS key_sha256
    FROM conversations
    """,
)
def name_key(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.sha2(t.name_key(F.col("text")), 256).alias("key_sha256")
    )


# Amount text with planted faults; every row is used.
RAW_MONEY = (
    "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'R' AND l_linenumber = 6 "
    "THEN 'NaN' WHEN l_linenumber = 5 THEN '-' || CAST(l_partkey AS VARCHAR) "
    "WHEN l_linenumber = 4 THEN CAST(l_partkey AS VARCHAR) || '.005' "
    "ELSE CAST(l_partkey AS VARCHAR) || '.25' END"
)


def _raw_money(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.expr(RAW_MONEY.replace("VARCHAR", "STRING")).alias("raw"),
    )


@query(
    "p03_money",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN v >= 0 THEN v END AS amount,
           CASE WHEN raw IS NULL THEN 'missing_money'
                WHEN v IS NULL OR v < 0 THEN 'invalid_money' END AS reason
    FROM (SELECT *, try_cast(raw AS DECIMAL(18,2)) AS v
          FROM (SELECT *, {RAW_MONEY} AS raw FROM lineitem))
    """,
)
def money(spark, sf):
    return _raw_money(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        m.money(F.col("raw")).alias("amount"),
        m.money_reason(F.col("raw")).alias("reason"),
    )


@query(
    "p04_to_cents",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN v >= 0 AND v = round(v, 2) THEN CAST(v * 100 AS BIGINT) END AS cents
    FROM (SELECT *, try_cast(raw AS DECIMAL(20,6)) AS v
          FROM (SELECT *, {RAW_MONEY} AS raw FROM lineitem))
    """,
)
def to_cents(spark, sf):
    raw = F.concat(F.lit("$"), F.regexp_replace("raw", r"^(\d)(\d{3}\.)", "$1,$2"))
    return _raw_money(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        m.to_cents(raw).alias("cents"),
    )


@query(
    "p05_is_cent_exact",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           coalesce(v >= 0 AND v = round(v, 2), false) AS cent_exact
    FROM (SELECT *, try_cast(raw AS DECIMAL(20,6)) AS v
          FROM (SELECT *, {RAW_MONEY} AS raw FROM lineitem))
    """,
)
def is_cent_exact(spark, sf):
    return _raw_money(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        m.is_cent_exact(F.col("raw")).alias("cent_exact"),
    )


@query(
    "p06_strict_dates",
    """
    SELECT o_orderkey, a AS start_date, b AS end_date,
           CASE WHEN a IS NULL OR b IS NULL OR a > b THEN 'invalid_date' END AS reason
    FROM (SELECT o_orderkey,
        CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS a,
        CAST(o_orderdate AS DATE) + CAST(o_custkey % 5 AS INTEGER) - 2 AS b FROM orders)
    """,
)
def strict_dates(spark, sf):
    day = F.col("o_orderdate").cast("date")
    raw = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.date_format(day, "yyyy/MM/dd"))
        .otherwise(day.cast("string"))
        .alias("a"),
        F.date_add(day, (F.col("o_custkey") % 5 - 2).cast("int")).cast("string").alias("b"),
    )
    start, end = cal.parse_day(F.col("a")), cal.parse_day(F.col("b"))
    return raw.select(
        "o_orderkey",
        start.alias("start_date"),
        end.alias("end_date"),
        cal.range_reason(start, end).alias("reason"),
    )


@query(
    "p07_rank_number",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN raw >= 1 AND raw = floor(raw) THEN CAST(raw AS BIGINT) END AS rank,
           CASE WHEN raw < 1 OR raw <> floor(raw) THEN 'invalid_rank' END AS reason
    FROM (SELECT *, CAST(l_quantity / 2 - 1 AS DECIMAL(20,6)) AS raw FROM lineitem)
    """,
)
def rank_number(spark, sf):
    raw = (F.col("l_quantity") / 2 - 1).cast("string")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        m.rank_number(raw).alias("rank"),
        m.rank_number_reason(raw).alias("reason"),
    )


@query(
    "p08_rank_label",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN l_linenumber <= 5 THEN CAST(least(l_linenumber, l_quantity) AS INTEGER) END AS rank_min,
           CASE WHEN l_linenumber <= 5 THEN CAST(greatest(l_linenumber, l_quantity) AS INTEGER) END AS rank_max,
           CASE WHEN l_linenumber = 6 THEN 'WIN' END AS outcome,
           CASE WHEN l_linenumber > 6 THEN 'unreadable_rank' END AS error
    FROM lineitem
    """,
)
def rank_label(spark, sf):
    line, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    label = (
        F.when(line <= 5, F.concat(line, F.lit("th-"), q, F.lit("th")))
        .when(line == 6, F.lit(" win "))
        .otherwise(F.lit("n/a"))
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        m.parse_rank(label).alias("r"),
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r.*")


@query(
    "p09_extract_usd",
    """
    SELECT o_orderkey,
           CASE WHEN o_orderstatus = 'P' THEN NULL
                ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS usd
    FROM orders
    """,
)
def extract_usd(spark, sf):
    amount = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    status = F.col("o_orderstatus")
    text = F.when(
        status == "F", F.concat(F.lit("€9.00 ( $ "), amount, F.lit(" usd )"))
    ).otherwise(F.concat(F.lit("$"), amount))
    currency = F.when(status == "O", F.lit("usd ($)")).otherwise(F.lit("EUR"))
    return table(spark, sf, "orders").select(
        "o_orderkey", m.extract_usd(text, currency).alias("usd")
    )


@query(
    "p10_displayed_usd",
    """
    SELECT o_orderkey,
           CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS DECIMAL(18,2)) + 0.5 END AS usd
    FROM orders
    """,
)
def displayed_usd(spark, sf):
    # Some amounts are padded with zeros beyond any fixed prefix.
    zeros = F.when(F.col("o_orderkey") % 2 == 0, F.repeat(F.lit("0"), 45)).otherwise("")
    raw = F.concat(F.lit("$ "), zeros, F.col("o_custkey"), F.lit(".50"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        m.displayed_usd(
            F.when(F.col("o_orderstatus") == "P", F.concat(raw, F.lit("K"))).otherwise(raw)
        ).alias("usd"),
    )


@query(
    "p11_dates_in_text",
    """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first_day,
           CAST(o_orderdate AS DATE) + 3 AS last_day, 2 AS n FROM orders
    """,
)
def dates_in_text(spark, sf):
    day = F.col("o_orderdate").cast("date")
    iso = F.concat(day, F.lit(" until "), F.date_add(day, 3))
    dotted = F.concat(
        F.date_format(day, "dd.MM.yyyy"), F.lit(" - "), F.date_format(F.date_add(day, 3), "dd.MM.yyyy")
    )
    split = F.col("o_orderstatus") == "F"
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        split.alias("dot"),
        cal.dates_in_text(iso).alias("a"),
        cal.dates_in_text(dotted, dotted=True).alias("b"),
    )
    return df.select("o_orderkey", F.when(F.col("dot"), F.col("b")).otherwise(F.col("a")).alias("d")).select(
        "o_orderkey", "d.*"
    )


@query(
    "p12_counts_and_durations",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey * 1000 + 7 AS viewers,
           CASE WHEN l_suppkey % 70 < 60
                THEN round(l_quantity + (l_suppkey % 70) / 60, 6) END AS hours
    FROM lineitem
    """,
)
def counts_and_durations(spark, sf):
    viewers = F.concat(F.col("l_partkey"), F.lit(" 007"))
    spoken = F.concat(
        F.col("l_quantity"), F.lit(" h "), F.col("l_suppkey") % 70, F.lit(" m")
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        m.compact_int(viewers).alias("viewers"),
        F.round(m.duration_hours(spoken), 6).alias("hours"),
    )


@query(
    "p13_calendar_keys",
    f"""
    WITH {PARENTS}
    SELECT parent_id, CAST(year(start_date) AS INTEGER) AS year,
           year(start_date) || 'Q' || quarter(start_date) AS quarter,
           CAST(date_trunc('month', start_date) AS DATE) AS month_start,
           CAST(date_trunc('quarter', start_date) AS DATE) AS period_start
    FROM parents
    """,
)
def calendar_keys(spark, sf):
    return cal.with_calendar(parents(spark, sf), "start_date").select(
        "parent_id", "year", "quarter", "month_start", "period_start"
    )


@query(
    "p14_month_start",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN l_quantity <= 12
                THEN make_date(year(l_shipdate), CAST(l_quantity AS BIGINT), 1) END AS month_start
    FROM lineitem
    """,
)
def month_start(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        cal.month_start(F.year("l_shipdate"), F.col("l_quantity")).alias("month_start"),
    )


@query(
    "p15_numeric_gate",
    f"""
    SELECT 'raw_missing' AS "check", count(*) FILTER (raw IS NULL) AS bad_rows FROM r
    UNION ALL SELECT 'raw_not_numeric', count(*) FILTER (try_cast(raw AS DOUBLE) IS NULL AND raw IS NOT NULL) FROM r
    UNION ALL SELECT 'raw_negative', count(*) FILTER (try_cast(raw AS DOUBLE) < 0) FROM r
    """.replace(
        " FROM r", f" FROM (SELECT replace({RAW_MONEY}, 'NaN', 'n/a') AS raw FROM lineitem)"
    ),
)
def numeric_gate(spark, sf):
    raw = _raw_money(spark, sf).withColumn("raw", F.regexp_replace("raw", "NaN", "n/a"))
    return run_checks(raw, numeric_checks(["raw"]), "l_orderkey").select("check", "bad_rows")


@query(
    "p16_provenance_literals",
    """
    SELECT event_id, 'Twitch' AS platform, 'game_month' AS measurement_level,
           'events.parquet' AS source_file FROM events
    """,
)
def provenance_literals(spark, sf):
    df = with_source_file(table(spark, sf, "events"))
    return with_literals(
        df, {"platform": "Twitch", "measurement_level": "game_month"}
    ).select("event_id", "platform", "measurement_level", "source_file")


# Category -> (family, role); categories that are not listed are dropped.
CATEGORIES = {
    "view": ("attention", "main"),
    "click": ("attention", "supplementary"),
    "purchase": ("money", "main"),
}


@query(
    "p17_category_map",
    """
    SELECT event_id, CASE event_type WHEN 'purchase' THEN 'money' ELSE 'attention' END AS family,
           CASE event_type WHEN 'click' THEN 'supplementary' ELSE 'main' END AS role
    FROM events WHERE event_type IN ('view', 'click', 'purchase')
    """,
)
def category_map(spark, sf):
    from prizelens.plans.attention import map_category

    return map_category(table(spark, sf, "events"), "event_type", CATEGORIES).select(
        "event_id", "family", "role"
    )


@query("p18_lower_columns", "SELECT n_nationkey, n_name FROM nation")
def lower_column_names(spark, sf):
    upper = table(spark, sf, "nation").toDF("N_NATIONKEY", "N_Name", "N_RegionKey")
    return lower_columns(upper).select("n_nationkey", "n_name")


@query(
    "p19_scope_split",
    f"""
    WITH {PARENTS}
    SELECT CASE WHEN start_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
                THEN 'in' ELSE 'out' END AS part,
           count(*) AS n_rows, CAST(sum(pool_cents) AS BIGINT) AS pool_cents
    FROM parents GROUP BY ALL
    """,
)
def scope_split(spark, sf):
    from prizelens.plans.cleaning import split_scope

    kept, diverted = split_scope(parents(spark, sf), "start_date", "1996-01-01", "2000-12-31")
    both = kept.withColumn("part", F.lit("in")).unionByName(
        diverted.withColumn("part", F.lit("out"))
    )
    return both.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("pool_cents").alias("pool_cents")
    )


@query(
    "p20_plausible_version",
    f"""
    WITH {PARENTS}
    SELECT parent_id, NOT ((version = 'P' AND year(start_date) < 1998)
                        OR (version = 'O' AND year(start_date) < 1996)) AS plausible
    FROM parents
    """,
)
def plausible_version(spark, sf):
    return parents(spark, sf).select(
        "parent_id",
        cal.plausible_version(
            F.col("version"), F.col("start_date"), {"P": 1998, "O": 1996}
        ).alias("plausible"),
    )


@query(
    "p21_status_gate",
    """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'prize_allocation_pending_review'
        WHEN 'F' THEN 'placements_unavailable_or_unapproved' END AS reason FROM orders
    """,
)
def status_gate(spark, sf):
    from prizelens.plans.cleaning import status_gate_reason

    status = F.col("o_orderstatus")
    mapped = (
        F.when(status == "P", F.lit("needs_review"))
        .when(status == "F", F.lit("tournament_only"))
        .otherwise(F.lit("matched"))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", status_gate_reason(mapped).alias("reason")
    )


@query(
    "p22_roster_supplement",
    r"""
    SELECT doc_id, regexp_matches(text, '(?i)\bcoach(?:es)?\b|\bsubstitut(?:e|es)\b') AS is_supplement
    FROM documents
    """,
)
def roster_supplement(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", t.is_supplement(F.col("text")).alias("is_supplement")
    )


@query(
    "p23_rank_reason",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN (a IS NULL) <> (b IS NULL) THEN 'incomplete_rank'
                WHEN a > b THEN 'invalid_rank_range'
                WHEN a IS NULL AND l_returnflag <> 'N' THEN 'missing_rank_and_outcome' END AS reason
    FROM (SELECT *, CASE WHEN l_linenumber < 6 THEN l_linenumber END AS a,
                 CASE WHEN l_linenumber < 5 THEN CAST(l_quantity AS INTEGER) END AS b FROM lineitem)
    """,
)
def rank_reason(spark, sf):
    line = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        m.rank_reason(
            F.when(line < 6, line),
            F.when(line < 5, F.col("l_quantity").cast("int")),
            F.when(F.col("l_returnflag") == "N", F.lit("WIN")),
        ).alias("reason"),
    )


@query(
    "p24_strict_quality",
    f"WITH {PARENTS} SELECT parent_id, strict FROM parents",
)
def strict_quality(spark, sf):
    return parents(spark, sf).select("parent_id", "strict")


@query(
    "p25_time_split",
    f"""
    WITH {PARENTS}
    SELECT parent_id, CASE WHEN year(start_date) <= 1999 THEN 'train'
        WHEN year(start_date) <= 2000 THEN 'validation' ELSE 'test' END AS split FROM parents
    """,
)
def time_split(spark, sf):
    return parents(spark, sf).select(
        "parent_id", cal.time_split(F.col("start_date"), 1999, 2000).alias("split")
    )


@query(
    "p26_sign_label",
    """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'below' WHEN c_acctbal > 0 THEN 'above'
        ELSE 'equal' END AS direction FROM customer
    """,
)
def sign_label(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", t.sign_label(F.col("c_acctbal"), "below", "above", "equal").alias("direction")
    )


@query("p27_clip_zero", "SELECT c_custkey, greatest(c_acctbal, 0.0::DOUBLE) AS clipped FROM customer")
def clip_zero(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", m.clip_zero(F.col("c_acctbal")).alias("clipped")
    )


@query(
    "p28_text_boolean",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS value
    FROM lineitem
    """,
)
def text_boolean(spark, sf):
    raw = (
        F.when(F.col("l_returnflag") == "A", F.lit(" TRUE "))
        .when(F.col("l_returnflag") == "N", F.lit("False"))
        .otherwise(F.lit("yes"))
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", t.to_bool(raw).alias("value")
    )


@query(
    "p29_canonical_url",
    r"""
    SELECT page_id, url,
           'https://' || lower(regexp_extract(url, '^https?://([^/?#]*)', 1))
             || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS canonical,
           starts_with(url, 'https://') AND regexp_extract(url, '^https?://[^/?#]*/[a-z]+/(\d+)(?:-|/|[?#]|$)', 1) <> ''
             AS strict_ok
    FROM pages
    """,
)
def canonical(spark, sf):
    url = F.col("url")
    strict = canonical_url(url)
    item = F.regexp_extract(url, r"^[^:]+://[^/]*/[a-z]+/(\d+)", 1)
    ok = F.lit(False)
    for section in ("en", "fr", "de", "es"):
        ok = ok | url_matches_id(url, item, section)
    return table(spark, sf, "pages").select(
        "page_id",
        "url",
        canonical_url(url, any_scheme=True).alias("canonical"),
        (strict.isNotNull() & ok).alias("strict_ok"),
    )


@query(
    "p30_scope_hint",
    f"""
    WITH {PARENTS}
    SELECT parent_id, CASE WHEN version = 'P' THEN 'unknown_date'
        WHEN start_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' THEN 'in_scope'
        ELSE 'outside_scope' END AS hint FROM parents
    """,
)
def scope_hint(spark, sf):
    day = F.when(F.col("version") != "P", F.col("start_date"))
    return parents(spark, sf).select(
        "parent_id", cal.scope_hint(day, "1996-01-01", "2000-12-31").alias("hint")
    )


@query(
    "p31_null_policy",
    f"""
    WITH {PARENTS}, {CHILDREN}
    SELECT parent_id, coalesce(n, 0) AS child_rows, s AS child_cents
    FROM parents LEFT JOIN (SELECT parent_id, count(*) AS n, CAST(sum(prize_cents) AS BIGINT) AS s
                            FROM children GROUP BY parent_id) USING (parent_id)
    """,
)
def null_policy(spark, sf):
    sums = children(spark, sf).groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("child_rows"), F.sum("prize_cents").alias("child_cents")
    )
    joined = parents(spark, sf).select("parent_id").join(sums, "parent_id", "left")
    return apply_null_policy(joined, ["child_rows"])


@query(
    "p32_cents_to_usd",
    f"WITH {PARENTS} SELECT parent_id, pool_cents / 100.0::DOUBLE AS usd FROM parents",
)
def cents_to_usd(spark, sf):
    return parents(spark, sf).select("parent_id", m.cents_to_usd(F.col("pool_cents")).alias("usd"))


@query(
    "p33_log10p1",
    f"WITH {PARENTS} SELECT parent_id, round(log10(1 + pool_cents), 6) AS log_pool FROM parents",
)
def log10p1(spark, sf):
    return parents(spark, sf).select(
        "parent_id", F.round(m.log10p1(F.col("pool_cents")), 6).alias("log_pool")
    )


@query(
    "p34_unit_hint",
    """
    SELECT column_name, CASE WHEN ends_with(column_name, 'cents') THEN 'USD cents'
        WHEN ends_with(column_name, 'usd') THEN 'USD' WHEN ends_with(column_name, 'pct') THEN 'percent'
        ELSE 'see schema' END AS unit_hint
    FROM (SELECT unnest(['parent_id', 'pool_cents', 'pool_usd', 'pool_pct']) AS column_name)
    """,
)
def unit_hint(spark, sf):
    pool = F.col("pool_cents")
    rows = parents(spark, sf).select(
        "parent_id", "pool_cents", m.cents_to_usd(pool).alias("pool_usd"),
        (pool / F.lit(1e6)).alias("pool_pct"),
    )
    return data_dictionary({"parents": rows}).select("column_name", "unit_hint")


@query(
    "p35_surrogate_key",
    f"""
    WITH {CHILDREN}
    SELECT parent_id, line, team_id AS known_id, team_name, prize_cents,
           sha256(parent_id || '|' || CASE WHEN flag <> 'R' THEN 'id:' || team_id
                                           ELSE 'name:' || team_name END) AS placement_id,
           CASE WHEN flag <> 'R' THEN 'source_team_id' ELSE 'tournament_and_team_name' END AS key_basis
    FROM children
    """,
)
def surrogate_key(spark, sf):
    key = t.placement_key(
        F.col("parent_id"),
        F.when(F.col("flag") != "R", F.col("team_id")),
        F.col("team_name").cast("string"),
    )
    return children(spark, sf).select(
        "parent_id", "line", F.col("team_id").alias("known_id"), "team_name", "prize_cents",
        key["placement_id"].alias("placement_id"), key["key_basis"].alias("key_basis"),
    )


@query("p36_namespaced_id", "SELECT 'earnings:' || o_orderkey AS tournament_id FROM orders")
def namespaced_id(spark, sf):
    return table(spark, sf, "orders").select(
        t.namespaced_id("earnings", F.col("o_orderkey")).alias("tournament_id")
    )


@query(
    "p37_common_window",
    f"WITH {ATTENTION} SELECT family, day, hours FROM attention WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'",
)
def common_window(spark, sf):
    from prizelens.plans.attention import common_window

    return common_window(attention(spark, sf), "day", "2024-01-05", "2024-01-20").select(
        "family", "day", "hours"
    )


@query(
    "p38_complete_pairs",
    f"WITH {PANEL} SELECT family, day, hours, pool FROM panel WHERE hours IS NOT NULL AND pool IS NOT NULL",
)
def pairs(spark, sf):
    return complete_pairs(panel(spark, sf), ["hours", "pool"]).select(
        "family", "day", "hours", "pool"
    )
