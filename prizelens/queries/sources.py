"""Sources, sinks and the incremental log."""

from __future__ import annotations

from pyspark.sql import functions as F

from prizelens.operators.checks import check_key, run_checks
from prizelens.operators.joins import require_columns
from prizelens.queries.registry import query
from prizelens.queries.shapes import (
    CHILDREN,
    PARENTS,
    children,
    parents,
    table,
)
from prizelens.session import new_run_dir
from prizelens.sources.files import write_files
from prizelens.sources.log import (
    LOG_SCHEMA,
    PLACEMENTS_SCHEMA,
    TOURNAMENT_SCHEMA,
    decode_payload,
    explode_payload,
    export_log,
    pending_keys,
    read_result_log,
    upsert_log,
)
from prizelens.sources.pages import read_pages
from prizelens.sources.release import build_manifest, verify_manifest, write_release
from prizelens.sources.tables import (
    read_table,
    read_url_list,
    readable_encoding,
    with_row_number,
)
from prizelens.streaming.upsert import compact, read_log, stream_upsert


@query(
    "s01_csv_scan",
    """
    SELECT c_custkey AS customer_id,
           CASE WHEN c_nationkey = 0 THEN 'NA' ELSE 'N' || c_nationkey END AS code,
           CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment
    FROM customer
    """,
)
def csv_scan(spark, sf):
    path = new_run_dir(spark, "csv")
    key = F.col("c_nationkey")
    table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.when(key == 0, F.lit("NA")).otherwise(F.concat(F.lit("N"), key)).alias("code"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
    ).write.option("header", True).csv(path)
    return read_table(spark, path, "customer_id bigint, code string, segment string")


@query("s02_required_columns", "SELECT o_orderkey, o_orderpriority FROM orders")
def required_columns(spark, sf):
    needed = ["o_orderkey", "o_orderpriority"]
    return require_columns(table(spark, sf, "orders"), needed).select(*needed)


@query(
    "s03_encoding_fallback",
    """
    SELECT conv_id, turn, regexp_replace(text, '[^A-Za-zéèêçàâôûîïëäöüßñáíóúÉÈÊÇÄÖÜÑÁÍÓÚ ]', ' ', 'g') AS body
    FROM conversations
    """,
)
def encoding_fallback(spark, sf):
    path = new_run_dir(spark, "cp1252")
    body = F.regexp_replace(
        "text", "[^A-Za-zéèêçàâôûîïëäöüßñáíóúÉÈÊÇÄÖÜÑÁÍÓÚ ]", " "
    )
    table(spark, sf, "conversations").select(
        "conv_id", "turn", body.alias("body")
    ).write.options(
        header=True, encoding="ISO-8859-1", quoteAll=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return read_table(
        spark,
        path,
        "conv_id bigint, turn bigint, body string",
        encoding=readable_encoding(spark, path),
    )


def result_log(spark, sf):
    """The log in its stored shape: JSON payloads per parent."""
    p = parents(spark, sf)
    items = children(spark, sf).groupBy("parent_id").agg(
        F.to_json(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.struct("pos", "team_id", "team_name", "prize_cents")
                    )
                ),
                lambda i: F.struct(
                    i["team_id"].cast("string").alias("source_team_id"),
                    i["team_name"].cast("string").alias("team_name_raw"),
                    (i["prize_cents"].cast("decimal(20,0)") / 100)
                    .cast("decimal(18,2)")
                    .cast("string")
                    .alias("prize_money_usd"),
                ),
            )
        ).alias("placements_json")
    )
    key = F.col("parent_id").cast("string")
    return p.join(items, "parent_id", "left").select(
        key.alias("tournament_id"),
        F.col("family").alias("game_slug"),
        F.lit("1").alias("source_game_id"),
        F.concat(F.lit("https://example.org/tournaments/"), key).alias("source_url"),
        F.when(F.col("version") == "P", "needs_review")
        .when(F.col("version") == "F", "failed")
        .otherwise("matched")
        .alias("status"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("html_file"),
        F.col("start_date").cast("string").alias("crawled_at"),
        F.col("start_date").cast("string").alias("updated_at"),
        F.to_json(
            F.struct(
                key.alias("source_tournament_id"),
                F.col("start_date").cast("string").alias("start_date"),
                (F.col("pool_cents").cast("decimal(20,0)") / 100)
                .cast("decimal(18,2)")
                .cast("string")
                .alias("prize_pool_usd"),
            )
        ).alias("tournament_json"),
        F.coalesce("placements_json", F.lit("")).alias("placements_json"),
        F.lit(None).cast("string").alias("audit_json"),
    )


def stored_log(spark, sf):
    path = new_run_dir(spark, "log")
    result_log(spark, sf).write.parquet(path)
    return path


STATUS_OF = """CASE version WHEN 'P' THEN 'needs_review' WHEN 'F' THEN 'failed' ELSE 'matched' END"""


@query(
    "s04_result_log_scan",
    f"""
    WITH {PARENTS}
    SELECT CAST(parent_id AS VARCHAR) AS tournament_id, family AS game_slug,
           {STATUS_OF} AS status, strftime(start_date, '%Y-%m-%d') AS updated_at FROM parents
    """,
)
def result_log_scan(spark, sf):
    return read_result_log(spark, stored_log(spark, sf)).select(
        "tournament_id", "game_slug", "status", "updated_at"
    )


@query(
    "s05_decode_payload",
    f"""
    WITH {PARENTS}, {CHILDREN}
    SELECT CAST(c.parent_id AS VARCHAR) AS tournament_id,
           strftime(p.start_date, '%Y-%m-%d') AS start_date,
           CAST(row_number() OVER (PARTITION BY c.parent_id ORDER BY pos) - 1 AS INTEGER) AS pos,
           CAST(team_id AS VARCHAR) AS source_team_id,
           CAST(team_name AS VARCHAR) AS team_name_raw, prize_cents
    FROM children c JOIN parents p USING (parent_id)
    """,
)
def decode_payload_rows(spark, sf):
    log = read_result_log(spark, stored_log(spark, sf))
    log = decode_payload(log, "tournament_json", TOURNAMENT_SCHEMA, "t")
    log = decode_payload(log, "placements_json", PLACEMENTS_SCHEMA, "items")
    rows = explode_payload(
        log.withColumn("start_date", F.col("t.start_date")),
        "items",
        ["tournament_id", "start_date"],
    )
    return rows.select(
        "tournament_id", "start_date", "pos", "source_team_id", "team_name_raw",
        (F.col("prize_money_usd").cast("decimal(18,2)") * 100).cast("bigint").alias("prize_cents"),
    )


@query(
    "s05_decode_event_props",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
)
def decode_event_props(spark, sf):
    df = decode_payload(table(spark, sf, "events"), "props", "k int", "p")
    return df.select("event_id", F.col("p.k").alias("k"))


@query(
    "s06_filtered_log_read",
    f"""
    WITH {PARENTS}
    SELECT CAST(parent_id AS VARCHAR) AS tournament_id, family AS game_slug
    FROM parents WHERE version = 'P'
    """,
)
def filtered_log_read(spark, sf):
    return read_result_log(
        spark, stored_log(spark, sf), statuses=["needs_review"]
    ).select("tournament_id", "game_slug")


@query(
    "s07_pages_with_metadata",
    """
    SELECT CAST(page_id AS VARCHAR) AS page_id, url, sha256(html) AS html_sha256
    FROM pages
    """,
)
def pages_with_metadata(spark, sf):
    root = new_run_dir(spark, "pages")
    name = F.concat(F.lit("id="), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    pages = table(spark, sf, "pages")
    described = F.struct(F.col("url").alias("source_url"), F.lit("2024-01-01").alias("crawled_at"))
    html = write_files(
        pages.select(F.concat(name, F.lit(".html")).alias("name"), F.col("html").alias("content")),
        f"{root}/html",
    )
    meta = write_files(
        pages.select(F.concat(name, F.lit(".json")).alias("name"), F.to_json(described).alias("content")),
        f"{root}/meta",
    )
    if not html:
        return spark.createDataFrame([], "page_id string, url string, html_sha256 string")
    stored = read_pages(
        spark, html, meta, key=lambda file: F.regexp_extract(file, r"/id=(\d+)\.[a-z]+$", 1)
    )
    # Every file ends with one line break.
    return stored.select(
        "page_id",
        "url",
        F.sha2(F.regexp_replace("html", r"\n\z", ""), 256).alias("html_sha256"),
    )


@query("s08_url_list", "SELECT trim(url) AS loc FROM pages WHERE trim(url) <> ''")
def url_list(spark, sf):
    path = new_run_dir(spark, "urls")
    table(spark, sf, "pages").select(F.col("url").alias("loc")).write.format(
        "xml"
    ).options(rootTag="urlset", rowTag="url").save(path)
    return read_url_list(spark, path)


@query(
    "s09_release_sink",
    f"WITH {PARENTS} SELECT family, count(*) AS n_rows, CAST(sum(pool_cents) AS BIGINT) AS pool_cents FROM parents GROUP BY family",
)
def release_sink(spark, sf):
    root = new_run_dir(spark, "release")
    target = write_release(parents(spark, sf), root, "v1", "tournaments")
    return (
        spark.read.parquet(target)
        .groupBy("family")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("pool_cents").alias("pool_cents"))
    )


def _release(spark, sf):
    root = new_run_dir(spark, "release")
    p = parents(spark, sf)
    for name, df in {"tournaments": p, "placements": children(spark, sf)}.items():
        write_release(df, root, "v1", name)
    folder = f"{root}/v1"
    stored = spark.read.parquet(f"{folder}/tournaments")
    counts = stored.groupBy(F.concat(F.lit("tournaments:"), "version").alias("name")).agg(
        F.count(F.lit(1)).alias("value")
    )
    checks = run_checks(
        stored,
        {"pool_missing": F.col("pool_cents").isNull(), "pool_negative": F.col("pool_cents") < 0},
        "parent_id",
    )
    return folder, build_manifest(spark, folder, counts, checks)


@query(
    "s10_manifest",
    """
    SELECT 'count' AS kind, 'tournaments:' || o_orderstatus AS name, count(*) AS value
    FROM orders GROUP BY ALL
    UNION ALL SELECT 'check', 'pool_missing', 1
    UNION ALL SELECT 'check', 'pool_negative', 1
    UNION ALL SELECT 'file', 'every file has a 64-digit hash', 1
    """,
)
def manifest(spark, sf):
    _, table_ = _release(spark, sf)
    is_file = F.col("kind") == "file"
    files = table_.where(is_file).agg(
        F.lit("file").alias("kind"),
        F.lit("every file has a 64-digit hash").alias("name"),
        F.bool_and(F.length("sha256") == 64).cast("bigint").alias("value"),
    )
    return table_.where(~is_file).select("kind", "name", "value").unionByName(files)


@query("s11_manifest_verification", "SELECT 'unchanged' AS state")
def manifest_verification(spark, sf):
    folder, table_ = _release(spark, sf)
    return verify_manifest(spark, folder, table_).select("state").distinct()


@query(
    "s12_source_row_number",
    "SELECT o_orderkey, row_number() OVER () + 1 AS source_row_number FROM orders",
)
def source_row_number(spark, sf):
    return with_row_number(table(spark, sf, "orders")).select(
        "o_orderkey", "source_row_number"
    )


def _log_batches(spark, sf):
    """Two overlapping batches: two thirds of the keys each."""
    base = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        F.col("o_orderstatus").alias("status"),
    )
    third = F.pmod(F.col("key"), F.lit(3))
    first = base.where(third.isin(0, 1))
    second = base.where(third.isin(1, 2)).select(
        "key",
        # Half of the repeats are newer, the others older than the stored row.
        F.when(
            F.pmod(F.col("key"), F.lit(2)) == 0,
            F.col("updated_at") + F.expr("interval 1 day"),
        )
        .otherwise(F.col("updated_at") - F.expr("interval 1 day"))
        .alias("updated_at"),
        F.lit("X").alias("status"),
    )
    return first, second


UPSERTED = """
    SELECT o_orderkey AS key,
           CASE WHEN o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderkey % 2 = 1)
                THEN o_orderstatus ELSE 'X' END AS status,
           CAST(o_orderdate AS DATE) + CASE
               WHEN o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderkey % 2 = 1) THEN 0
               WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS updated_on
    FROM orders
"""


def _upsert_view(df):
    return df.select("key", "status", F.col("updated_at").cast("date").alias("updated_on"))


@query("s13_log_upsert", UPSERTED)
def log_upsert(spark, sf):
    first, second = _log_batches(spark, sf)
    return _upsert_view(
        upsert_log(first, second, "key", "updated_at", [F.col("status")])
    )


@query(
    "s14_resume_filter",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS tournament_id FROM orders
    WHERE o_orderstatus = 'F' OR o_orderdate >= TIMESTAMP '2000-01-01'
    """,
)
def resume_filter(spark, sf):
    log = result_log(spark, sf)
    logged = log.where(F.col("updated_at") < "2000-01-01")
    return pending_keys(log, logged, "tournament_id")


@query(
    "s15_per_key_export",
    f"WITH {PARENTS} SELECT family AS game_slug, {STATUS_OF} AS status, count(*) AS n_rows FROM parents GROUP BY ALL",
)
def per_key_export(spark, sf):
    path = new_run_dir(spark, "export")
    export_log(result_log(spark, sf), path, "game_slug")
    return (
        spark.read.schema(LOG_SCHEMA).parquet(path)
        .groupBy("game_slug", "status")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


@query("r1_streaming_upsert", UPSERTED)
def streaming_upsert(spark, sf):
    root = new_run_dir(spark, "stream")
    first, second = _log_batches(spark, sf)
    first.write.parquet(f"{root}/in/arrival=1")
    second.write.parquet(f"{root}/in/arrival=2")
    args = dict(
        in_dir=f"{root}/in/*",
        out_dir=f"{root}/out",
        checkpoint=f"{root}/checkpoint",
        schema="key bigint, updated_at timestamp, status string",
        key="key",
        ts="updated_at",
        max_files=4,
    )
    stream_upsert(spark, **args)
    compact(spark, f"{root}/out", "key", "updated_at")
    return _upsert_view(read_log(spark, f"{root}/out", "key", "updated_at"))


@query(
    "s13_log_key_is_unique",
    "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS empty_key_rows, CAST(0 AS BIGINT) AS repeated_keys, true AS passed FROM orders",
)
def log_key_is_unique(spark, sf):
    first, second = _log_batches(spark, sf)
    return check_key(upsert_log(first, second, "key", "updated_at", [F.col("status")]), ["key"])
