"""The result log: scan, payload decoding, upsert, resume and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prizelens.operators.windows import dedupe_first

LOG_SCHEMA = (
    "tournament_id string, game_slug string, source_game_id string, "
    "source_url string, status string, error string, html_file string, "
    "crawled_at string, updated_at string, tournament_json string, "
    "placements_json string, audit_json string"
)

TOURNAMENT_SCHEMA = (
    "source_site string, source_url string, source_tournament_id string, "
    "tournament_name_raw string, location_raw string, date_raw string, "
    "source_start_date string, source_end_date string, start_date string, "
    "end_date string, date_validation_status string, game_name_raw string, "
    "source_game_id string, game_source_url string, prize_pool_raw string, "
    "prize_pool_usd string, currency_raw string, source_html_file string, "
    "parsed_at string, game_id string, game_slug string, crawled_at string, "
    "placements_status string"
)

PLACEMENTS_SCHEMA = (
    "array<struct<source_site:string, source_url:string, "
    "source_tournament_id:string, source_team_id:string, team_name_raw:string, "
    "team_source_url:string, rank_raw:string, rank_min:string, rank_max:string, "
    "result_outcome:string, prize_money_raw:string, prize_money_usd:string, "
    "source_html_file:string, parsed_at:string, game_id:string, "
    "game_slug:string, crawled_at:string, validation_status:string>>"
)

RETRY = ("failed", "tournament_only")


def read_result_log(
    spark: SparkSession, path: str, fmt: str = "parquet", statuses=None
) -> DataFrame:
    """The log as strings. ``statuses`` becomes a pushed-down scan filter."""
    log = spark.read.schema(LOG_SCHEMA).format(fmt).load(path)
    return log.where(F.col("status").isin(*statuses)) if statuses else log


def decode_payload(df: DataFrame, col: str, schema: str, name: str) -> DataFrame:
    """JSON text to a typed column; null and blank text decode like ``{}`` or ``[]``.

    Null where the text is not JSON of the kind that ``schema`` asks for, so that a broken
    payload is told from an empty one.
    """
    is_array = schema.lstrip().lower().startswith("array")
    text = F.coalesce(F.nullif(F.trim(F.col(col)), F.lit("")), F.lit("[]" if is_array else "{}"))
    if is_array:
        return df.withColumn(name, F.when(text.startswith("["), F.from_json(text, schema)))
    options = {"columnNameOfCorruptRecord": "_broken"}
    found = F.from_json(text, f"{schema}, _broken string", options)
    df = df.withColumn(name, F.when(text.startswith("{"), found))
    return df.withColumn(
        name, F.when(F.col(name)["_broken"].isNull(), F.col(name).dropFields("_broken"))
    )


def explode_payload(df: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """One row per array item with its position; item fields become columns."""
    return df.select(*keep, F.posexplode(name).alias("pos", "_item")).select(
        *keep, "pos", "_item.*"
    )


def upsert_log(
    current: DataFrame, incoming: DataFrame, key: str, ts: str, tie: list[Column] = ()
) -> DataFrame:
    """Newest row per key wins. Each map task keeps one row per key."""
    both = current.unionByName(incoming)
    return dedupe_first(both, [key], [F.col(ts).desc(), *tie])


def pending_keys(
    keys: DataFrame, log: DataFrame, key: str, status: str = "status", retry=RETRY
) -> DataFrame:
    """Keys not logged yet, or logged with a status that is to be retried."""
    done = log.where(~F.coalesce(F.col(status).isin(*retry), F.lit(False)))
    return keys.select(key).distinct().join(done.select(key), key, "left_anti")


def export_log(df: DataFrame, path: str, by: str) -> None:
    """Write one folder per key. Rows of a key spread over several files as needed."""
    df.write.mode("errorifexists").partitionBy(by).parquet(path)
