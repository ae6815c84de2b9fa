"""Immutable releases with a hashed manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prizelens.sources.files import CHUNK_BYTES, file_digests, stored_files


def write_release(
    df: DataFrame, root: str, run_id: str, name: str, fmt: str = "parquet"
) -> str:
    """Write one table of a run; an existing target is an error, never replaced."""
    target = f"{root.rstrip('/')}/{run_id}/{name}"
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(target)
    return target


def file_hashes(spark: SparkSession, folder: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Relative path, size and SHA-256 of each data file below ``folder``, of any size."""
    base = folder.rstrip("/").split("/")[-1]
    found = file_digests(stored_files(spark, folder), chunk)
    return found.select(F.substring_index("path", f"/{base}/", -1).alias("file"), "bytes", "sha256")


def build_manifest(
    spark: SparkSession, folder: str, counts: DataFrame, checks: DataFrame
) -> DataFrame:
    """One long table: every file hash, row count and check result of a release.

    ``counts`` has (name, value), ``checks`` has (check, passed).
    """
    files = file_hashes(spark, folder).select(
        F.lit("file").alias("kind"), F.col("file").alias("name"), "sha256",
        F.col("bytes").alias("value"),
    )
    rows = counts.select(
        F.lit("count").alias("kind"), "name", F.lit(None).cast("string").alias("sha256"),
        F.col("value").cast("bigint").alias("value"),
    )
    verdicts = checks.select(
        F.lit("check").alias("kind"), F.col("check").alias("name"),
        F.lit(None).cast("string").alias("sha256"),
        F.col("passed").cast("bigint").alias("value"),
    )
    return files.unionByName(rows).unionByName(verdicts)


def verify_manifest(
    spark: SparkSession, folder: str, manifest: DataFrame
) -> DataFrame:
    """Per file: unchanged, changed, missing or unexpected."""
    now = file_hashes(spark, folder).select("file", F.col("sha256").alias("now"))
    then = manifest.where(F.col("kind") == "file").select(
        F.col("name").alias("file"), F.col("sha256").alias("then")
    )
    return now.join(then, "file", "full").select(
        "file",
        F.when(F.col("then").isNull(), F.lit("unexpected"))
        .when(F.col("now").isNull(), F.lit("missing"))
        .when(F.col("now") == F.col("then"), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
        .alias("state"),
    )
