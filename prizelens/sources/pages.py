"""Stored pages and their metadata files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prizelens.sources.tables import western_marks

PAGE_META = "source_url string, crawled_at string"


def stem(file: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(file, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_pages(
    spark: SparkSession,
    pages: str | list[str],
    meta: str | list[str] | None = None,
    meta_schema: str = PAGE_META,
    key: Callable[[Column], Column] = stem,
    page_files: str = "*.html",
    meta_files: str = "*.json",
) -> DataFrame:
    """Pages joined to the metadata file of the same key (the file stem).

    A page without metadata is left out. ``pages`` and ``meta`` name a folder or several;
    ``meta`` defaults to the page folder.
    """
    content = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", page_files)
        .option("recursiveFileLookup", True)
        .load(pages)
        .select(key(F.col("path")).alias("page_id"), "content")
    )
    described = (
        spark.read.schema(meta_schema)
        .option("multiLine", True)
        .option("pathGlobFilter", meta_files)
        .option("recursiveFileLookup", True)
        .json(meta or pages)
        .withColumn("page_id", key(F.col("_metadata.file_path")))
    )
    text = F.col("content").cast("string")
    western = F.translate(F.decode("content", "ISO-8859-1"), *western_marks())
    return content.join(described, "page_id").select(
        "page_id",
        F.col("source_url").alias("url"),
        "crawled_at",
        # Page by page: bytes that are not UTF-8 are read as Western text.
        F.when(F.is_valid_utf8(text), text).otherwise(western).alias("html"),
    )
