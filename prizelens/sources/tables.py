"""Table scans with declared schemas, URL lists and row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from prizelens.operators.joins import require_columns


WESTERN = "windows-1252"


def western_marks() -> tuple[str, str]:
    """The characters where windows-1252 differs from ISO-8859-1, and their meaning."""
    read, meant = "", ""
    for code in range(0x80, 0xA0):
        char = bytes([code]).decode("cp1252", errors="ignore")
        if char:
            read, meant = read + chr(code), meant + char
    return read, meant


def read_table(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    fmt: str = "csv",
    encoding: str = "UTF-8",
    required: list[str] | None = None,
    multi_line: bool = False,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Scan a table with a declared schema.

    CSV: header row, columns matched by name, byte-order mark dropped, and only
    empty text is null, so a code such as ``NA`` survives. A cell that does not fit
    stops the scan unless ``mode`` says otherwise. ``multi_line`` reads quoted line
    breaks, at the price of one task per file. ``encoding`` holds for all of ``path``
    unless it is ``auto``: then each file is read by its own (``windows-1252`` where any
    line of it is not UTF-8). Files of both kinds go through one scan that keeps their bytes,
    columns are then taken by position, and cells are decoded behind it; which files are
    not UTF-8 is a table that never leaves the executors.
    """
    if encoding == "auto" and fmt == "csv":
        df = _decoded_by_file(spark, path, schema, multi_line, mode)
        return require_columns(df, required) if required else df
    western = encoding == WESTERN
    reader = spark.read
    if fmt == "csv":
        reader = reader.options(
            header=True, enforceSchema=False, nullValue="", multiLine=multi_line, mode=mode,
            escape='"',
            encoding="ISO-8859-1" if western else encoding,
        )
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(fmt).load(path)
    if western:
        texts = [f.name for f in df.schema.fields if f.dataType == StringType()]
        df = df.withColumns({c: F.translate(c, *western_marks()) for c in texts})
    return require_columns(df, required) if required else df


def readable_encoding(spark: SparkSession, path: str) -> str:
    """``UTF-8`` when every line decodes, else ``windows-1252``.

    The bytes are tested on the executors, line by line.
    """
    lines = spark.read.text(path)
    broken = lines.where(~F.is_valid_utf8("value")).limit(1)
    return "UTF-8" if broken.isEmpty() else WESTERN


def broken_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file`` of each file that holds a line which is not UTF-8; tested on the executors."""
    lines = spark.read.text(path).where(~F.is_valid_utf8("value"))
    return lines.select(F.col("_metadata.file_path").alias("file")).distinct()


def _from_bytes(cell: Column, broken: Column) -> Column:
    """A cell that was read byte by byte, as its file's encoding means it."""
    as_utf8 = F.decode(F.encode(cell, "ISO-8859-1"), "UTF-8")
    return F.when(broken, F.translate(cell, *western_marks())).otherwise(as_utf8)


def _decoded_by_file(
    spark: SparkSession, path: str | list[str], schema: StructType | str | None,
    multi_line: bool, mode: str,
) -> DataFrame:
    reader = spark.read.options(
        header=True, nullValue="", multiLine=multi_line, mode=mode, escape='"',
        encoding="ISO-8859-1",
    )
    if schema is not None:
        reader = reader.schema(schema)
    scan = reader.csv(path)
    names = scan.columns
    if schema is None:  # names come from the bytes of a header
        names = [c.encode("latin-1").decode("utf-8", "replace").lstrip("\ufeff") for c in names]
    found = scan.withColumn("_file", F.col("_metadata.file_path")).toDF(*names, "_file")
    broken = broken_files(spark, path).withColumn("_broken", F.lit(True))
    marked = found.join(broken, F.col("_file") == F.col("file"), "left")
    is_broken = F.coalesce("_broken", F.lit(False))
    texts = {f.name for f in found.schema.fields if f.dataType == StringType()}
    return marked.select(*[
        _from_bytes(F.col(f"`{n}`"), is_broken).alias(n) if n in texts else F.col(f"`{n}`")
        for n in names
    ])


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty ``loc`` texts of an XML url list; the namespace is ignored."""
    rows = (
        spark.read.format("xml")
        .option("rowTag", "url")
        .schema("loc string")
        .load(path)
    )
    return rows.select(F.trim("loc").alias("loc")).where(F.col("loc") != "")


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def with_literals(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Constant provenance columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def with_source_file(df: DataFrame, name: str = "source_file") -> DataFrame:
    """Name of the file each row was read from."""
    return df.withColumn(name, F.col("_metadata.file_name"))


def with_row_number(
    df: DataFrame, fmt: str = "parquet", name: str = "source_row_number", first: int = 2
) -> DataFrame:
    """Contiguous row number inside each source file; data rows start at 2.

    Call directly on a scan. Parquet knows its row index. For text files each
    split numbers its own rows and adds the size of the file's earlier splits:
    one small row per split, and no row leaves its task.
    """
    if fmt == "parquet":
        return df.withColumn(name, F.col("_metadata.row_index") + F.lit(first))
    marked = df.withColumns(
        {
            "_file": F.col("_metadata.file_path"),
            "_block": F.col("_metadata.file_block_start"),
            "_id": F.monotonically_increasing_id(),
        }
    )
    splits = marked.groupBy("_file", "_block").agg(
        F.min("_id").alias("_from"), F.count(F.lit(1)).alias("_size")
    )
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(
        W.unboundedPreceding, -1
    )
    offsets = splits.select(
        "_file",
        "_block",
        "_from",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
    )
    return marked.join(offsets, ["_file", "_block"]).select(
        *df.columns,
        (F.col("_offset") + F.col("_id") - F.col("_from") + first).alias(name),
    )
