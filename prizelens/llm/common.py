"""Shared helpers of the training-data operators."""

from __future__ import annotations

import sys
import types

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prizelens.session import ensure_checkpoint_dir, new_run_dir

# Fixed value: what separates words (space, tab, line feed, vertical tab, form feed, return).
BLANKS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    found = F.filter(F.split(text, BLANKS), lambda w: w != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stored(df: DataFrame, label: str, group_bytes: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: read again with pruned columns,
    and no lost executor can take it along. ``group_bytes`` bounds what a task buffers before
    it writes a row group."""
    path = new_run_dir(df.sparkSession, label)
    writer = df.write.option("parquet.block.size", group_bytes) if group_bytes else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Turns:
    """Stored tables that replace each other turn by turn: the next, once committed, removes
    the one of the same label, which nothing reads any more."""

    def __init__(self) -> None:
        self.last: dict[str, DataFrame] = {}

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        out = stored(df, label)
        self.discard(label)
        self.last[label] = out
        return out

    def discard(self, label: str) -> None:
        old = self.last.pop(label, None)
        if old is not None:
            remove_stored(old)


def remove_stored(df: DataFrame) -> None:
    """Remove the folder of a table that ``stored`` wrote."""
    files = df.inputFiles()
    if files:
        filesystem, folder = fs.FileSystem.from_uri(files[0].rsplit("/", 1)[0])
        filesystem.delete_dir(folder)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals its rows by key, whatever size Spark expects. An exploded
    table is taken for as large as before, an array for one element, so that either would be
    sent through the driver while its true size is many times the limit for that."""
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small iterated table through the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def worker_memo(name: str) -> dict:
    """A dict that lives as long as the Python worker, so later tasks find it filled.

    Functions of this package travel by value and bring fresh globals to every task.
    """
    home = sys.modules.setdefault("_prizelens_memo", types.ModuleType("_prizelens_memo"))
    return home.__dict__.setdefault(name, {})
