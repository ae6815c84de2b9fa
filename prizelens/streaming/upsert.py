"""Incremental log upsert as a file-source stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prizelens.operators.windows import dedupe_first

DELTA, BASE = "delta", "base"


def _finished(spark: SparkSession, out_dir: str, kind: str) -> list[int]:
    """Ids of the finished ``kind=<id>`` folders below ``out_dir``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith(f"{kind}=") and fs.exists(done):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def _newest(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Newest row per key; equal times are settled by the other columns."""
    tie = [F.col(c).desc_nulls_last() for c in rows.columns if c not in (key, ts)]
    return dedupe_first(rows, [key], [F.col(ts).desc(), *tie])


def _parts(spark: SparkSession, out_dir: str) -> list[str]:
    """The newest base and the deltas after it."""
    root = out_dir.rstrip("/")
    bases = _finished(spark, root, BASE)
    since = bases[-1] if bases else -1
    parts = [f"{root}/{BASE}={since}"] if bases else []
    return parts + [
        f"{root}/{DELTA}={i}" for i in _finished(spark, root, DELTA) if i > since
    ]


def read_log(spark: SparkSession, out_dir: str, key: str, ts: str) -> DataFrame:
    """Current state of the log: newest row per key over base and deltas."""
    return _newest(spark.read.parquet(*_parts(spark, out_dir)), key, ts)


def compact(spark: SparkSession, out_dir: str, key: str, ts: str) -> None:
    """Fold the deltas so far into a new base. Deltas stay in place.

    The base takes the id of the last delta it holds; it counts only once it is
    written completely, so a lost run leaves the state as it was.
    """
    root = out_dir.rstrip("/")
    deltas = _finished(spark, root, DELTA)
    bases = _finished(spark, root, BASE)
    if deltas and (not bases or deltas[-1] > bases[-1]):
        read_log(spark, root, key, ts).write.mode("overwrite").parquet(
            f"{root}/{BASE}={deltas[-1]}"
        )


def stream_upsert(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    schema: str,
    key: str,
    ts: str,
    max_files: int | None = None,
) -> None:
    """Take in the files that arrived since the last run; newest row per key wins.

    A batch writes only its own newest rows, as the delta of its batch id, so its
    cost follows the arrivals and not the log; a replayed batch writes the same
    delta again. ``read_log`` gives the state, ``compact`` shortens it.
    """
    root = out_dir.rstrip("/")

    def apply(batch: DataFrame, batch_id: int) -> None:
        _newest(batch, key, ts).write.mode("overwrite").parquet(
            f"{root}/{DELTA}={batch_id}"
        )

    reader = spark.readStream.schema(schema).format("parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    query = (
        reader.load(in_dir)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
