"""Byte access to stored files from inside tasks, and digests in constant memory."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20
DIGESTS = "path string, bytes long, sha256 string"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that Spark names (local, hdfs, s3, gs), and the path
    in it."""
    scheme, colon, rest = path.partition(":/")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if colon else path
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return fs.FileSystem.from_uri(quote(f"{scheme}:/{rest}", safe=":/@"))


def open_stored(path: str) -> pa.NativeFile:
    """A stream of a stored file."""
    system, inside = located(path)
    return system.open_input_stream(inside, compression=None)


def write_files(rows: DataFrame, folder: str) -> list[str]:
    """Write a file per ``name`` of ``name, content`` (text); the folders that count.

    A row is closed by a line break; null writes only that. Rows of one name that lie in one
    partition share a file. Each task attempt writes into a folder of its own, and only those
    of attempts that Spark counts are returned: one per partition that has rows. Unlike Spark's
    own partitioned sink this makes no directory and no checksum file per name.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, last = f"{folder}/{uuid.uuid4().hex}", None, None
        system, inside = located(own)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None or name != last:
                    if out is None:
                        system.create_dir(inside, recursive=True)
                    else:
                        out.close()
                    out, last = system.open_output_stream(f"{inside}/{name}", compression=None), name
                out.write((content.as_py() or b"") + b"\n")
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"folder": [own]})

    placed = rows.select("name", F.col("content").cast("binary")).sortWithinPartitions("name")
    return [row["folder"] for row in placed.mapInArrow(write, "folder string").collect()]


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of the data files below a folder; their content is not read. Spark
    deals them to tasks by their bytes, a large file to a task of its own; files without
    bytes are not listed."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "length")
    )


def file_digests(files: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``path, bytes, sha256`` of files of any size: each is read once, ``chunk`` bytes at a
    time, in the task that lists it. An unreadable file stops the job."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                digest, size = hashlib.sha256(), 0
                with open_stored(path) as f:
                    while part := f.read(chunk):
                        digest.update(part)
                        size += len(part)
                rows.append({"path": path, "bytes": size, "sha256": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(
                rows, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())])
            )

    return files.select("path").mapInArrow(read, DIGESTS)
