"""Byte access to the shared folder from inside tasks."""

from __future__ import annotations

from pyarrow import fs


def shared_file(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, hdfs, s3, gs) and the path in it."""
    if "://" not in uri:
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)
