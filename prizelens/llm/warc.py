"""WARC archives: index first, then coalesced byte-range reads.

Writing: every task streams its pages into archive files of its own in the shared folder,
one gzip member per record, and returns an index row per record with file, offset,
length, URL and digest. Spark commits the index as a table. File names hold a fresh id
per attempt, so a task that is lost or runs twice leaves a file that no index names.

Reading: the wanted index rows are dealt in ranges of (file, offset), sorted, and
neighbouring ranges are fetched by one read each.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prizelens.llm.common import stored
from prizelens.llm.files import shared_file
from prizelens.session import new_run_dir

FILE_BYTES = 1 << 30  # a file is closed once it holds this much
GAP_BYTES = 64 << 10  # ranges closer than this are read together
READ_BYTES = 8 << 20  # and up to this much at once
TASK_BYTES = 16 << 20  # of archives that a task reads, about
LEVEL = 6
INDEX = (
    "file string, offset long, length long, page_id long, url string, digest string,"
    " record_type string, refers_to long"
)
READ = (
    "page_id long, url string, payload_bytes long, payload_digest string,"
    " record_type string, refers_to long, payload binary"
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_text(value) -> str:
    """A header value on one line; what would break the line is percent-encoded."""
    value = "" if value is None else str(value)
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def plain_text(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the length of the
    payload, and names the record that holds the payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{header_text(page_id)}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_text(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    lines += [
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(data: bytes) -> dict:
    """The fields of one record; fails if its block does not match its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != "sha1:" + sha1_base32(block):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    number = lambda urn: None if urn is None or urn == "<urn:page:>" else int(urn[10:-1])
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": None if url is None else plain_text(url),
        "payload_bytes": length,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def archive_writer(folder: str, date: str, file_bytes: int):
    """Streams pages into archives below ``folder``; gives the index rows."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = shared_file(folder)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                index = []
                for page_id, url, html, same in zip(
                    batch["page_id"], batch["url"], batch["html"], batch["refers_to"]
                ):
                    page_id = None if pd.isna(page_id) else int(page_id)
                    same = None if pd.isna(same) or same == page_id else int(same)
                    payload = b"" if html is None else html.encode()
                    digest = sha1_base32(payload)
                    data = gzip_member(record(page_id, url, payload, digest, same, date))
                    if out is None or offset + len(data) > file_bytes and offset:
                        if out is not None:
                            out.close()
                        name, offset = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(data)
                    kind = "response" if same is None else "revisit"
                    index.append((name, offset, len(data), page_id, url, digest, kind, same))
                    offset += len(data)
                rows = pd.DataFrame(index, columns=[c.split()[0] for c in INDEX.split(", ")])
                yield rows.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(
    pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write ``page_id, url, html`` of ``pages`` as WARC records below ``folder``; the
    stored index table.

    Of equal payloads the row with the largest ``page_id`` is the response and the others
    are revisits of it; rows that repeat both payload and that ``page_id`` are responses,
    too. Null html is an empty payload; where all ids of a payload are null, all its rows
    are responses. Other columns are not read; an empty table gives an empty index.
    """
    plain = pages.select(
        "page_id", F.col("url").cast("string").alias("url"), "html",
        F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("_sha"),
    )
    # Rows of a hot payload meet in partial aggregates only; each (payload, id) gets its
    # answer by a slim join, and the texts are shuffled once, by that spread-out pair.
    ids = plain.select("_sha", "page_id").distinct()
    best = ids.groupBy("_sha").agg(F.max("page_id").alias("refers_to"))
    ids = ids.join(best, "_sha").withColumnsRenamed({"_sha": "_s", "page_id": "_p"})
    joined = plain.join(
        ids, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("_sha") == F.col("_s"))
    ).select("page_id", "url", "html", "refers_to")
    system, base = shared_file(folder)
    system.create_dir(base, recursive=True)
    return stored(joined.mapInPandas(archive_writer(folder, date, file_bytes), INDEX), "warc-index")


def ranges(rows: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list]]:
    """Sorted (offset, length) pairs as reads: start, end and the pairs inside."""
    start, end, inside = -1, -1, []
    for offset, length in rows:
        if inside and offset - end <= gap and offset + length - start <= most:
            end = max(end, offset + length)
            inside.append((offset, length))
        else:
            if inside:
                yield start, end, inside
            start, end, inside = offset, offset + length, [(offset, length)]
    if inside:
        yield start, end, inside


def archive_reader(folder: str, gap: int, most: int, payloads: bool):
    """Reads the records of index rows that come sorted by file and offset."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = shared_file(folder)
        for batch in batches:
            for name, rows in batch.groupby("file", sort=False):
                with system.open_input_file(f"{base}/{name}") as f:
                    wanted = list(zip(rows["offset"].tolist(), rows["length"].tolist()))
                    for start, end, inside in ranges(wanted, gap, most):
                        f.seek(start)
                        data = f.read(end - start)
                        found = [
                            parse_record(zlib.decompress(data[o - start : o - start + n], 31))
                            for o, n in inside
                        ]
                        out = pd.DataFrame(found, columns=[c.split()[0] for c in READ.split(", ")])
                        if not payloads:
                            out["payload"] = None
                        yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return read


def read_archives(
    index: DataFrame, folder: str, payloads: bool = True, gap: int = GAP_BYTES, most: int = READ_BYTES
) -> DataFrame:
    """The records that ``index`` names, read from the archives below ``folder``.

    Revisits have no payload but the length and digest of the one they refer to. A record
    that does not match its digest stops the job.
    """
    # Index rows are tiny next to what they name, so the archives' bytes set the tasks.
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = 1 + total // TASK_BYTES
    placed = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset")
    placed = placed.sortWithinPartitions("file", "offset")
    return placed.mapInPandas(archive_reader(folder, gap, most, payloads), READ)


def round_trip(pages: DataFrame, label: str = "warc") -> DataFrame:
    """Write all pages, then read every record back."""
    folder = new_run_dir(pages.sparkSession, label)
    return read_archives(write_archives(pages, folder), folder, payloads=False).drop("payload")
