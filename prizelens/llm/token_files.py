"""Token-id files: every document's ids in order of ``doc_id``, coded by ``mixcoder``.

A file is a run of blocks followed by a directory and a footer::

    magic | block payloads | directory (deflated) | footer: directory offset, length, crc

The directory holds bits per id, and per block its number of ids, payload length and the
CRC-32 of its ids; per document its id, if it has one, and its number of ids. Blocks are
reset and checked on their own. One task writes one file from a range of ids; the table
of files is stored by Spark, so files of lost attempts are never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prizelens.llm import mixcoder
from prizelens.llm.byte_bpe import ByteBpe
from prizelens.llm.common import stored
from prizelens.llm.files import shared_file

MAGIC = b"IDMIX01\n"
FOOTER = "<QQI8s"
HEAD = "<BQQ"
FILES = "ordinal long, file string, n_docs long, n_ids long"
DOCS = "ordinal long, doc_id long, local_start long, n_tokens long, ids_crc32 long"
END_ID = 0


def coded(blocks: list[np.ndarray], bits: int) -> list[bytes]:
    """Block payloads in the given order; the coder wants the longest first."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    out: list[bytes] = [b""] * len(blocks)
    for i, code in zip(order, mixcoder.encode_blocks([blocks[i] for i in order], bits)):
        out[i] = code
    return out


class FileWriter:
    """Streams ids into one file, ``LANES`` blocks at a time."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.at = 0
        self.blocks: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int]] = []
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= mixcoder.BLOCK_IDS * mixcoder.LANES:
            self.flush(last=False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        step, most = mixcoder.BLOCK_IDS, mixcoder.BLOCK_IDS * mixcoder.LANES
        whole = len(ids) if last else len(ids) // most * most
        for start in range(0, whole, most):
            group = ids[start : min(start + most, whole)]
            blocks = [group[i : i + step] for i in range(0, len(group), step)]
            for block, code in zip(blocks, coded(blocks, self.bits)):
                self.blocks.append((len(block), len(code), mixcoder.checksum(block)))
                self.put(code)
        self.waiting = [ids[whole:]] if whole < len(ids) else []
        self.n_waiting = len(ids) - whole

    def close(self) -> None:
        self.flush(last=True)
        raw = struct.pack(HEAD, self.bits, len(self.blocks), len(self.docs))
        raw += np.array(self.blocks, "<u4").tobytes()
        raw += np.array([d is not None for d, _ in self.docs], "u1").tobytes()
        raw += np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
        raw += np.array([n for _, n in self.docs], "<u8").tobytes()
        packed = zlib.compress(raw)
        start = self.at
        self.put(packed)
        self.put(struct.pack(FOOTER, start, len(packed), zlib.crc32(packed), MAGIC))
        self.out.close()


def file_writer(folder: str, encode: Callable[[], Callable[[str], bytes]], bits: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to_ids, end = encode(), np.array([END_ID], "<u4")
        system, base = shared_file(folder)
        writer = None
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if writer is None:
                    name = f"part-{uuid.uuid4().hex}.idmix"
                    writer = FileWriter(
                        system.open_output_stream(f"{base}/{name}", compression=None), bits
                    )
                ids = np.frombuffer(to_ids(text or ""), "<u4")
                writer.add(None if pd.isna(doc_id) else int(doc_id), np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            yield pd.DataFrame({
                "ordinal": [TaskContext.get().partitionId()], "file": [name],
                "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids],
            })

    return write


def write_ids(
    docs: DataFrame, key: str, text: str, folder: str, encode: Callable, bits: int
) -> DataFrame:
    """Write the ids of every document, each closed by id 0, in ascending order of
    ``key`` (nulls first, repeated keys by a hash of their texts); the table of files.

    ``encode()`` gives, in the task, a function from text to little-endian 32-bit ids.
    A null text has no ids but the end. Texts are shuffled once, by range; a key that
    repeats is split by the text hash. Other columns are not read; without rows no file
    is written.
    """
    system, base = shared_file(folder)
    system.create_dir(base, recursive=True)
    placed = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"),
        F.xxhash64(F.col(text)).alias("_h"),
    )
    placed = placed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    return stored(
        placed.select("doc_id", "text").mapInPandas(file_writer(folder, encode, bits), FILES),
        "id-files",
    )


def read_directory(f) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits, blocks, and per document whether it has an id, the id, its number of ids."""
    size = f.size()
    tail = struct.calcsize(FOOTER)
    f.seek(size - tail)
    start, length, crc, magic = struct.unpack(FOOTER, f.read(tail))
    f.seek(start)
    packed = f.read(length)
    if magic != MAGIC or zlib.crc32(packed) != crc:
        raise ValueError("damaged id file directory")
    raw = zlib.decompress(packed)
    bits, n_blocks, n_docs = struct.unpack_from(HEAD, raw)
    at = struct.calcsize(HEAD)
    blocks = np.frombuffer(raw, "<u4", n_blocks * 3, at).reshape(-1, 3).astype(np.int64)
    at += n_blocks * 12
    has = np.frombuffer(raw, "u1", n_docs, at)
    doc = np.frombuffer(raw, "<i8", n_docs, at + n_docs)
    n = np.frombuffer(raw, "<u8", n_docs, at + n_docs * 9).astype(np.int64)
    return bits, blocks, has, doc, n


def read_ids(f) -> Iterator[np.ndarray]:
    """The ids of a file in order, ``LANES`` blocks at a time, each block checked."""
    bits, blocks, *_ = read_directory(f)
    f.seek(len(MAGIC))
    for first in range(0, len(blocks), mixcoder.LANES):
        part = blocks[first : first + mixcoder.LANES]
        codes = [f.read(int(k)) for k in part[:, 1]]
        order = np.argsort(-part[:, 0], kind="stable")
        found = mixcoder.decode_blocks([codes[i] for i in order], part[order, 0], bits)
        out = [None] * len(part)
        for i, ids in zip(order, found):
            if mixcoder.checksum(ids) != part[i, 2]:
                raise ValueError(f"block {first + i} does not match its checksum")
            out[i] = ids
        yield np.concatenate(out)


def file_reader(folder: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = shared_file(folder)
        for batch in batches:
            for ordinal, name in zip(batch["ordinal"], batch["file"]):
                with system.open_input_file(f"{base}/{name}") as f:
                    _, _, has, doc, n = read_directory(f)
                    crcs, open_crc, k = [], 0, 0
                    left = int(n[0]) if len(n) else 0
                    for ids in read_ids(f):
                        data, at = memoryview(ids.tobytes()), 0
                        while at < len(ids):
                            m = min(left, len(ids) - at)
                            open_crc = zlib.crc32(data[4 * at : 4 * (at + m)], open_crc)
                            at, left = at + m, left - m
                            if not left:
                                crcs.append(open_crc)
                                open_crc, k = 0, k + 1
                                left = int(n[k]) if k < len(n) else 0
                    yield pd.DataFrame({
                        "ordinal": ordinal,
                        "doc_id": pd.array(np.where(has, doc, 0), "Int64").copy(),
                        "local_start": np.cumsum(n) - n,
                        "n_tokens": n,
                        "ids_crc32": crcs,
                    }).assign(doc_id=lambda d, has=has: d["doc_id"].where(has.astype(bool)))

    return read


def read_documents(files: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    # A task per file: the rows are tiny, so their number must say so.
    spread = files.select("ordinal", "file").repartitionByRange(max(1, files.count()), "ordinal")
    rows = spread.mapInPandas(file_reader(folder), DOCS)
    # One row per file: a window without a key, bounded by the number of write tasks.
    before = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(
        F.col("ordinal").alias("_o"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_start")
    )
    return rows.join(starts, F.col("ordinal") == F.col("_o")).select(
        "doc_id", (F.col("_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def byte_bpe_encoder(path: str, pattern: str) -> Callable[[], Callable[[str], bytes]]:
    return lambda: ByteBpe.of_worker(path, pattern).encode
