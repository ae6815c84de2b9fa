"""Harmonic packing of documents into sequences of a fixed capacity.

Class k holds pieces whose length lies just under the k-th part of the capacity, so that k
of them fill a sequence but for ``slack`` tokens. A document is cut into whole sequences and
the fewest pieces that each fall in a class. Every worker fills its own sequences: a class's
sequence is done when it holds k pieces, whatever the other classes and workers do. What a
worker has left, less than one sequence a class, is merged by the same rule in groups of
``FAN_IN`` workers until one group is left; its last pieces are joined and cut at the capacity,
and the end is cut at powers of two, which take no padding. Texts are never shuffled.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prizelens.llm.common import stored

FAN_IN = 64
SLACK = 8  # most tokens that a full sequence may lack
BATCH_BYTES = 16 << 20
END_ID = 1

PIECE = pa.struct([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("offset", pa.int64()), ("doc_tokens", pa.int64()),
])
SEQUENCE = pa.schema([
    ("sequence_id", pa.int64()), ("part", pa.int64()), ("klass", pa.int32()),
    ("ids", pa.binary()), ("pieces", pa.list_(PIECE)),
])
SCHEMA = (
    "sequence_id long, part long, klass int, ids binary, pieces array<struct<doc_id long, "
    "start long, length long, offset long, doc_tokens long>>"
)


def cut_plan(capacity: int, slack: int) -> list[list[int]]:
    """Per length up to the capacity: the fewest lengths that belong to a class and add up
    to it, longest first."""
    sizes = [s for s in range(capacity, 0, -1) if capacity % s <= slack]
    plan: list[list[int]] = [[]]
    for n in range(1, capacity + 1):
        first = min((s for s in sizes if s <= n), key=lambda s: len(plan[n - s]))
        plan.append(sorted([first, *plan[n - first]], reverse=True))
    return plan


class Filler:
    """Sequences of one worker: ``add`` pieces, ``full`` ones come out."""

    def __init__(self, capacity: int, prefix: int):
        self.capacity, self.next = capacity, prefix
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def add(self, piece: tuple) -> tuple | None:
        """``piece``: document, start, ids as bytes, tokens of the document."""
        klass = self.capacity // (len(piece[2]) // 4)
        bin_ = self.open[klass]
        bin_.append(piece)
        if len(bin_) < klass:
            return None
        del self.open[klass]
        return self.closed(bin_)

    def closed(self, pieces: list[tuple]) -> tuple:
        self.next += 1
        return self.next - 1, None, pieces

    def rest(self) -> list[tuple]:
        return [(None, klass, pieces) for klass, pieces in sorted(self.open.items())]

    def closing(self) -> Iterator[tuple]:
        """The rest in one run of ids, cut at the capacity and in the end at powers of two."""
        waiting = [p for _, pieces in sorted(self.open.items()) for p in pieces]
        left = sum(len(p[2]) // 4 for p in waiting)
        waiting.reverse()
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                doc, start, ids, total = waiting.pop()
                take = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    waiting.append((doc, start + take, ids[4 * take :], total))
                room -= take
            yield self.closed(pieces)


def to_batch(rows: list[tuple], part: int) -> pa.RecordBatch:
    """``rows``: sequence id or None, class or None, pieces."""
    bounds, flat = [0], []
    for _, _, pieces in rows:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            flat.append((doc, start, n, at, total))
            at += n
        bounds.append(len(flat))
    columns = zip(*flat) if flat else ((),) * 5
    structs = pa.StructArray.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], [f.name for f in PIECE]
    )
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([part] * len(rows), pa.int64()),
        pa.array([r[1] for r in rows], pa.int32()),
        pa.array([b"".join(p[2] for p in r[2]) for r in rows], pa.binary()),
        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs),
    ], schema=SEQUENCE)


def prefix(level: int, part: int) -> int:
    """First sequence id of a worker: room for 2^26 sequences, 2^32 workers, 16 levels."""
    return level << 58 | part << 26


def fill(encode: Callable[[], Callable[[str], bytes]], capacity: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, end = encode(), struct.pack("<I", END_ID)
        plan, part = cut_plan(capacity, slack), TaskContext.get().partitionId()
        filler, out, size = Filler(capacity, prefix(0, part)), [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                doc, ids = doc.as_py(), to_ids(text.as_py() or "") + end
                total, at = len(ids) // 4, 0
                for n in [capacity] * (total // capacity) + plan[total % capacity]:
                    done = filler.add((doc, at, ids[4 * at : 4 * (at + n)], total))
                    at += n
                    if done:
                        out.append(done)
                        size += 4 * capacity
                        if size > BATCH_BYTES:
                            yield to_batch(out, part)
                            out, size = [], 0
        yield to_batch(out + filler.rest(), part)

    return run


def pieces_of(table: pa.Table) -> Iterable[tuple]:
    for row in table.select(["ids", "pieces"]).to_pylist():
        for p in row["pieces"]:
            ids = row["ids"][4 * p["offset"] : 4 * (p["offset"] + p["length"])]
            yield p["doc_id"], p["start"], ids, p["doc_tokens"]


def merge(capacity: int, level: int, last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        filler = Filler(capacity, prefix(level, part))
        out = [done for p in pieces_of(table) if (done := filler.add(p))]
        out += filler.closing() if last else filler.rest()
        return pa.Table.from_batches([to_batch(out, part)])

    return run


def pack(
    docs: DataFrame, key: str, text: str, encode: Callable, capacity: int = 2048, slack: int = SLACK
) -> DataFrame:
    """Sequences of all documents: ``sequence_id, n_tokens, ids`` (little-endian 32-bit) and
    ``pieces`` (``doc_id, start, length, offset, doc_tokens``), in their order in the sequence.

    ``encode()`` gives, in the task, a function from text to little-endian 32-bit ids; id 1
    closes each document, so a null or empty text is one token. A full sequence lacks at most
    ``slack`` tokens; the last ones may be shorter powers of two. 0 cuts at powers of two
    alone, more slack cuts documents less. Rows with equal or null keys are documents of their
    own; other columns are not read; no rows give no sequences. Ids of sequences are unique but not
    dense.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    filled = stored(rows.mapInArrow(fill(encode, capacity, slack), SCHEMA), "packed")
    done = filled.where(F.col("sequence_id").isNotNull())
    rest = filled.where(F.col("sequence_id").isNull())
    parts = filled.agg(F.max("part")).first()[0]
    level = 0
    while parts is not None:
        level, parts = level + 1, parts // FAN_IN
        # A group is bounded: FAN_IN workers times less than a sequence per class.
        groups = rest.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part")
        merged = stored(groups.applyInArrow(merge(capacity, level, parts == 0), SCHEMA), "packed-rest")
        done = done.union(merged.where(F.col("sequence_id").isNotNull()))
        rest = merged.where(F.col("sequence_id").isNull())
        if parts == 0:
            break
    return done.select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "pieces")


def padded(ids: Column, capacity: int, pad_id: int) -> Column:
    """Ids brought to the capacity, unless their number is a power of two."""
    n = (F.octet_length(ids) / 4).cast("long")
    pad = F.lit(struct.pack("<I", pad_id))
    return F.when(F.bit_count(n) == 1, ids).otherwise(F.rpad(ids, F.lit(4 * capacity), pad))


def pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece, with its ids."""
    rows = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    at = (F.col("p.offset") * 4 + 1).cast("int")
    return rows.select(
        "p.doc_id", "p.start", "p.length", "p.doc_tokens", "sequence_id", "p.offset",
        F.substring("ids", at, (F.col("p.length") * 4).cast("int")).alias("ids"),
    )
