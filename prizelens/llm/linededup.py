"""Remove repeated passages by content-defined chunks of lines.

The hashes of a text's lines run through a rolling hash of ``WINDOW`` lines; where its
top bits say so, a chunk ends. Boundaries depend on the lines around them only, so a
passage that many documents share is cut alike wherever it stands. ``LAYERS`` rolling
hashes with different seeds cut every text independently, so that short passages, too,
are likely to hold a whole chunk. A line of at least ``LONG_WORDS`` words is a passage by
itself and always a chunk of its own.

Besides, the shortest runs of whole lines that reach ``LONG_WORDS`` words, one from each
line onward and one from each line back, are chunks. Those of a shared passage lie in it
and cover it from its first line to its last, so every shared passage of so many words goes
whole, wherever it stands; the layers find shorter ones.

Chunk hashes are counted over all documents; only chunks whose hash repeats are looked at
again, by a 160-bit digest of their bytes (the runs overlap, so that the bytes themselves
would be many times the text). Equal ones keep their first place (smallest key, then
position) and lose all others, but for those that overlap the first. Counting is slim and partially aggregated; a passage that stands in
a third of all documents is a hot key in partial aggregates and in joins that adaptive
execution splits, never a group in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prizelens.llm.common import stored

WINDOW = 2
LAYERS = 4
MIN_LINES = 2  # lines with a word
MIN_BYTES = 60  # of a chunk; shorter ones are list items and headings rather than passages
LONG_WORDS = 50
MANY = 0x9E3779B97F4A7C15
CHUNKS = pa.schema([
    ("doc_id", pa.int64()), ("tag", pa.int64()), ("hash", pa.int64()),
    ("start", pa.int32()), ("n", pa.int32()),
])
CHUNKS_SQL = "doc_id long, tag long, hash long, start int, n int"
PARTS_SQL = "doc_id long, tag long, start int, n int, digest binary"


def chunks(lines: list[bytes]) -> list[tuple[int, int, int]]:
    """``(start, number of lines, hash)`` of the chunks that can be passages, all layers."""
    k = len(lines)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, k)
    filled = np.fromiter((bool(x.strip()) for x in lines), bool, k)
    size = np.fromiter(map(len, lines), np.int64, k)
    long = np.array(
        [i for i in np.flatnonzero(size >= 2 * LONG_WORDS - 1) if len(lines[i].split()) >= LONG_WORDS],
        np.int64,
    )
    found = {(int(i), 1): int(hashes[i]) for i in long}
    filled_to = np.concatenate([[0], np.cumsum(filled)])
    size_to = np.concatenate([[0], np.cumsum(size + 1)])
    forced = np.zeros(k + 1, bool)
    forced[[0, k]] = True
    forced[long] = forced[long + 1] = True
    for layer in range(LAYERS):
        rolled = np.full(k, layer * 1_000_003 + 1, np.uint64)
        for back in range(WINDOW):
            before = np.concatenate([np.zeros(back, np.uint64), hashes[: k - back]])[:k]
            rolled = (rolled ^ before) * np.uint64(MANY)
            rolled ^= rolled >> np.uint64(29)
        cut = forced.copy()
        cut[1:] |= (rolled >> np.uint64(63)).astype(bool)
        at = np.flatnonzero(cut)
        begin, end = at[:-1], at[1:]
        good = (filled_to[end] - filled_to[begin] >= MIN_LINES) & (size_to[end] - size_to[begin] > MIN_BYTES)
        for a, b in zip(begin[good].tolist(), end[good].tolist()):
            if (a, b - a) not in found:
                found[a, b - a] = xxhash.xxh3_64_intdigest(hashes[a:b].tobytes())
    for a, b in passages(lines):
        if (a, b - a) not in found:
            found[a, b - a] = xxhash.xxh3_64_intdigest(hashes[a:b].tobytes())
    return [(a, n, h) for (a, n), h in found.items()]


def passages(lines: list[bytes]) -> list[tuple[int, int]]:
    """``(start, end)`` of the shortest runs of at least ``LONG_WORDS`` words, from every
    line with a word onward and back."""
    k = len(lines)
    words_to = np.concatenate([[0], np.cumsum([len(x.split()) for x in lines])])
    filled = np.flatnonzero(np.diff(words_to))
    end = np.searchsorted(words_to, words_to[filled] + LONG_WORDS)
    onward = zip(filled[end <= k].tolist(), end[end <= k].tolist())
    last = filled[words_to[filled + 1] >= LONG_WORDS] + 1
    start = np.searchsorted(words_to, words_to[last] - LONG_WORDS, side="right") - 1
    return sorted({*onward, *zip(start.tolist(), last.tolist())})


def text_lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def find_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, tag, rows = [], [], []
        for d, t, text in zip(*(batch.column(c) for c in ("doc_id", "tag", "text"))):
            found = chunks(text_lines(text.as_py()))
            doc += [d.as_py()] * len(found)
            tag += [t.as_py()] * len(found)
            rows += found
        h = np.array([r[2] for r in rows], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(h),
             pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32())],
            schema=CHUNKS,
        )


def take_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the wanted chunks of each document."""
    for batch in batches:
        rows = []
        for d, t, text, wanted in zip(*(batch.column(c) for c in ("doc_id", "tag", "text", "wanted"))):
            lines = text_lines(text.as_py())
            for w in wanted.as_py():
                part = b"\n".join(lines[w["start"] : w["start"] + w["n"]])
                digest = hashlib.blake2b(part, digest_size=20).digest()
                rows.append((d.as_py(), t.as_py(), w["start"], w["n"], digest))
        cols = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "tag", "start", "n", "digest"]
        )


TRIMMED = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("n_lines", T.LongType()),
    T.StructField("n_removed", T.LongType()),
])


@F.arrow_udf(TRIMMED)
def without_lines(texts: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for text, spans in zip(texts, gone):
        text, spans = text.as_py(), spans.as_py() or []
        lines = (text or "").split("\n")
        drop = {i for s in spans for i in range(s["start"], s["start"] + s["n"])}
        if drop:
            text = "\n".join(x for i, x in enumerate(lines) if i not in drop)
        out.append({"text": text, "n_lines": len(lines), "n_removed": len(drop)})
    return pa.array(out, pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64())]))


def repeated_places(slim: DataFrame) -> DataFrame:
    """``doc_id, tag, spans``: the line spans of each document that repeat earlier ones."""
    found = stored(slim.mapInArrow(find_chunks, CHUNKS_SQL), "line-chunks")
    often = found.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1").select("hash")
    wanted = (
        found.join(often, "hash").groupBy("doc_id", "tag")
        .agg(F.collect_set(F.struct("start", "n")).alias("wanted"))  # chunks of one text, rows may repeat it
        .withColumnsRenamed({"doc_id": "_d", "tag": "_t"})
    )
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("tag").eqNullSafe(F.col("_t"))
    parts = stored(
        slim.join(wanted, same).select("doc_id", "tag", "text", "wanted")
        .mapInArrow(take_parts, PARTS_SQL), "repeated-chunks",
    )
    place = F.struct("doc_id", "tag", "start")
    # The first place of every text that repeats.
    # Stored, so that the join deals both sides anew and can split a hot passage.
    first = stored(
        parts.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("c"))
        .where("c > 1").drop("c"), "first-places",
    )
    overlaps = (
        F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("tag").eqNullSafe(F.col("first.tag"))
        & (F.col("start") < F.col("first.start") + F.col("n"))
    )
    later = parts.join(first, "digest").where(~overlaps)
    return later.groupBy("doc_id", "tag").agg(
        F.collect_set(F.struct("start", "n")).alias("spans")
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` less its repeated passages, and ``n_lines``, ``n_removed``.

    Removed are the lines of every passage of whole lines and at least 50 words, and of
    shorter chunks of at least two lines with words, that stands earlier: in a document of smaller key (null first), or
    further up in the same one. Rows that repeat both key and text are one document in
    this and keep or lose the same lines. A null text stays null and counts one line; an
    empty text has nothing to lose. Columns that are named like the new ones are replaced.
    """
    keyed = docs.withColumns({"_key": F.col(key).cast("long"), "_tag": F.xxhash64(F.col(text))})
    slim = keyed.select(F.col("_key").alias("doc_id"), F.col("_tag").alias("tag"), F.col(text).alias("text"))
    spans = repeated_places(slim).withColumnsRenamed({"doc_id": "_d", "tag": "_t"})
    same = F.col("_key").eqNullSafe(F.col("_d")) & (F.col("_tag") == F.col("_t"))
    out = keyed.join(spans, same, "left").withColumn("_new", without_lines(F.col(text), F.col("spans")))
    return out.withColumns({
        text: F.col("_new.text"), "n_lines": F.col("_new.n_lines"), "n_removed": F.col("_new.n_removed"),
    }).select(*docs.columns, *(c for c in ("n_lines", "n_removed") if c not in docs.columns))
