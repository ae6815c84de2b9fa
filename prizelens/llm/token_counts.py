"""Token counts by a map-side two-tier lookup of pre-token lengths.

Tier one is a compact table of frequent pre-tokens and their lengths in tokens,
broadcast to the executors. Its bound is the vocabulary: a trained byte-level BPE
holds the frequent words of its language as single entries, and an entry that is a
whole pre-token is one row of the table. Tier two is a memo in each Python worker that
encodes what the table misses. No pre-token is shuffled; the text is read once.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prizelens.llm.byte_bpe import MEMO_TOKENS, ByteBpe
from prizelens.llm.common import worker_memo


def frequent_lengths(path: str, pattern: str, more: Iterable[str] = ()) -> tuple[bytes, bytes]:
    """Pre-tokens that are vocabulary entries (and ``more``), joined by a zero byte in
    UTF-8, with their lengths in tokens, one byte each. At most one row per entry."""
    bpe = ByteBpe(path, pattern)
    ids = range(bpe.tokenizer.get_vocab_size(with_added_tokens=False))
    texts = bpe.tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
    rows = {t for t in (*texts, *more) if t and "\0" not in t and "�" not in t}
    rows = sorted(t for t in rows if bpe.split(t) == [t])
    kept = [(t, n) for t in rows if (n := len(bpe.part(t))) < 256]
    return "\0".join(t for t, _ in kept).encode(), bytes(n for _, n in kept)


class Lengths(dict):
    """Pre-token to length: the frequent table, then what this worker has encoded itself."""

    def __init__(self, table: tuple[bytes, bytes], bpe: ByteBpe):
        self.frequent = dict(zip(table[0].decode().split("\0"), table[1]))
        self.update(self.frequent)
        self.bpe = bpe

    def __missing__(self, part: str) -> int:
        if len(self) > MEMO_TOKENS + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        n = self[part] = len(self.bpe.part(part))
        return n

    def count(self, text: str) -> int:
        parts = self.bpe.split(text)
        if parts is None:
            return len(self.bpe.whole(text))
        return sum(map(self.__getitem__, parts))


def token_count(path: str, pattern: str, table: Broadcast) -> callable:
    """A column function: tokens of a text, 0 for null."""

    @F.arrow_udf("long")
    def tokens(texts: pa.Array) -> pa.Array:
        memo = worker_memo("token_lengths")
        if (path, pattern) not in memo:
            memo[path, pattern] = Lengths(table.value, ByteBpe.of_worker(path, pattern))
        lengths = memo[path, pattern]
        return pa.array((lengths.count(t.as_py()) if t.is_valid else 0 for t in texts), pa.int64())

    return tokens


def count_tokens(
    docs: DataFrame, text: Column, path: str, pattern: str, more: Iterable[str] = ()
) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and nothing else changed.

    Null and empty texts have 0 bytes and 0 tokens. Counts equal the library's without
    added special tokens, truncation or padding; special strings inside a text count as
    the library does by default. Columns of ``docs`` that are named like the new ones
    are replaced. Repeated rows stay.
    """
    spark: SparkSession = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(path, pattern, more))
    tokens = token_count(path, pattern, table)
    return docs.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
            "n_tokens": tokens(text),
        }
    )
