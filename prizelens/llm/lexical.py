"""Ranked lexical search: the best documents of every item by the Best Position Algorithm.

The index is partitioned by document: a task turns its documents into postings of the
terms that items ask for and orders each term's postings by impact (the part of the score
that the term gives the document). An item walks its impact lists side by side. A document
met in one list is looked up in all others at once (direct access), which gives its whole
score and marks its position in every list as seen. Each list's best position is the end of
the positions seen without a gap; no unseen document can score more than the sum of the
impacts behind the best positions, so the walk stops as soon as that sum is strictly
below the k-th score. A list read only in order would still stand at the position last read, so best
positions stop earlier or at the same place. The k-th score is carried from one shard of a task
to the next; the items' best documents of all tasks meet in one ranking.

Texts are read twice (term statistics, then search) and never shuffled. Items come in
blocks of a bounded number of terms, each block a broadcast and a pass of its own, so the
broadcast does not grow with the items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The bytes that are no part of a term in UTF-8 are ASCII without letters and
# digits; only A-Z are folded.
FOLD = bytes(
    b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
    for b in range(256)
)
BLOCK_TERMS = 400_000  # terms of the items in one broadcast
BLOCK_ITEMS = 10_000  # items of one broadcast, whose best documents a task holds
SHARD_POSTINGS = 3_000_000  # postings of a shard before it is searched
FIRST_STEP = 32  # positions read at first; doubled each time, so few steps reach any depth

STATS = "term int, df long, n_docs long, n_terms long"
FOUND = "item int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return text.translate(FOLD).split() if text else []


def binaries(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, one at a time."""
    large = pa.types.is_large_string(column.type)
    return (x.as_py() for x in column.cast(pa.large_binary() if large else pa.binary()))


def term_statistics(docs: DataFrame, vocabulary) -> DataFrame:
    """Rows ``term, df, n_docs, n_terms`` of every task: term -1 counts documents with terms
    and all their terms, others the documents that hold the term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = vocabulary.value
        df, n_docs, n_terms = Counter(), 0, 0
        for batch in batches:
            for text in binaries(batch.column(0)):
                found = terms_of(text)
                n_docs += bool(found)
                n_terms += len(found)
                df.update(codes.keys() & set(found))
        rows = [(-1, 0, n_docs, n_terms), *((codes[t], n, 0, 0) for t, n in df.items())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
            ["term", "df", "n_docs", "n_terms"],
        )

    return docs.select("text").mapInArrow(count, STATS).groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms")
    )


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Lists:
    """A shard's postings by term: in order of impact, and in order of document with the
    position in the impact order."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_codes: int):
        by_impact = np.lexsort((doc, -impact, term))
        self.start = np.searchsorted(term[by_impact], np.arange(n_codes + 1))
        self.doc, self.impact = doc[by_impact], impact[by_impact]
        by_doc = np.lexsort((doc, term))
        self.doc_sorted = doc[by_doc]
        rank = np.empty(len(doc), np.int32)
        rank[by_impact] = np.arange(len(doc), dtype=np.int32)
        # The order by document has the same bounds per term.
        self.position = rank[by_doc] - self.start[term[by_doc]].astype(np.int32)

    def of(self, code: int) -> tuple[np.ndarray, ...]:
        s = slice(self.start[code], self.start[code + 1])
        return self.doc[s], self.impact[s], self.doc_sorted[s], self.position[s]


class Best:
    """The k best ``(score, doc_id)`` so far: higher scores first, then smaller ids, null first."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def floor(self) -> int:
        """A later score below this cannot enter; one equal to it still can."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        rows = self.rows + list(zip(scores.tolist(), ids))
        rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1] or 0))
        self.rows = rows[: self.k]


def best_positions(lists: list[tuple], repeats: list[int], n_docs: int, best: Best, ids) -> int:
    """Search one item in one shard; the number of documents it looked up.

    ``lists``: per term its documents and impacts by impact, its documents in order and their
    positions. ``ids`` gives the document ids of an array of documents.
    """
    known = np.zeros(n_docs, bool)
    seen = [np.zeros(len(x[0]) + 1, bool) for x in lists]  # the last one stays False
    ends = [0] * len(lists)  # best positions: all before are seen
    depth, size = 0, FIRST_STEP
    while True:
        near = [x[0][depth : depth + size] for x in lists]
        new = np.unique(np.concatenate(near)) if near else np.empty(0, np.int64)
        new = new[~known[new]]
        known[new] = True
        score = np.zeros(len(new), np.int64)
        for (_, impact, docs, position), c, mark in zip(lists, repeats, seen):
            at = np.searchsorted(docs, new)
            at[at == len(docs)] = 0
            hit = docs[at] == new
            place = position[at[hit]]
            score[hit] += c * impact[place]
            mark[place] = True
        better = score >= best.floor
        if better.any():
            best.add(score[better], ids(new[better]))
        depth, size = depth + size, size * 2
        most = 0
        for i, (x, c, mark) in enumerate(zip(lists, repeats, seen)):
            ends[i] += int(np.argmin(mark[ends[i] :]))
            if ends[i] < len(x[0]):
                most += c * int(x[1][ends[i]])
        # Documents not seen yet cannot reach the floor, or there are none.
        if most < best.floor:
            return int(known.sum())


class Shard:
    """Postings of documents until there are enough to search."""

    def __init__(self, n_codes: int, weights: np.ndarray, n_docs: int, n_terms: int):
        self.n_codes, self.weights, self.totals = n_codes, weights, (n_docs, n_terms)
        self.clear()

    def clear(self) -> None:
        self.ids, self.parts, self.postings = [], [], 0

    def add(self, doc_id: int | None, found: list[bytes], codes: dict) -> None:
        held = Counter(filter(None.__ne__, map(codes.get, found)))
        if not held:
            return
        n_docs, n_terms = self.totals
        m = 100 - 25 + 25 * len(found) * n_docs // n_terms
        term = np.fromiter(held.keys(), np.int32, len(held))
        tf = np.fromiter(held.values(), np.int64, len(held))
        impact = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
        self.parts.append((term, np.full(len(term), len(self.ids), np.int32), impact))
        self.ids.append(doc_id)
        self.postings += len(term)

    def search(self, items: list[dict[int, int]], best: list[Best]) -> None:
        if not self.ids:
            return
        term, doc, impact = (np.concatenate(c) for c in zip(*self.parts))
        self.parts = []
        some = impact > 0
        lists = Lists(term[some], doc[some], impact[some], self.n_codes)
        for item, top in zip(items, best):
            own = [(lists.of(code), n) for code, n in item.items()]
            own = [(x, n) for x, n in own if len(x[0])]
            if own:
                best_positions(
                    [x for x, _ in own], [n for _, n in own], len(self.ids), top,
                    lambda docs: [self.ids[d] for d in docs.tolist()],
                )
        self.clear()


def searcher(shared, k: int, shard_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, weights, items, n_docs, n_terms = shared.value
        best = [Best(k) for _ in items]
        shard = Shard(len(codes), weights, n_docs, n_terms)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), binaries(batch.column(1))):
                shard.add(doc_id.as_py(), terms_of(text), codes)
                if shard.postings > shard_postings:
                    shard.search(items, best)
        shard.search(items, best)
        rows = [(i, d, s) for i, top in enumerate(best) for s, d in top.rows]
        columns = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))],
            ["item", "doc_id", "score"],
        )

    return run


def item_blocks(items: DataFrame, block_terms: int) -> Iterator[list]:
    """Items as ``(item_id, terms)`` in blocks of about ``block_terms`` terms, one by one
    through the driver."""
    block, size = [], 0
    for row in items.toLocalIterator():
        found = terms_of(None if row.text is None else row.text.encode())
        if block and (size + len(found) > block_terms or len(block) == BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((row.item_id, found))
        size += len(found)
    if block:
        yield block


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 20,
    block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id, rank, doc_id, score``.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; other columns are
    not read. Null, empty and term-less texts count for no statistics and are never found; such
    an item finds nothing. Every row is a document, and every row of ``items`` an item, also if its
    id repeats or is null. Equal scores are ranked by ascending ``doc_id``, null first. Without
    documents or items the result is empty. All documents are searched and ``k`` rows per item
    and task meet in the ranking, so no item's group grows with the documents themselves.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = None
    for block in item_blocks(items.select("item_id", "text"), block_terms):
        vocabulary = sorted({t for _, terms in block for t in terms})
        codes = {t: i for i, t in enumerate(vocabulary)}
        # At most one row per term of the block.
        stats = term_statistics(docs, spark.sparkContext.broadcast(codes)).collect()
        n_docs, n_terms = next(((r.n_docs, r.n_terms) for r in stats if r.term == -1), (0, 0))
        weights = np.zeros(len(codes), np.int64)
        for r in stats:
            if r.term >= 0:
                weights[r.term] = weight(n_docs, r.df)
        asked = [dict(Counter(codes[t] for t in terms)) for _, terms in block]
        shared = spark.sparkContext.broadcast((codes, weights, asked, n_docs, n_terms))
        names = spark.createDataFrame(
            [(i, item_id) for i, (item_id, _) in enumerate(block)], f"item int, item_id {kind.simpleString()}"
        )
        rows = docs.mapInArrow(searcher(shared, k, shard_postings), FOUND)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        rows = rows.join(names, "item").select("item_id", "rank", "doc_id", "score")
        found = rows if found is None else found.union(rows)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return found
