"""Near-duplicate texts by MinHash with tensored banding.

Plain banding needs ``tables x width`` hash functions. Here two small collections of band
hashes are combined pairwise: ``SIDE`` left and ``SIDE`` right bands of ``WIDTH`` values
each give ``SIDE**2`` tables from ``2 * SIDE * WIDTH`` functions. A pair of similarity s
shares a table unless it misses all left or all right bands, about
``2 (1 - s**WIDTH)**SIDE``: 6 in 10,000 at 0.8, 7 in 100,000 at 0.85.

Texts with equal shingle sets are one class and only classes are compared. Within a table
entry, a few heads are compared with the members that are not yet in their component, by
their full sets, and then leave the entry. An entry is done when all that remain are of one
component, or so few that their pairs are compared at once. What is still larger is mostly
unlike: it is dealt anew to finer entries, which share one more of the ``2 * SIDE`` bands
each, up to ``DEEP`` bands. A pair of similarity 0.8 that an entry holds shares fewer in 2 of
10,000 cases, and only where all its entries are that large. So a large group of copies
costs a few stars, never all its pairs, and a frequent phrase does not pair all who use it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prizelens.llm.common import Turns, dealt, stored
from prizelens.llm.components import components

SIDE, WIDTH = 8, 2
HEADS = 4  # compared with an entry at a time, after the first
SMALL = 32  # members of an entry whose pairs are compared at once
DEEP = 4  # bands of the finest entries; what is larger even there is settled by heads and
# pairs of four times as many members with every turn, so that the turns stay few
SEED = 20_240
ROWS_AT_ONCE = 16_384  # shingles hashed at once, which bounds a task's memory
MANY = 0xFF51AFD7ED558CCD  # odd multiplier


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (one-to-one)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MANY)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles; of the whole sequence
    where it has fewer words; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(k, n)
    acc = h[: n - width + 1] + np.uint64(width)
    for j in range(1, width):
        acc = mixed(acc) + h[j : n - width + 1 + j]
    return np.unique(mixed(acc))


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    """``2 * SIDE`` band values, the left collection first."""
    rng = np.random.default_rng(SEED)
    n = 2 * SIDE * WIDTH
    times = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, n, np.uint64)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), ROWS_AT_ONCE):
        part = shingles[start : start + ROWS_AT_ONCE, None]
        least = np.minimum(least, (part * times + plus).min(0))
    bands = least.reshape(2 * SIDE, WIDTH)
    acc = bands[:, 0]
    for j in range(1, WIDTH):
        acc = mixed(acc) + bands[:, j]
    return mixed(acc)


SIGNED_SQL = "n long, cls binary, bands array<long>"
SETS_SQL = "cls binary, shingles array<long>"


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signer(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sizes, classes and bands of the texts, behind the other columns."""
        for batch in batches:
            n, cls, bands = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                cls.append(digest(s) if len(s) else None)
                bands.append(band_hashes(s).view(np.int64) if len(s) else None)
            own = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array(n, pa.int64()), pa.array(cls, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=[*own, "n", "cls", "bands"],
            )

    return sign


def set_maker(k: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in (shingle_set(t.as_py(), k) for t in batch.column("text")) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(digest, sets), pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["cls", "shingles"],
            )

    return make


def table_keys(reps: DataFrame) -> DataFrame:
    """``key, mask, nid, n``: one row per class and table. The mask tells the bands in the key."""
    pairs = F.explode(F.array(*(
        F.struct(
            F.xxhash64(F.lit(i * SIDE + j), F.col("bands")[i], F.col("bands")[SIDE + j]).alias("key"),
            F.lit(1 << i | 1 << (SIDE + j)).alias("mask"),
        )
        for i in range(SIDE) for j in range(SIDE)
    )))
    return reps.select(pairs.alias("p"), "nid", "n").select("p.key", "p.mask", "nid", "n")


def shared_entries(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` whose key comes more than once."""
    entries = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return dealt(keys).join(entries, "key")


def finer_entries(members: DataFrame, reps: DataFrame) -> DataFrame:
    """``members`` with every large entry that still holds several components dealt to
    finer ones, whose keys hold one more band each. Entries of one component go."""
    still = members.groupBy("key").agg(
        F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size")
    ).where("c0 < c1").select("key", "size")
    found = members.join(still, "key")
    coarse = (F.col("size") > SMALL) & (F.bit_count("mask") < DEEP)
    bands = reps.select(F.col("nid").alias("_n"), "bands")
    split = found.where(coarse).join(dealt(bands), F.col("nid") == F.col("_n"))
    # The key is a function of the bands alone, so entries that meet in finer ones become one.
    more = F.array(*(F.col("mask").bitwiseOR(F.lit(1 << b)) for b in range(2 * SIDE)))
    split = split.withColumn("m", F.explode(F.filter(more, lambda m: m != F.col("mask"))))
    chosen = F.array(*(
        F.when(F.col("m").bitwiseAND(F.lit(1 << b)) != 0, F.col("bands")[b]) for b in range(2 * SIDE)
    ))
    split = split.select(F.xxhash64("m", chosen).alias("key"), F.col("m").alias("mask"), "nid", "n", "comp")
    return found.where(~coarse).drop("size").unionByName(split.dropDuplicates(["key", "nid"]))


def similar_sizes(percent: int, n: str, m: str):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The components ``a, b`` of the pairs ``x, y`` whose full sets are similar enough."""
    one = sets.select(F.col("nid").alias("x"), F.col("shingles").alias("sx"))
    two = sets.select(F.col("nid").alias("y"), F.col("shingles").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    union = F.size("sx") + F.size("sy") - both
    found = pairs.join(one, "x").join(two, "y").where(100 * both >= percent * union)
    return found.select(F.col("cx").alias("a"), F.col("cy").alias("b")).distinct()


def ordered_pairs(left: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``x > y`` with their components, of ``nid, n, comp`` and ``h``."""
    near = left.where("comp <> h.comp").where(similar_sizes(percent, "n", "h.n"))
    flip = F.col("nid") < F.col("h.nid")
    return near.select(
        F.greatest("nid", "h.nid").alias("x"), F.least("nid", "h.nid").alias("y"),
        F.when(flip, F.col("h.comp")).otherwise(F.col("comp")).alias("cx"),
        F.when(flip, F.col("comp")).otherwise(F.col("h.comp")).alias("cy"),
    ).distinct()


def open_entries(members: DataFrame, turn: int) -> DataFrame:
    """Entries that still hold several components: their size and heads.

    The first head is the smallest class, later ones are drawn by hashes of the class
    alone, so that a class heads all entries it shares with the same others.
    """
    order = lambda h: F.col("nid") if turn == 0 else F.xxhash64("nid", F.lit(turn * 1000 + h))
    count = 1 if turn == 0 else HEADS
    found = members.groupBy("key").agg(
        F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size"),
        *(F.min(F.struct(order(h).alias("o"), "nid", "n", "comp")).alias(f"h{h}") for h in range(count)),
    ).where("c0 < c1")
    return found.select("key", "size", F.array(*(f"h{h}" for h in range(count))).alias("heads"))


def linked_classes(reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``nid, comp`` of every class.

    ``reps`` has ``nid, doc_id, cls, n, bands``; ``texts`` has ``doc_id, text``.
    """
    turns = Turns()
    shared = shared_entries(table_keys(reps))
    members = turns.stored(shared.withColumn("comp", F.col("nid")), "minhash-entries")
    wanted = members.select("nid").distinct().join(reps, "nid").select("nid", "cls", F.col("doc_id").alias("_d"))
    # Every text is read once at most, however often its id repeats, and gives its class.
    ids = wanted.select("_d").distinct()
    found = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi").select("text")
    found = found.mapInArrow(set_maker(k), SETS_SQL).dropDuplicates(["cls"])
    sets = stored(found.join(wanted.select("nid", "cls"), "cls").select("nid", "shingles"), "shingle-sets")
    labels, turn = reps.select("nid", F.col("nid").alias("comp")), 0
    while True:
        if turn > 1:
            members = turns.stored(finer_entries(members, reps), "minhash-entries")
        chosen = turns.stored(open_entries(members, turn), "minhash-heads")
        if chosen.isEmpty():
            turns.discard("minhash-entries")
            return labels
        together = members.join(chosen, "key")
        deepest = F.bit_count("mask") >= DEEP
        limit = F.when(deepest, F.lit(SMALL * 4 ** max(0, turn - DEEP))).otherwise(SMALL)
        small = F.lit(turn > 0) & (F.col("size") <= limit)
        stars = ordered_pairs(together.where(~small).withColumn("h", F.explode("heads")), percent)
        few = together.where(small).select("key", "nid", "n", "comp")
        other = few.select(F.col("key").alias("_k"), F.struct("nid", "n", "comp").alias("h"))
        # Small entries are settled at once, pair by pair.
        both = (F.col("key") == F.col("_k")) & (F.col("nid") > F.col("h.nid"))
        both = both & (F.col("comp") != F.col("h.comp")) & similar_sizes(percent, "n", "h.n")
        all_of_few = ordered_pairs(few.join(other, both), percent)
        pairs = stars if turn == 0 else stars.union(all_of_few).distinct()
        merged = components(verified(pairs, sets, percent))
        moved = merged.select(F.col("id").alias("_id"), "component")
        rest = together.where(~small).where(~F.exists("heads", lambda h: h["nid"] == F.col("nid")))
        members = turns.stored(
            rest.select("key", "mask", "nid", "n", "comp").join(moved, F.col("comp") == F.col("_id"), "left")
            .select("key", "mask", "nid", "n", F.coalesce("component", "comp").alias("comp")), "minhash-entries",
        )
        labels = turns.stored(
            labels.join(moved, F.col("comp") == F.col("_id"), "left")
            .select("nid", F.coalesce("component", "comp").alias("comp")), "minhash-labels",
        )
        turn += 1


def signed_classes(texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``texts`` with ``n`` and ``cls``, and ``cls, comp, doc_id`` per class.

    ``texts`` has ``doc_id, text`` and may have more whole numbers, which the rows keep;
    ``doc_id`` of a class is the smallest of its rows.
    """
    own = [c for c in texts.columns if c != "text"]
    columns = ", ".join([*(f"{c} long" for c in own), SIGNED_SQL])
    signed = stored(texts.mapInArrow(signer(k), columns), "minhash-signatures")
    # Equal sets have equal bands and sizes.
    reps = signed.where("n > 0").groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    reps = stored(reps.withColumn("nid", F.monotonically_increasing_id()), "minhash-classes")
    labelled = reps.select("cls", "nid", "doc_id").join(linked_classes(reps, texts, k, percent), "nid")
    return signed.select(*own, "n", "cls"), labelled.select("cls", "comp", "doc_id")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document.

    Sets of ``k``-word shingles (ASCII lower case) whose intersection is at least
    ``percent`` percent of their union are linked. A text with fewer words is one shingle;
    one without words, or null, has none and is its own component. ``component_id`` is the
    smallest key that links reach; ``kept`` marks the document of that key. Repeated rows
    are linked as any equal texts; where keys repeat, all rows of the kept key are kept; a
    null key is the smallest of no component that has another key, and is kept only if
    all keys of its component are null. Other columns are not read.
    """
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    slim, labelled = signed_classes(texts, k, percent)
    least = labelled.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    answer = labelled.join(least, "comp").select(F.col("cls").alias("_c"), "component_id")
    full = slim.where("n > 0").join(answer, F.col("cls") == F.col("_c")).drop("_c")
    empty = slim.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return full.unionByName(empty).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def without_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """One row of each group of near duplicates, with its own columns.

    Rows are told apart by an id of their own, whatever their keys: of each group, repeated
    rows included, the row of the smallest key stays (null last). A row without words stays.
    """
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("_rid"), F.col(key).cast("long").alias("_key"),
        F.col(text).alias("_text"), F.struct(*(F.col(c) for c in docs.columns if c != text)).alias("_row"),
    ), "near-duplicate-rows")
    texts = rows.select(F.col("_rid").alias("doc_id"), F.col("_key").alias("key"), F.col("_text").alias("text"))
    slim, labelled = signed_classes(texts, k, percent)
    order = F.struct(F.col("key").isNull().alias("last"), "key", "doc_id")
    best = (
        slim.where("n > 0").join(labelled.select(F.col("cls").alias("_c"), "comp"), F.col("cls") == F.col("_c"))
        .groupBy("comp").agg(F.min(order).alias("best")).select(F.col("best.doc_id").alias("_kept"))
    )
    kept = stored(best.union(slim.where("n = 0").select("doc_id")), "near-duplicates-kept")
    return rows.join(kept, F.col("_rid") == F.col("_kept"), "left_semi").select(
        *(F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns)
    )
