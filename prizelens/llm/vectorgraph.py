"""Near-duplicate vectors by search on a robust-pruned flat graph.

Vectors of one label are compared by cosine. Equal vectors are one class, and classes are

1. dealt to overlapping shards: the ``OVERLAP`` nearest of the label's cluster centres
   (fitted on a bounded sample); a shard of many classes falls into blocks by hash;
2. joined to a graph in each block: every class keeps, of its closest ones, those that no
   kept one is clearly closer to (robust pruning), some of a pool drawn from the whole
   block, and gets edges back; parts that stay apart are tied to the block's medoid;
3. the adjacency lists of a class's blocks are united into one flat graph;
4. searched: every class looks in the blocks of its nearest shard, greedily with a beam
   from itself and the closest of a sample of entry points, then outward over everything
   found within the range until nothing new turns up. Only what the search visits is
   compared, in double precision;
5. audited: on a bounded set of queries per label the links found are held against all
   vectors of the label. A label below ``RECALL``, over its links or as the mean over its
   queries, is searched again with more overlap and a wider beam; one that stays below is
   compared in full, chunk by chunk.

A block is bounded, and so is every task; a label, shard or group of near copies of any
size is many blocks. Links are counted where they are found and leave a block only as a
spanning forest, so a large group costs rows in proportion to its members.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prizelens.llm.common import cut, stored
from prizelens.llm.components import components

SAMPLE = 4_096  # vectors per label that centres are fitted on
CENTRES = 512  # per label at most
SHARD_ROWS = 1_000  # classes per centre, before overlap
BLOCK_ROWS = 3_000
OVERLAP, BEAM = 3, 16
DEGREE, POOL, ALPHA = 24, 64, 1.2
FAR_DEGREE, FAR_POOL = 8, 64  # of the pool drawn from the whole block
ENTRIES = 64  # entry points per block, besides its medoid
CHUNK_ROWS = 20_000  # classes compared in full at once
QUERIES_AT_ONCE = 256
AUDIT_QUERIES = 200  # per label
RECALL = 0.999
RETRIES = 2


def matrix(column: pd.Series) -> np.ndarray:
    """Unit vectors in double precision."""
    m = np.array(column.tolist(), np.float64).reshape(len(column), -1)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def fit_centres(rows: pd.DataFrame) -> pd.DataFrame:
    """Spherical k-means on the sample of one label."""
    rows = rows.sort_values("nid")
    v = matrix(rows["embedding"])
    k = int(min(max(1, -(-rows["n_group"].iloc[0] // SHARD_ROWS)), CENTRES, len(v)))
    rng = np.random.default_rng(len(v))
    c = v[rng.choice(len(v), k, replace=False)]
    for _ in range(8 if k > 1 else 0):
        near = (v @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, v)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return pd.DataFrame({
        "label": rows["label"].iloc[0], "dim": rows["dim"].iloc[0], "centre": range(k), "c": list(c),
    })


def shard_chooser(overlap: int):
    def choose(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        """The nearest centres of each vector, nearest first."""
        if not len(rows) or not len(centres):
            return pd.DataFrame({"nid": [], "shard": [], "place": []})
        centres = centres.sort_values("centre")
        c = np.array(centres["c"].tolist())
        o = min(overlap, len(c))
        near = np.argsort(-(matrix(rows["embedding"]) @ c.T), axis=1, kind="stable")[:, :o]
        return pd.DataFrame({
            "nid": np.repeat(rows["nid"].to_numpy(), o),
            "shard": centres["centre"].to_numpy()[near].ravel(),
            "place": np.tile(np.arange(o), len(rows)),
        })

    return choose


def pruned(v: np.ndarray, pool: np.ndarray, sims: np.ndarray, most: int) -> list[int]:
    """Robust pruning: up to ``most`` neighbours out of ``pool`` (closest first)."""
    apart = 1 - sims
    alive, kept = np.ones(len(pool), bool), []
    for i in range(len(pool)):
        if alive[i]:
            kept.append(int(pool[i]))
            if len(kept) == most:
                break
            alive &= ALPHA * (1 - v[pool] @ v[pool[i]]) > apart
    return kept


def medoid(v: np.ndarray) -> int:
    return int((v @ v.mean(0)).argmax())


def tie_parts(lists: list[set[int]], middle: int) -> None:
    """Edges between ``middle`` and a member of every part it does not reach."""
    seen = [False] * len(lists)
    for first in (middle, *range(len(lists))):
        if seen[first]:
            continue
        if first != middle:
            lists[first].add(middle)
            lists[middle].add(first)
        seen[first], left = True, [first]
        while left:
            for j in lists[left.pop()]:
                if not seen[j]:
                    seen[j] = True
                    left.append(j)


def build_graph(rows: pd.DataFrame) -> pd.DataFrame:
    """Adjacency lists of one block."""
    rows = rows.sort_values("nid")
    ids, v = rows["nid"].to_numpy(), matrix(rows["embedding"])
    n = len(v)
    lists: list[set[int]] = [set() for _ in range(n)]
    most = min(POOL, n - 1)
    far = np.random.default_rng(n)
    for start in range(0, n, QUERIES_AT_ONCE):
        sims = v[start : start + QUERIES_AT_ONCE] @ v.T
        for i, row in enumerate(sims):
            row[start + i] = -2
            if most:
                pool = np.argpartition(-row, most - 1)[:most]
                pool = pool[np.lexsort((pool, -row[pool]))]
                wide = np.unique(far.integers(0, n, FAR_POOL))
                wide = wide[wide != start + i]
                wide = wide[np.argsort(-row[wide], kind="stable")]
                near = pruned(v, pool, row[pool], DEGREE) + pruned(v, wide, row[wide], FAR_DEGREE)
                for j in near:
                    lists[start + i].add(j)
                    if len(lists[j]) < 2 * (DEGREE + FAR_DEGREE):
                        lists[j].add(start + i)
    tie_parts(lists, medoid(v))
    return pd.DataFrame({"nid": ids, "near": [ids[sorted(x)].tolist() for x in lists]})


class Block:
    """The united graph on the members of a block; without lists, the members alone."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("nid")
        self.ids, self.v = rows["nid"].to_numpy(), matrix(rows["embedding"])
        self.count = rows["n"].to_numpy()
        if "near" not in rows:
            return
        place = {nid: i for i, nid in enumerate(self.ids.tolist())}
        lists = [[place[x] for x in near if x in place] for near in rows["near"]]
        width = max(1, max(map(len, lists)))
        self.near = np.full((len(lists), width), -1)
        for i, x in enumerate(lists):
            self.near[i, : len(x)] = x
        n = len(lists)
        drawn = np.random.default_rng(n).choice(n, min(ENTRIES, n), replace=False)
        self.entries = np.union1d(drawn, [medoid(self.v)])

    def compared(self, q: np.ndarray, least: float) -> np.ndarray:
        """``within`` by comparing all."""
        return q @ self.v.T >= least

    def within(self, q: np.ndarray, own: np.ndarray, least: float, beam: int) -> np.ndarray:
        """Which members each query finds with a cosine of at least ``least``; ``own`` are
        the ids of the queries, which start from themselves where they are members."""
        k, n = len(q), len(self.v)
        seen, found = np.zeros((k, n), bool), np.zeros((k, n), bool)
        rows = np.arange(k)
        at = np.minimum(np.searchsorted(self.ids, own), n - 1)
        starts = np.concatenate([np.tile(self.entries, (k, 1)), at[:, None]], 1)
        near = np.einsum("ij,ikj->ik", q, self.v[starts])
        near[:, -1][(self.ids[at] != own) | np.isin(at, self.entries)] = -np.inf
        who, col = np.nonzero(near > -np.inf)
        seen[who, starts[who, col]] = True
        found[who, starts[who, col]] = near[who, col] >= least
        best = np.argsort(-near, axis=1, kind="stable")[:, :beam]
        ids, sims = np.full((k, beam), -1), np.full((k, beam), -np.inf)
        ids[:, : best.shape[1]] = starts[rows[:, None], best]
        sims[:, : best.shape[1]] = near[rows[:, None], best]
        ids[sims == -np.inf] = -1
        done = np.zeros((k, beam), bool)
        while True:
            open_sims = np.where(done | (ids < 0), -np.inf, sims)
            pick = open_sims.argmax(1)
            go = np.flatnonzero(open_sims[rows, pick] > -np.inf)
            if not len(go):
                break
            done[go, pick[go]] = True
            new = self.near[ids[go, pick[go]]]
            fresh = (new >= 0) & ~seen[go[:, None], new]
            at, col = np.nonzero(fresh)
            who, what = go[at], new[at, col]
            seen[who, what] = True
            value = np.einsum("ij,ij->i", q[who], self.v[what])
            found[who, what] = value >= least
            wide = np.full(new.shape, -np.inf)
            wide[at, col] = value
            all_ids = np.concatenate([ids[go], np.where(fresh, new, -1)], 1)
            all_sims = np.concatenate([sims[go], wide], 1)
            all_done = np.concatenate([done[go], np.zeros(new.shape, bool)], 1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            pick_rows = np.arange(len(go))[:, None]
            ids[go], sims[go], done[go] = all_ids[pick_rows, best], all_sims[pick_rows, best], all_done[pick_rows, best]
        edge = found.copy()
        while True:  # range expansion: on from everything within the range
            who, node = np.nonzero(edge)
            if not len(who):
                return found
            new = self.near[node]
            who = np.repeat(who, new.shape[1])[new.ravel() >= 0]
            what = new.ravel()[new.ravel() >= 0]
            mark = np.zeros((k, n), bool)
            mark[who, what] = True
            mark &= ~seen
            seen |= mark
            edge[:] = False
            who, what = np.nonzero(mark)
            for start in range(0, len(who), 100_000):
                a, b = who[start : start + 100_000], what[start : start + 100_000]
                edge[a, b] = np.einsum("ij,ij->i", q[a], self.v[b]) >= least
            found |= edge


FOUND_SQL = "nid long, links long, target long"


def searcher(least: float, beam: int | None):
    """Search with a beam, or without one by comparing all."""

    def search(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        """Per query: the number of vectors found, and links that span what is linked."""
        if not len(queries) or not len(members):
            return pd.DataFrame({"nid": [], "links": [], "target": []})
        block = Block(members)
        queries = queries.sort_values("nid")
        ids, v = queries["nid"].to_numpy(), matrix(queries["embedding"])
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for start in range(0, len(ids), QUERIES_AT_ONCE):
            part = ids[start : start + QUERIES_AT_ONCE]
            some = v[start : start + QUERIES_AT_ONCE]
            found = block.compared(some, least) if beam is None else block.within(some, part, least, beam)
            found &= block.ids[None, :] != part[:, None]
            for nid, hit in zip(part.tolist(), found):
                hit = np.flatnonzero(hit)
                out.append((nid, int(block.count[hit].sum()), None))
                for other in block.ids[hit].tolist():
                    a, b = top(nid), top(other)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((nid, 0, other))
        frame = pd.DataFrame(out, columns=["nid", "links", "target"])
        return frame.astype({"target": "Int64"})

    return search


def usable(embedding: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(
        ~F.exists(embedding, bad) & F.exists(embedding, lambda x: x != 0), F.lit(False)
    )


def found_links(classes: DataFrame, least: float, overlap: int, beam: int) -> DataFrame:
    """``nid, links, target``: counts and spanning links of every class (steps 1 to 4).

    ``classes`` has ``nid, label, dim, embedding, n``.
    """
    groups = classes.groupBy("label", "dim").agg(F.count("*").alias("n_group"))
    groups = groups.withColumnsRenamed({"label": "_l", "dim": "_d"})
    mine = (F.col("label") == F.col("_l")) & (F.col("dim") == F.col("_d"))
    sized = classes.join(groups, mine).drop("_l", "_d")
    part = F.pmod(F.xxhash64("nid", F.lit(3)), F.lit(1_000_000)) * F.col("n_group")
    centres = cut(
        sized.where(part < SAMPLE * 1_000_000).select("nid", "label", "dim", "embedding", "n_group")
        .groupBy("label", "dim").applyInPandas(fit_centres, "label long, dim int, centre int, c array<double>")
    )
    chunks = F.ceil(F.col("n_group") / 20_000).cast("int")
    rows = sized.select("nid", "label", "dim", "embedding", F.pmod(F.xxhash64("nid"), chunks).cast("int").alias("chunk"))
    spread = centres.join(groups, mine).select(
        "label", "dim", "centre", "c", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk")
    )
    dealt = stored(
        rows.groupBy("label", "dim", "chunk")
        .cogroup(spread.groupBy("label", "dim", "chunk"))
        .applyInPandas(shard_chooser(overlap), "nid long, shard int, place int"), "vector-shards",
    )
    member = stored(dealt.join(classes, "nid"), "vector-members")
    shards = member.groupBy("label", "dim", "shard").agg(F.count("*").alias("n_shard")).select(
        F.col("label").alias("_l"), F.col("dim").alias("_d"), F.col("shard").alias("_s"),
        F.ceil(F.col("n_shard") / BLOCK_ROWS).cast("int").alias("n_blocks"),
    )
    keys = ["label", "dim", "shard", "block"]
    placed = member.join(shards, mine & (F.col("shard") == F.col("_s")))
    blocks = placed.withColumn("block", F.pmod(F.xxhash64("nid", F.lit(5)), F.col("n_blocks")).cast("int"))
    lists = blocks.select(*keys, "nid", "embedding").groupBy(*keys).applyInPandas(
        build_graph, "nid long, near array<long>"
    )
    flat = stored(
        lists.groupBy("nid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")),
        "vector-graph",
    )
    nodes = blocks.select(*keys, "nid", "embedding", "n").join(flat, "nid")
    queries = stored(placed.where("place = 0").select(
        "label", "dim", "shard", "nid", "embedding",
        F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"),
    ), "vector-queries")
    return stored(
        queries.groupBy(*keys).cogroup(nodes.groupBy(*keys)).applyInPandas(searcher(least, beam), FOUND_SQL),
        "vector-links",
    )


def true_counter(least: float):
    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Links of the audit's queries to one chunk of vectors, by comparing all."""
        if not len(left) or not len(right):
            return pd.DataFrame({"nid": [], "links": []})
        q, v = matrix(left["embedding"]), matrix(right["embedding"])
        hit = (q @ v.T >= least) & (left["nid"].to_numpy()[:, None] != right["nid"].to_numpy()[None, :])
        return pd.DataFrame({"nid": left["nid"], "links": hit @ right["n"].to_numpy()})

    return count


def in_chunks(classes: DataFrame) -> DataFrame:
    """``classes`` with ``n_group``, their ``chunks`` and the own ``chunk``."""
    groups = classes.groupBy("label", "dim").agg(F.count("*").alias("n_group"))
    sized = classes.join(groups, ["label", "dim"]).withColumn(
        "chunks", F.ceil(F.col("n_group") / CHUNK_ROWS).cast("int")
    )
    return sized.withColumn("chunk", F.pmod(F.xxhash64("nid"), F.col("chunks")).cast("int"))


def all_links(classes: DataFrame, least: float) -> DataFrame:
    """What ``found_links`` gives, by comparing all vectors of a label."""
    rows = in_chunks(classes)
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    asked = stored(
        rows.select("label", "dim", F.col("chunk").alias("mine"), every.alias("chunk"), "nid", "embedding"),
        "vector-queries",
    )
    there = rows.select("label", "dim", every.alias("mine"), "chunk", "nid", "embedding", "n")
    keys = ["label", "dim", "mine", "chunk"]
    return stored(
        asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(searcher(least, None), FOUND_SQL),
        "vector-links",
    )


def failed_labels(classes: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """``label, dim`` where up to about ``AUDIT_QUERIES`` classes miss too many links: of
    all links of the label, or in the mean of its queries."""
    sized = in_chunks(classes)
    rows = sized.select("label", "dim", "nid", "n", "embedding", "chunk")
    drawn = F.pmod(F.xxhash64("nid", F.lit(9)), F.lit(1_000_000)) * F.col("n_group") < AUDIT_QUERIES * 1_000_000
    asked = stored(sized.where(drawn).select(
        "label", "dim", "nid", "embedding", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    ), "vector-audit")
    keys = ["label", "dim", "chunk"]
    there = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(
        true_counter(least), "nid long, links long"
    ).groupBy("nid").agg(F.sum("links").alias("there")).where("there > 0")
    got = links.groupBy("nid").agg(F.sum("links").alias("got"))
    judged = there.join(got, "nid", "left").join(asked.select("nid", "label", "dim").distinct(), "nid")
    hit = F.least(F.coalesce("got", F.lit(0)), "there")
    return judged.groupBy("label", "dim").agg(
        F.sum(hit).alias("found"), F.sum("there").alias("there"), F.avg(hit / F.col("there")).alias("mean")
    ).where((F.col("found") < RECALL * F.col("there")) | (F.col("mean") < RECALL)).select("label", "dim")


def linked_vectors(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
    least: float = 0.98,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per vector.

    Vectors are linked if their labels are equal and not null, their lengths are equal and
    their cosine is at least ``least``. Null, zero or not finite vectors and those without
    label link with nothing and are their own component. ``component_id`` is the smallest
    key that links reach; repeated rows link with each other; where keys repeat, all rows
    of the kept key are kept; a null key is kept only where all keys of its component are
    null. Other columns are not read; an empty table gives an empty result.
    """
    slim = vectors.select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
        F.col(embedding).alias("embedding"),
    ).withColumns({
        "ok": F.col("label").isNotNull() & usable(F.col("embedding")),
        "h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(77), "embedding", "label"),
    })
    classes = stored(
        slim.where("ok").groupBy("h1", "h2").agg(
            F.count("*").alias("n"), F.min("vec_id").alias("vec_id"),
            F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        ).withColumns({"nid": F.monotonically_increasing_id(), "dim": F.size("embedding")}),
        "vector-classes",
    )
    plain = classes.select("nid", "label", "dim", "embedding", "n")
    tries, left = [], plain
    for attempt in range(RETRIES + 1):
        tries.append(found_links(left, least, OVERLAP << attempt, BEAM << attempt))
        failed = stored(failed_labels(left, tries[-1], least), "vector-failed")
        left = left.join(failed, ["label", "dim"], "left_semi")
        if failed.isEmpty():
            break
    else:
        tries.append(all_links(left, least))
    # What any try found is there, so links add up and the largest count is the best.
    links = reduce(DataFrame.union, tries)
    comps = components(links.where("target is not null").select(F.col("nid").alias("a"), F.col("target").alias("b")))
    counts = reduce(DataFrame.union, (x.groupBy("nid").agg(F.sum("links").alias("others")) for x in tries))
    counts = counts.groupBy("nid").agg(F.max("others").alias("others"))
    labelled = (
        classes.select("nid", "h1", "h2", "vec_id", "n").join(counts, "nid", "left")
        .join(comps.withColumnRenamed("id", "_n"), F.col("nid") == F.col("_n"), "left")
        .select("h1", "h2", "vec_id", F.coalesce("component", "nid").alias("comp"),
                (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    )
    lowest = labelled.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    answer = labelled.join(lowest, "comp").select(
        F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "n_links", "component_id"
    )
    good = slim.where("ok").select("vec_id", "h1", "h2").join(
        answer, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    ).select("vec_id", "n_links", "component_id")
    rest = slim.where(~F.col("ok")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
