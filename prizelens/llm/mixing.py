"""Mix sources to target weights by entropy balancing.

Each source has a target number of words. Among all document rates between 0 and ``cap``
that meet the targets, the mix takes those closest to one in entropy, where changing a
document's rate costs in proportion to one average document plus its own words:

    minimize   sum_i v_i (r_i log r_i - r_i),      v_i = mean size of the source + size_i
    subject to sum_{i in s} size_i r_i = target_s,   0 <= r_i <= cap

The solution is an exponential tilt, ``r_i = min(cap, exp(lambda_s size_i / v_i))``. The
convex dual has one unknown per source, found by Newton steps kept inside a bracket; each
step is one distributed aggregate over all documents, folded into a histogram of sizes
before. Rates become whole copies by carrying the rounding error, in words, from large
documents to small ones within blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prizelens.llm.common import cut, stored
from prizelens.operators.windows import global_rank

CAP = 2  # copies of a document at most
BLOCK_ROWS = 2_000  # documents that share a rounding error, on average
SEED = 17
TOLERANCE = 1e-7
MAX_STEPS = 60
UNIT = 1 << 30  # sums of rates are whole numbers of this part, so their order is free


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = CAP
) -> DataFrame:
    """``stratum, n_docs, source_size`` with ``target``.

    Sources in code point order, null last, take ``weights`` in turn; targets are
    ``share`` of all words by weight, stop at ``cap`` times the source's words, and the
    excess is dealt again by weight until none is above. Sources without words get 0.
    """
    ranked = global_rank(sizes, [F.col("stratum").asc_nulls_last()], "_pos")
    turn = F.element_at(
        F.array(*(F.lit(w) for w in weights)), ((F.col("_pos") - 1) % len(weights) + 1).cast("int")
    )
    ranked = cut(ranked.withColumn("weight", turn.cast("long")).drop("_pos"))
    most = F.col("source_size") * cap
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, n_full = 0.0, -1
    while True:
        full = most < level * F.col("weight")
        row = ranked.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.coalesce(F.sum(F.when(full, most)), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if row.n == n_full or not row.weight:
            break
        n_full, level = row.n, (share * total - row.words) / row.weight
    return ranked.withColumn("target", F.least(most.cast("double"), level * F.col("weight"))).drop("weight")


def tilts(hist: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """``stratum, tilt``: the dual solution of each source by safeguarded Newton steps.

    ``hist`` counts documents (``n``) by ``stratum`` and ``size``. Sources at their cap
    or without words need no solution and are left out.
    """
    goal = targets.where("source_size > 0").select(
        "stratum", "target", "source_size",
        (F.col("source_size") / F.col("n_docs")).alias("mean"),
    ).where((F.col("target") > 0) & (F.col("target") < cap * F.col("source_size")))
    # One row per source each turn: stored, so that these are sent to the rows and not the
    # rows, of which there may be as many as documents, to them.
    state = stored(goal.withColumns({
        "tilt": F.log(F.col("target") / F.col("source_size")) * 2,
        "low": F.lit(None).cast("double"),
        "high": F.lit(None).cast("double"),
    }), "mix-tilts")
    rows = hist.where("size > 0").withColumnRenamed("stratum", "_s")
    for _ in range(MAX_STEPS):
        x = F.col("size") / (F.col("mean") + F.col("size"))
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        whole = lambda c: F.sum(F.round(c * UNIT).cast("decimal(20,0)") * F.col("size") * F.col("n"))
        sums = rows.join(state, F.col("_s").eqNullSafe(F.col("stratum"))).groupBy(
            "stratum", "target", "source_size", "mean", "tilt", "low", "high"
        ).agg(
            (whole(F.least(rate, F.lit(float(cap)))).cast("double") / UNIT).alias("f"),
            (whole(F.when(rate < cap, rate * x).otherwise(0.0)).cast("double") / UNIT).alias("g"),
        )
        sums = stored(sums, "mix-tilts")
        worst = sums.agg(F.max(F.abs(F.col("f") - F.col("target")) / F.col("target"))).first()[0]
        if worst is None or worst < TOLERANCE:
            return sums.select("stratum", "tilt")
        short = F.col("f") < F.col("target")
        low = F.when(short, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(short, F.col("high")).otherwise(F.col("tilt"))
        step = (F.col("target") - F.col("f")) / F.when(F.col("g") > 0, F.col("g"))
        newton = F.col("tilt") + F.coalesce(
            F.greatest(F.least(step, F.lit(8.0)), F.lit(-8.0)), F.when(short, 8.0).otherwise(-8.0)
        )
        inside = (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
        state = sums.select(
            "stratum", "target", "source_size", "mean",
            F.when(inside, newton).otherwise((low + high) / 2).alias("tilt"),
            low.alias("low"), high.alias("high"),
        )
    return state.select("stratum", "tilt")


def round_rates(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for the documents of one block; the error goes from large to small."""
    rows = rows.sort_values(["size", "_order", "id"], ascending=[False, True, True], kind="stable")
    copies, owed = [], 0.0
    for size, rate, m in zip(rows["size"], rows["rate"], rows["n"]):
        whole = int(rate)
        owed += (rate - whole) * size * m
        extra = int(rate > whole and 2 * owed >= size * m)
        owed -= extra * size * m
        copies.append(whole + extra)
    return rows[["id", "stratum", "size", "n", "rate"]].assign(copies=pd.Series(copies, rows.index, "int64"))


def mix(
    docs: DataFrame,
    key: str,
    stratum: str,
    size: Column,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: int = CAP,
) -> tuple[DataFrame, DataFrame]:
    """Copies of every document and the targets of the sources.

    The first table has one row per distinct (``id``, ``stratum``, ``size``) with the
    number of such rows ``n``, ``rate`` and ``copies`` (each of the rows is taken so many
    times); the second ``stratum, n_docs, source_size, target``. Null sizes count as 0
    and documents without words are taken as often as their source's tilt has it, which
    moves no words; null sources are a source of their own; repeated rows get the same
    copies; an empty table gives two empty tables. Other columns are not read.
    """
    slim = docs.select(
        F.col(key).alias("id"), F.col(stratum).alias("stratum"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
    )
    units = stored(slim.groupBy("id", "stratum", "size").agg(F.count("*").alias("n")), "mix-units")
    hist = cut(units.groupBy("stratum", "size").agg(F.sum("n").alias("n")))
    sizes = hist.groupBy("stratum").agg(
        F.sum("n").alias("n_docs"), F.sum(F.col("size") * F.col("n")).alias("source_size")
    )
    targets = cut(source_targets(sizes, weights, share, cap))
    found = targets.join(
        tilts(hist, targets, cap).withColumnRenamed("stratum", "_t"),
        F.col("stratum").eqNullSafe(F.col("_t")), "left",
    ).select(
        F.col("stratum").alias("_s"), "n_docs", "tilt",
        (F.col("source_size") / F.col("n_docs")).alias("mean"),
        F.when(F.col("target") >= cap * F.col("source_size"), float(cap)).otherwise(0.0).alias("flat"),
    )
    found = stored(found, "mix-rates")
    x = F.col("size") / (F.col("mean") + F.col("size"))
    rate = F.least(F.exp(F.least(F.col("tilt") * x, F.lit(50.0))), F.lit(float(cap)))
    draw = F.xxhash64(F.col("id"), F.lit(SEED))
    blocks = F.ceil(F.col("n_docs") / BLOCK_ROWS).cast("long")
    rated = units.join(found, F.col("stratum").eqNullSafe(F.col("_s"))).select(
        "id", "stratum", "size", "n",
        F.round(F.coalesce(rate, F.col("flat")), 9).alias("rate"),
        draw.alias("_order"),
        F.pmod(F.xxhash64(draw, F.lit(SEED + 1)), blocks).alias("_block"),
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema)
    copies = rated.groupBy("stratum", "_block").applyInPandas(
        round_rates, f"{kinds}, rate double, copies long".replace("bigint", "long")
    )
    return copies, targets


def with_copies(docs: DataFrame, copies: DataFrame, key: str, stratum: str, size: Column) -> DataFrame:
    """``_row``, the whole row of every document that ``copies`` of ``mix`` names, with those
    columns. Repeated rows meet their one entry in a join, so no task makes them all."""
    packed = docs.select(
        F.struct("*").alias("_row"), F.col(key).alias("_k"), F.col(stratum).alias("_s"),
        F.coalesce(size, F.lit(0)).cast("long").alias("_z"),
    )
    same = (
        F.col("_k").eqNullSafe(F.col("id"))
        & F.col("_s").eqNullSafe(F.col("stratum"))
        & (F.col("_z") == F.col("size"))
    )
    return packed.join(copies, same).drop("_k", "_s", "_z")


def mixed_documents(docs: DataFrame, key: str, stratum: str, size: Column, **options) -> DataFrame:
    """The mix itself: every document as often as its copies say, columns as they are."""
    copies, _ = mix(docs, key, stratum, size, **options)
    copies = stored(copies.where("copies > 0").select("id", "stratum", "size", "copies"), "copies")
    return (
        with_copies(docs, copies, key, stratum, size)
        .select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
        .select("_row.*")
    )
