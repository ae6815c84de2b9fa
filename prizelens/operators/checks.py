"""Check suites and table comparisons. Each returns a small DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prizelens.functions.calendar import quarter_label
from prizelens.operators.joins import set_difference_sizes
from prizelens.session import ensure_checkpoint_dir

SAMPLE_SIZE = 20


def run_checks(
    df: DataFrame, checks: dict[str, Column], id_col: str, samples: int = SAMPLE_SIZE
) -> DataFrame:
    """One row per check: passed, bad_rows and the first bad ids.

    ``checks`` maps a name to its fail condition. Only failing rows leave the
    scan, reduced to (check, id) counts; ids are limited per map task, so a check
    that fails everywhere never gathers its ids.
    """
    hits = F.array_compact(
        F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])
    )
    failing = (
        df.select(F.col(id_col).alias("_id"), F.explode(hits).alias("check"))
        .groupBy("check", "_id")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    totals = failing.groupBy("check").agg(F.sum("_n").alias("bad_rows"))
    # Naming the count in the order lets both branches reuse one shuffle of
    # ``failing``; an id occurs once per check, so it decides nothing.
    first_ids = W.partitionBy("check").orderBy("_id", "_n")
    firsts = (
        failing.withColumn("_rank", F.row_number().over(first_ids))
        .where(F.col("_rank") <= samples)
        .groupBy("check")
        .agg(F.array_sort(F.collect_list("_id")).alias("sample_ids"))
    )
    names = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(name) for name in checks])).alias("check")
    )
    return (
        names.join(totals, "check", "left")
        .join(firsts, "check", "left")
        .select(
            "check",
            F.col("bad_rows").isNull().alias("passed"),
            F.coalesce("bad_rows", F.lit(0)).cast("bigint").alias("bad_rows"),
            F.coalesce(
                F.transform("sample_ids", lambda i: i.cast("string")),
                F.array().cast("array<string>"),
            ).alias("sample_ids"),
        )
    )


def require_passed(results: DataFrame) -> DataFrame:
    """Raise when a check failed; the message names the failed checks."""
    failed = [r["check"] for r in results.where(~F.col("passed")).collect()]
    if failed:
        raise ValueError(f"failed checks: {sorted(failed)}")
    return results


def checked_table(df: DataFrame, checks: dict[str, Column], id_col: str) -> DataFrame:
    """``df``, worked out once, stored and proven: the checks and the caller read the same
    rows. Raises when a check fails."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint()
    require_passed(run_checks(kept, checks, id_col))
    return kept


def numeric_checks(cols: Sequence[str]) -> dict[str, Column]:
    """Fail conditions: not a number, missing, negative (per column)."""
    checks: dict[str, Column] = {}
    for c in cols:
        value = F.col(c).cast("string").try_cast("double")
        checks[f"{c}_missing"] = F.col(c).isNull()
        checks[f"{c}_not_numeric"] = F.col(c).isNotNull() & value.isNull()
        checks[f"{c}_negative"] = value < 0
    return checks


def check_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows with a null or empty key, repeated keys, verdict."""
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull() | (F.col(k).cast("string") == "")
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(
            F.sum("_n").alias("n_rows"),
            F.coalesce(F.sum(F.when(empty, F.col("_n"))), F.lit(0)).alias("empty_key_rows"),
            F.count_if(F.col("_n") > 1).alias("repeated_keys"),
        )
        .withColumn(
            "passed", (F.col("empty_key_rows") == 0) & (F.col("repeated_keys") == 0)
        )
    )


def check_parent(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child keys without a parent, with the number of orphan rows."""
    return (
        child.groupBy(key)
        .agg(F.count(F.lit(1)).alias("orphan_rows"))
        .join(parent.select(key), key, "left_anti")
    )


def check_inherited(
    child: DataFrame, parent: DataFrame, key: str, cols: Sequence[str]
) -> DataFrame:
    """Per inherited column: child rows that differ from their parent."""
    other = parent.select(key, *[F.col(c).alias(f"_p_{c}") for c in cols])
    joined = child.join(other, key, "left")
    wide = joined.agg(
        *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_p_{c}"))).alias(c) for c in cols]
    )
    return wide.unpivot([], list(cols), "column_name", "differing_rows").withColumn(
        "passed", F.col("differing_rows") == 0
    )


def check_calendar(df: DataFrame, day: str) -> dict[str, Column]:
    """Fail conditions for stored year and quarter against the date."""
    d = F.col(day)
    return {
        "year_differs": ~F.col("year").eqNullSafe(F.year(d)),
        "quarter_differs": ~F.col("quarter").eqNullSafe(quarter_label(d)),
    }


def check_mapping(
    df: DataFrame, code: str, value: str, mapping: dict[str, str]
) -> DataFrame:
    """Rows per (code, value) that break a fixed code-to-value map."""
    expected = F.lit(None).cast("string")
    for k, v in mapping.items():
        expected = F.when(F.col(code) == k, F.lit(v)).otherwise(expected)
    return (
        df.groupBy(code, value)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("expected", expected)
        .withColumn("consistent", F.col(value).eqNullSafe(F.col("expected")))
    )


def check_conserved(
    before: DataFrame, after: DataFrame, totals: dict[str, tuple[Column, Column]]
) -> DataFrame:
    """Per measure: total before, total after, verdict.

    ``totals`` maps a name to (aggregate on ``before``, aggregate on ``after``).
    """
    names = list(totals)

    def long(df: DataFrame, i: int, out: str) -> DataFrame:
        wide = df.agg(*[totals[n][i].cast("bigint").alias(n) for n in names])
        return wide.unpivot([], names, "measure", out)

    return (
        long(before, 0, "total_before")
        .join(long(after, 1, "total_after"), "measure")
        .withColumn("conserved", F.expr("total_before <=> total_after"))
    )


def check_equal(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: rows (with repeats) found only on one side. Order does not count."""
    tagged = a.select(*cols, F.lit(1).alias("_d")).unionByName(
        b.select(*cols, F.lit(-1).alias("_d"))
    )
    return (
        tagged.groupBy(*cols)
        .agg(F.sum("_d").alias("_d"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0)).alias(
                "only_left"
            ),
            F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))), F.lit(0)).alias(
                "only_right"
            ),
        )
        .withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))
    )


def check_close(
    a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str], tol: float
) -> DataFrame:
    """Per column: compared rows and rows further apart than ``tol``; null equals null."""
    keys = list(keys)
    left = a.select(*keys, *cols, F.lit(True).alias("_in_a"))
    right = b.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.col(c).alias(f"_b_{c}") for c in cols],
        F.lit(True).alias("_in_b"),
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = left.join(right, condition, "full")
    present = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    wide = joined.agg(
        *[
            F.count_if(
                ~(
                    present
                    & (
                        F.col(c).eqNullSafe(F.col(f"_b_{c}"))
                        | F.coalesce(
                            F.abs(F.col(c) - F.col(f"_b_{c}")) <= tol, F.lit(False)
                        )
                    )
                )
            ).alias(c)
            for c in cols
        ]
    )
    return wide.unpivot([], list(cols), "column_name", "bad_rows").withColumn(
        "passed", F.col("bad_rows") == 0
    )


def compare_counts(
    actual: DataFrame, expected: DataFrame, key: str = "metric", value: str = "value"
) -> DataFrame:
    """Metric by metric over the union of names: actual, expected, difference, verdict."""
    a = actual.select(key, F.col(value).alias("actual"))
    e = expected.select(key, F.col(value).alias("expected"))
    both = a.join(e, key, "full").na.fill(0, subset=["actual", "expected"])
    return both.withColumns(
        {
            "difference": F.col("actual") - F.col("expected"),
            "verdict": F.when(
                F.col("actual") == F.col("expected"), F.lit("match")
            ).otherwise(F.lit("mismatch")),
        }
    )


def compare_reference(
    df: DataFrame,
    reference: DataFrame,
    key: str,
    numbers: Sequence[str],
    texts: Sequence[str],
    tol: float = 1e-6,
) -> DataFrame:
    """Per key: names of the fields that differ from the reference values.

    A key that only one side has is not accepted; the difference says which lacks it.
    """
    ref = reference.select(
        F.col(key).alias("_key"),
        F.lit(True).alias("_in_reference"),
        *[F.col(c).alias(f"_r_{c}") for c in [*numbers, *texts]],
    )
    joined = df.withColumn("_in_data", F.lit(True)).join(
        ref, F.col(key).eqNullSafe(F.col("_key")), "full_outer"
    )
    diffs = [
        F.when(
            ~F.coalesce(F.abs(F.col(c) - F.col(f"_r_{c}")) <= tol, F.lit(False)),
            F.lit(c),
        )
        for c in numbers
    ] + [F.when(~F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.lit(c)) for c in texts]
    return joined.select(
        F.coalesce(key, "_key").alias(key),
        F.when(F.col("_in_data").isNull(), F.lit("missing_in_data"))
        .when(F.col("_in_reference").isNull(), F.lit("missing_in_reference"))
        .otherwise(F.array_join(F.array_compact(F.array(*diffs)), " | "))
        .alias("differing_fields"),
    ).withColumn("accepted", F.col("differing_fields") == "")


def partition_check(
    everything: DataFrame, parts: dict[str, DataFrame], key: str
) -> DataFrame:
    """Keys that are not in exactly one part (or unknown to the input)."""
    tagged = everything.select(
        key, F.lit(1).alias("_known"), F.lit(0).alias("_part")
    )
    for part in parts.values():
        tagged = tagged.unionByName(
            part.select(key, F.lit(0).alias("_known"), F.lit(1).alias("_part"))
        )
    return (
        tagged.groupBy(key)
        .agg(F.sum("_known").alias("in_input"), F.sum("_part").alias("in_parts"))
        .where("in_input <> 1 OR in_parts <> 1")
    )


def check_disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: number of keys on both sides."""
    return (
        a.select(key)
        .distinct()
        .join(b.select(key), key, "left_semi")
        .agg(F.count(F.lit(1)).alias("shared_keys"))
        .withColumn("disjoint", F.col("shared_keys") == 0)
    )


def check_same_set(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return set_difference_sizes(a, b, list(key))


def check_min_rows(df: DataFrame, n: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumns(
        {"minimum": F.lit(n).cast("bigint"), "met": F.col("n_rows") >= n}
    )


def review_queue(log: DataFrame, by: str, status: str, statuses: Sequence[str]):
    """Per family: rows per status and the number needing review."""
    return log.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(status) == s).alias(s) for s in statuses],
    )

