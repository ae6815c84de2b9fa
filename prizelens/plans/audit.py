"""The audit of a cleaned log: every rule that its tables must keep, as one table of checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prizelens.functions.money import prize_status
from prizelens.functions.text import name_keys
from prizelens.operators.checks import check_calendar, check_key, run_checks
from prizelens.operators.joins import union_all
from prizelens.operators.rules import flag_duplicates
from prizelens.plans.cleaning import ACCEPTED, CleanLog

SOURCE = "earnings:"
INHERITED = ("game_slug", "game_family", "game_version", "start_date")


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumn("check", F.concat(F.lit(prefix), "check"))


def _is_false(condition: Column) -> Column:
    """A null condition counts as broken."""
    return ~F.coalesce(condition, F.lit(False))


def _key_check(df: DataFrame, key: str, name: str) -> DataFrame:
    found = check_key(df, [key])
    return found.select(
        F.lit(name).alias("check"), "passed",
        F.coalesce(F.col("empty_key_rows") + F.col("repeated_keys"), F.lit(0)).cast("bigint").alias("bad_rows"),
        F.array().cast("array<string>").alias("sample_ids"),
    )


def _own_rules(slugs: Sequence[str], low: str, high: str) -> dict[str, Column]:
    """Rules on a row of parents or children alone."""
    inside = F.col("start_date").between(F.lit(low).cast("date"), F.lit(high).cast("date"))
    return {
        "id_without_source": _is_false(F.col("tournament_id").rlike(f"^{SOURCE}\\d+$")),
        "game_out_of_scope": _is_false(F.col("game_slug").isin(*slugs)),
        "start_date_out_of_scope": _is_false(inside),
    }


def _by_name(children: DataFrame) -> DataFrame:
    """Children with their folded name, and whether it repeats within the parent."""
    keyed = children.withColumn("_name", F.get(name_keys(F.array("team_name")), F.lit(0)))
    return flag_duplicates(keyed, ["tournament_id", "_name"], "_twice")


def _child_rules() -> dict[str, Column]:
    ambiguous = F.col("identity_status") == "ambiguous_source_id"
    inherited = F.lit(True)
    for c in INHERITED:
        inherited = inherited & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    same_status = F.col("validation_status").eqNullSafe(F.col("_p_crawler_status"))
    return {
        "ambiguous_id_kept": ambiguous & (
            F.col("source_team_id").isNotNull() | F.col("source_team_id_raw").isNull()
            | (F.col("key_basis") != "tournament_and_team_name")
        ),
        "name_empty_or_repeated": F.col("team_name").isNull() | (F.trim("team_name") == "") | F.col("_twice"),
        "status_not_accepted": _is_false(F.col("validation_status").isin(*ACCEPTED)),
        "money_invalid": _is_false(F.col("prize_cents") >= 0),
        "parent_missing": F.col("_p_crawler_status").isNull(),
        "differs_from_parent": ~(inherited & same_status & F.coalesce("_p_eligible", F.lit(False))),
    }


def _totals(out: CleanLog, tolerance: int) -> DataFrame:
    """Parents with the totals of their children: eligible ones have some, and they add up."""
    sums = out.children.groupBy("tournament_id").agg(
        F.sum("prize_cents").alias("_sum"),
        F.min("validation_status").alias("_low"), F.max("validation_status").alias("_high"),
        F.min("diff_cents").alias("_least"), F.max("diff_cents").alias("_most"),
    )
    rows = out.parents.select("tournament_id", "pool_cents", "eligible", "crawler_status").join(
        sums, "tournament_id", "full"
    )
    diff = F.col("_sum") - F.col("pool_cents")
    sound = (
        (F.col("_least") == diff) & (F.col("_most") == diff) & (F.col("_low") == F.col("_high"))
        & (F.col("_low") == prize_status(diff, tolerance)) & (F.col("_low") == F.col("crawler_status"))
    )
    return run_checks(rows, {
        "totals: eligible_without_children": F.coalesce("eligible", F.lit(False)) != F.col("_sum").isNotNull(),
        "totals: sum_or_status_differs": F.col("_sum").isNotNull() & _is_false(sound),
    }, "tournament_id")


def _places(log: DataFrame, out: CleanLog) -> DataFrame:
    """Where each source id of the log went: exactly one of clean, diverted and blocked."""
    def tagged(df: DataFrame, name: str, key: str = "tournament_id") -> DataFrame:
        bare = F.regexp_replace(F.col(key), f"^{SOURCE}", "")
        return df.select(bare.alias("tournament_id"), F.lit(name).alias("place"))

    q = out.quarantine
    rows = union_all(
        tagged(log, "raw"), tagged(out.parents, "clean"), tagged(out.children, "children"),
        tagged(out.out_of_scope, "diverted"),
        tagged(q.where(F.col("affected_table") == "both"), "blocked"),
        tagged(q.where(F.col("reason") == "prize_allocation_pending_review"), "review"),
    )
    by_id = rows.groupBy("tournament_id").agg(*[
        F.max((F.col("place") == p).cast("int")).alias(f"_{p}")
        for p in ("raw", "clean", "children", "diverted", "blocked", "review")
    ])
    return run_checks(by_id, {
        "places: not_in_exactly_one": (F.col("_clean") + F.col("_diverted") + F.col("_blocked")) != F.col("_raw"),
        "places: blocked_but_clean": (F.col("_blocked") + F.col("_clean")) == 2,
        "places: review_but_children": (F.col("_review") + F.col("_children")) == 2,
    }, "tournament_id")


def audit_clean_log(
    log: DataFrame, out: CleanLog, slugs: Sequence[str], low: str, high: str,
    tolerance: int = 2, minimum_children: int = 0,
) -> DataFrame:
    """``check, passed, bad_rows, sample_ids`` over the tables of a cleaned log.

    ``out`` is read several times: give stored tables. Its parents have year and quarter.
    Group rules are aggregates by key or joins on it; no rule gathers a parent's rows.
    """
    dates = {**check_calendar(out.parents, "start_date"), "range_invalid": _is_false(F.col("start_date") <= F.col("end_date"))}
    money = {"money_invalid": _is_false(F.col("pool_cents") >= 0)}
    own = _own_rules(slugs, low, high)
    parent = out.parents.select(
        "tournament_id", *[F.col(c).alias(f"_p_{c}") for c in (*INHERITED, "crawler_status", "eligible")]
    )
    children = _by_name(out.children).join(parent, "tournament_id", "left")
    enough = out.children.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("children: fewer_than_required").alias("check"),
        (F.col("n") >= minimum_children).alias("passed"),
        F.greatest(F.lit(minimum_children) - F.col("n"), F.lit(0)).cast("bigint").alias("bad_rows"),
        F.array().cast("array<string>").alias("sample_ids"),
    )
    return union_all(
        _key_check(out.parents, "tournament_id", "parents: key_empty_or_repeated"),
        _key_check(out.children, "placement_id", "children: key_empty_or_repeated"),
        _prefixed(run_checks(out.parents, {**own, **dates, **money}, "tournament_id"), "parents: "),
        _prefixed(run_checks(children, {**own, **_child_rules()}, "placement_id"), "children: "),
        _totals(out, tolerance),
        _places(log, out),
        enough,
    )
