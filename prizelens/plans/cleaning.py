"""Raw log to clean parents, clean children, quarantine and diverted rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prizelens.functions import calendar as cal
from prizelens.functions import money as m
from prizelens.functions import text as t
from prizelens.operators.rules import first_reason
from prizelens.sources.log import (
    PLACEMENTS_SCHEMA,
    TOURNAMENT_SCHEMA,
    decode_payload,
)

ACCEPTED = ("matched", "rounding_difference")


def split_scope(
    df: DataFrame, day: str, low: str, high: str
) -> tuple[DataFrame, DataFrame]:
    """(rows inside the inclusive range, all other rows)."""
    inside = F.coalesce(
        F.col(day).between(F.lit(low).cast("date"), F.lit(high).cast("date")),
        F.lit(False),
    )
    return df.where(inside), df.where(~inside)


def status_gate_reason(status: Column, accepted: Sequence[str] = ACCEPTED) -> Column:
    """Why a parent's children are not used, by its stored status."""
    return F.when(F.coalesce(status.isin(*accepted), F.lit(False)), None).otherwise(
        F.when(status == "needs_review", F.lit("prize_allocation_pending_review"))
        .otherwise(F.lit("placements_unavailable_or_unapproved"))
    )


@dataclass
class CleanLog:
    parents: DataFrame
    children: DataFrame
    quarantine: DataFrame
    out_of_scope: DataFrame


DIVERTED = ("game_outside_scope", "start_date_outside_scope")


def parent_reason(low: str, high: str, first_year: dict[str, int]) -> Column:
    """Ordered parent rules on a decoded log row joined to its configuration."""
    start, end = cal.parse_day(F.col("t.start_date")), cal.parse_day(F.col("t.end_date"))
    empty = F.coalesce(F.regexp_replace("tournament_json", r"\s", ""), F.lit("")).isin(
        "", "{}"
    )

    def differs(a: Column, b: Column) -> Column:
        return ~a.eqNullSafe(b)

    return first_reason(
        [
            ("game_outside_scope", F.col("game_family").isNull()),
            ("unreadable_payload", F.col("t").isNull() | F.col("items").isNull()),
            ("failed_or_missing_tournament", (F.col("status") == "failed") | empty),
            ("invalid_tournament_id", ~F.col("tournament_id").rlike(r"^\d+$")),
            (
                "tournament_id_mismatch",
                differs(F.col("t.source_tournament_id"), F.col("tournament_id")),
            ),
            (
                "game_id_mismatch",
                differs(F.col("source_game_id"), F.col("earnings_game_id"))
                | differs(F.col("t.source_game_id"), F.col("earnings_game_id")),
            ),
            ("source_url_mismatch", differs(F.col("t.source_url"), F.col("source_url"))),
            ("missing_tournament_name", F.col("tournament_name").isNull()),
            ("invalid_date", F.col("t.date_validation_status") == "invalid_date"),
            ("missing_date", F.col("t.start_date").isNull() | F.col("t.end_date").isNull()),
            (cal.range_reason(start, end), None),
            (m.money_reason(F.col("t.prize_pool_usd")), None),
            (
                "start_date_outside_scope",
                ~start.between(F.lit(low).cast("date"), F.lit(high).cast("date")),
            ),
            (
                "game_version_date_needs_review",
                ~cal.plausible_version(F.col("game_slug"), start, first_year),
            ),
        ]
    )


def judge_parents(
    log: DataFrame,
    config: DataFrame,
    low: str,
    high: str,
    first_year: dict[str, int],
) -> DataFrame:
    """Every log row decoded, with its ``parent_reason`` and its ``gate_reason``."""
    decoded = decode_payload(log, "tournament_json", TOURNAMENT_SCHEMA, "t")
    decoded = decode_payload(decoded, "placements_json", PLACEMENTS_SCHEMA, "items")
    joined = decoded.join(config, "game_slug", "left").withColumn(
        "tournament_name", t.clean_text(F.col("t.tournament_name_raw"))
    )
    judged = joined.withColumn("parent_reason", parent_reason(low, high, first_year))
    no_items = F.coalesce(F.size("items"), F.lit(0)) <= 0
    return judged.withColumns(
        {
            "start_date": cal.parse_day(F.col("t.start_date")),
            "end_date": cal.parse_day(F.col("t.end_date")),
            "pool_cents": m.money_cents(F.col("t.prize_pool_usd")),
            "version_evidence": F.col("t.game_source_url"),
            "gate_reason": F.coalesce(
                status_gate_reason(F.col("status")),
                F.when(no_items, F.lit("missing_placements")),
            ),
        }
    ).drop("t")


def _repeats(order: Column) -> Column:
    """Per position whether an earlier one has the same key; ``order`` holds (key, position)
    sorted."""
    flags = F.transform(
        order,
        lambda e, i: F.struct(
            e["n"].alias("n"),
            F.coalesce(e["k"] == F.get(order, i - 1)["k"], F.lit(False)).alias("again"),
        ),
    )
    return F.transform(F.array_sort(flags), lambda e: e["again"])


def _shared_ids(pairs: Column) -> Column:
    """Ids that go with several keys; ``pairs`` holds distinct (id, key) sorted."""
    second = F.filter(pairs, lambda p, i: p["id"] == F.get(pairs, i - 1)["id"])
    return F.array_distinct(F.transform(second, lambda p: p["id"]))


def child_reason(kid: Column) -> Column:
    """Ordered child rules on one decoded item."""

    def differs(a: str, b: Column) -> Column:
        return ~kid[a].eqNullSafe(b)

    return first_reason(
        [
            ("placement_tournament_id_mismatch", differs("item_tournament_id", F.col("tournament_id"))),
            ("placement_source_url_mismatch", differs("item_url", F.col("source_url"))),
            ("placement_game_mismatch", differs("item_slug", F.col("game_slug"))),
            ("missing_team_name", kid["team_name"].isNull()),
            ("duplicate_team_name", kid["repeated"]),
            (
                "supplementary_roster_allocation_needs_review",
                t.is_supplement(kid["team_name"]),
            ),
            # Where a text is there but no number came of it, the text is at fault.
            ("missing_money", kid["raw_money"].isNull()),
            ("invalid_money", kid["prize_cents"].isNull()),
            ("invalid_rank", kid["raw_min"].isNotNull() & kid["rank_min"].isNull()),
            ("invalid_rank", kid["raw_max"].isNotNull() & kid["rank_max"].isNull()),
            (m.rank_reason(kid["rank_min"], kid["rank_max"], kid["result_outcome"]), None),
        ]
    )


def judge_children(parents: DataFrame) -> DataFrame:
    """Add ``kids`` (each with the first rule it breaks) to parents that pass their own rules.

    A parent's children come out of one log row and are judged inside it, by array
    functions: nothing is exploded, shuffled or stored. Sorted arrays find repeats, so
    the cost grows like a sort (and with the number of ids that name several teams).
    """
    usable = F.col("parent_reason").isNull() & F.col("gate_reason").isNull()
    items = parents.withColumn("_items", F.when(usable, F.col("items")))
    named = items.withColumns(
        {
            "_names": F.transform("_items", lambda i: i["team_name_raw"]),
            "_ids": F.transform("_items", lambda i: i["source_team_id"]),
        }
    ).withColumns({"_names": t.clean_texts(F.col("_names")), "_ids": t.clean_texts(F.col("_ids"))})
    keyed = named.withColumn("_keys", t.name_keys(F.col("_names")))
    pairs = F.filter(
        F.arrays_zip(F.col("_ids").alias("id"), F.col("_keys").alias("k")),
        lambda p: p["id"].isNotNull() & p["k"].isNotNull(),
    )
    order = F.array_sort(
        F.transform("_keys", lambda k, n: F.struct(k.alias("k"), n.alias("n")))
    )
    flagged = keyed.withColumns(
        {"_order": order, "_pairs": F.array_sort(F.array_distinct(pairs))}
    ).withColumns(
        {"_again": _repeats(F.col("_order")), "_shared": _shared_ids(F.col("_pairs"))}
    )

    def kid(i: Column, n: Column) -> Column:
        return F.struct(
            n.alias("pos"),
            i["source_tournament_id"].alias("item_tournament_id"),
            i["source_url"].alias("item_url"),
            i["game_slug"].alias("item_slug"),
            F.get("_names", n).alias("team_name"),
            F.get("_keys", n).alias("folded_name"),
            F.get("_ids", n).alias("source_team_id_raw"),
            F.get("_again", n).alias("repeated"),
            F.coalesce(F.array_contains("_shared", F.get("_ids", n)), F.lit(False)).alias("ambiguous"),
            i["prize_money_usd"].alias("raw_money"),
            i["rank_min"].alias("raw_min"),
            i["rank_max"].alias("raw_max"),
            m.rank_number(i["rank_min"]).alias("rank_min"),
            m.rank_number(i["rank_max"]).alias("rank_max"),
            t.squeeze(i["result_outcome"]).alias("result_outcome"),
            m.money_cents(i["prize_money_usd"]).alias("prize_cents"),
        )

    def judged(k: Column) -> Column:
        return k.dropFields(
            "item_tournament_id", "item_url", "item_slug", "repeated", "raw_money", "raw_min", "raw_max"
        ).withField("reason", child_reason(k))

    kids = flagged.withColumn("kids", F.transform("_items", kid))
    return kids.withColumn("kids", F.transform("kids", judged)).drop(
        "items", "_items", "_names", "_ids", "_keys", "_order", "_pairs", "_again", "_shared"
    )


def judge_log(
    log: DataFrame,
    config: DataFrame,
    low: str,
    high: str,
    first_year: dict[str, int] | None = None,
    tolerance: int = 2,
) -> DataFrame:
    """One row per log row with the verdicts on it, its children and the issues it raises.

    Only the join with ``config`` can shuffle. ``split_log`` makes the outputs of it.
    """
    judged = judge_children(judge_parents(log, config, low, high, first_year or {}))
    bad = F.filter("kids", lambda k: k["reason"].isNotNull())
    total = F.aggregate(
        "kids", F.lit(None).cast("bigint"),
        lambda s, k: F.coalesce(s + k["prize_cents"], s, k["prize_cents"]),
    )
    passed = F.col("parent_reason").isNull()
    return (
        judged.withColumns(
            {
                "veto_reason": F.get(bad, F.lit(0))["reason"],
                "child_cents": total,
                "has_ambiguous": F.exists("kids", lambda k: k["ambiguous"]),
            }
        )
        .withColumn("diff_cents", F.col("child_cents") - F.col("pool_cents"))
        .withColumn("recomputed_status", m.prize_status(F.col("diff_cents"), tolerance))
        .withColumn(
            "child_reason",
            F.when(
                passed,
                F.coalesce(
                    "gate_reason",
                    "veto_reason",
                    F.when(
                        ~F.col("recomputed_status").eqNullSafe(F.col("status")),
                        F.lit("stored_reconciliation_status_mismatch"),
                    ),
                ),
            ),
        )
        .withColumn("eligible", passed & F.col("child_reason").isNull())
        .withColumn(
            "identity_note",
            F.when(F.col("eligible") & F.col("has_ambiguous"), F.lit("ambiguous_source_team_id")),
        )
        .withColumn("quality_note", F.coalesce("child_reason", "identity_note"))
        .drop("gate_reason", "veto_reason", "has_ambiguous")
    )


def _rows_where(df: DataFrame, kept: Column, *columns: str | Column) -> DataFrame:
    """The columns of the rows that are kept, as a generator: a filter would be pushed into
    the rules and judge every row twice."""
    row = F.struct(*columns)
    return df.select(F.explode(F.when(kept, F.array(row)).otherwise(F.array()))).select("col.*")


def split_log(judged: DataFrame) -> CleanLog:
    """Clean parents and children, quarantine and diverted rows of judged log rows.

    Each output is a narrow pass over ``judged``. Whoever writes several stores
    ``judged`` first; nothing is stored here.
    """
    passed, diverted = F.col("parent_reason").isNull(), F.col("parent_reason").isin(*DIVERTED)
    parents = cal.with_calendar(_rows_where(
        judged, passed,
        t.namespaced_id("earnings", F.col("tournament_id")).alias("tournament_id"),
        "game_slug", "game_id", "game_family",
        F.col("game_name").alias("game_version"), "version_evidence",
        "tournament_name", "start_date", "end_date", "pool_cents",
        F.col("status").alias("crawler_status"), "eligible", "quality_note",
        F.when(F.col("eligible"), F.col("child_cents")).alias("child_cents"),
        t.strict_quality(F.col("quality_note"), F.col("eligible")).alias("strict"),
    ), "start_date")
    kid = F.col("kid")
    raw_id, ambiguous = kid["source_team_id_raw"], kid["ambiguous"]
    team_id = F.when(~ambiguous, raw_id)
    key = t.placement_key(F.col("source_id"), team_id, kid["folded_name"])
    children = judged.select(
        F.col("tournament_id").alias("source_id"), "game_slug", "game_family",
        F.col("game_name").alias("game_version"), "start_date",
        F.col("recomputed_status").alias("validation_status"), "diff_cents",
        F.explode(F.when(F.col("eligible"), F.col("kids"))).alias("kid"),
    ).select(
        key["placement_id"].alias("placement_id"),
        t.namespaced_id("earnings", F.col("source_id")).alias("tournament_id"),
        "game_slug", "game_family", "game_version", kid["pos"].alias("pos"),
        kid["team_name"].alias("team_name"),
        team_id.alias("source_team_id"),
        raw_id.alias("source_team_id_raw"),
        F.when(ambiguous, F.lit("ambiguous_source_id"))
        .when(raw_id.isNotNull(), F.lit("source_provided_not_verified"))
        .otherwise(F.lit("source_id_missing"))
        .alias("identity_status"),
        key["key_basis"].alias("key_basis"),
        kid["rank_min"].alias("rank_min"), kid["rank_max"].alias("rank_max"),
        kid["result_outcome"].alias("result_outcome"), kid["prize_cents"].alias("prize_cents"),
        "start_date", "validation_status", "diff_cents",
    )

    def issue(reason: Column, affected: str) -> Column:
        return F.when(
            reason.isNotNull(), F.struct(reason.alias("reason"), F.lit(affected).alias("affected_table"))
        )

    issues = F.array_compact(F.array(
        issue(F.when(~diverted, F.col("parent_reason")), "both"),
        issue(F.col("child_reason"), "placements"),
        issue(F.col("identity_note"), "team_identity"),
    ))
    quarantine = judged.select("*", F.explode(issues).alias("_i")).select(
        "tournament_id", "game_slug", "_i.reason", "_i.affected_table",
        F.col("status").alias("crawler_status"), "source_url", "html_file",
        F.col("error").alias("crawler_error"),
        "tournament_json", "placements_json", "audit_json",
    )
    return CleanLog(
        parents=parents.select(
            "tournament_id", "game_slug", "game_id", "game_family", "game_version",
            "version_evidence", "tournament_name", "start_date", "end_date", "year", "quarter",
            "pool_cents", "crawler_status", "eligible", "quality_note", "child_cents", "strict",
        ),
        children=children,
        quarantine=quarantine,
        out_of_scope=_rows_where(
            judged, diverted, "game_slug", "tournament_id",
            F.col("parent_reason").alias("reason"), "source_url",
        ),
    )


def clean_log(
    log: DataFrame,
    config: DataFrame,
    low: str,
    high: str,
    first_year: dict[str, int] | None = None,
    tolerance: int = 2,
) -> CleanLog:
    """Apply the ordered rules to a raw result log.

    ``config`` holds game_slug, game_id, earnings_game_id, game_family and
    game_name of the enabled games. A rejected parent leaves with its children; a
    parent that passes stays even when its children are rejected. Children are
    rejected as a whole by their first bad row. A payload that is not JSON of its kind is
    ``unreadable_payload``.
    """
    return split_log(judge_log(log, config, low, high, first_year, tolerance))
