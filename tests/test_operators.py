import datetime
import math
import random
import statistics
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prizelens.operators import checks as c
from prizelens.operators import joins as j
from prizelens.operators import reconcile as rec
from prizelens.operators import rules as r
from prizelens.operators import stats as st
from prizelens.operators import windows as w
from prizelens.operators.grid import complete_grid, missing_periods
from prizelens.operators.quantiles import exact_quantiles
from prizelens.plans.audit import audit_clean_log
from prizelens.plans.cleaning import CleanLog, clean_log
from prizelens.sources.log import LOG_SCHEMA

D = datetime.date


def rows(df, *order):
    return [tuple(x) for x in df.orderBy(*order).collect()]


@pytest.mark.parametrize("kind", ["ties", "wide", "negative", "one", "hot"])
def test_exact_quantiles_match_numpy(spark, kind):
    rng = random.Random(3)
    data = {
        "ties": [float(rng.randint(0, 5)) for _ in range(200)],
        "wide": [10 ** rng.uniform(-6, 9) for _ in range(301)],
        "negative": [rng.uniform(-50, 50) for _ in range(150)] + [0.0],
        "one": [7.25],
        "hot": [100.0] * 500 + [float(i) for i in range(250)],
    }[kind]
    df = spark.createDataFrame([("a", v) for v in data] + [(None, 1.0), ("b", None)], "g string, v double")
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q1": 1.0}
    out = {x["g"]: x for x in exact_quantiles(df, ["g"], "v", probs).collect()}
    for name, p in probs.items():
        assert out["a"][name] == pytest.approx(np.quantile(data, p), rel=1e-12, abs=1e-12)
    assert out[None]["q50"] == 1.0
    assert "b" not in out


def test_average_rank_matches_pandas(spark):
    data = [("a", v) for v in [3.0, 1.0, 3.0, None, 2.0, 3.0]] + [("b", 5.0), ("b", 5.0)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, g string, v double")
    pdf = df.toPandas()
    expected = pdf.groupby("g").v.rank().tolist()
    got = [x["k"] for x in w.avg_rank(df, ["g"], "v", "k").orderBy("i").collect()]
    assert [None if pd.isna(e) else e for e in expected] == got


def test_global_rank_is_contiguous_with_ties(spark):
    df = spark.range(0, 5000, 1, 7).select(F.col("id"), (F.col("id") % 3).alias("v"))
    out = w.global_rank(df, [F.col("v").desc(), F.col("id")], "place").collect()
    expected = sorted(range(5000), key=lambda i: (-(i % 3), i))
    assert [x["id"] for x in sorted(out, key=lambda x: x["place"])] == expected
    assert sorted(x["place"] for x in out) == list(range(1, 5001))


def test_carry_forward_over_stretches(spark):
    rng = random.Random(1)
    data = [("hot", i, rng.choice([None, None, None, f"h{i}"])) for i in range(3, 200)] + [("b", 5, None), ("b", 6, "x")]
    df = spark.createDataFrame(data, "d string, p int, v string")
    for stretch in (7, 1000):
        out = w.carry_forward(df, ["d"], "p", "v", "head", stretch)
        pdf = out.orderBy("d", "p").toPandas()
        expected = pdf.groupby("d").v.ffill()
        assert [x or None for x in pdf["head"].fillna("")] == [x or None for x in expected.fillna("")]


FACTS = [
    ("late", D(2020, 7, 1), 5), ("late", D(2021, 1, 1), 7),
    ("gap", D(2020, 1, 1), 1), ("gap", D(2021, 4, 1), 0),
    ("before", D(2019, 1, 1), 9), ("after", D(2022, 1, 1), 9),
]


def test_complete_grid(spark):
    facts = spark.createDataFrame(FACTS, "f string, p date, v int")
    grid = complete_grid(facts, "f", "p", "2020-01-01", "2021-04-01", "quarter")
    got = rows(grid, "f", "p")
    calendar = [D(2020, m, 1) for m in (1, 4, 7, 10)] + [D(2021, m, 1) for m in (1, 4)]
    known = {(f, p): v for f, p, v in FACTS}
    expected = [(f, p, known.get((f, p))) for f in sorted({x[0] for x in FACTS}) for p in calendar]
    assert got == expected


def test_grid_of_empty_facts(spark):
    facts = spark.createDataFrame([], "f string, p date, v int")
    assert complete_grid(facts, "f", "p", "2020-01-01", "2021-04-01", "quarter").count() == 0


def test_missing_periods(spark):
    df = spark.createDataFrame([("a", D(2020, 1, 1)), ("a", D(2020, 4, 1)), ("b", D(2020, 1, 1))], "f string, p date")
    got = {x["f"]: x["missing"] for x in missing_periods(df, "f", "p", "month").collect()}
    assert got == {"a": [D(2020, 2, 1), D(2020, 3, 1)], "b": []}


def test_trailing_uses_earlier_periods_only(spark):
    base = [("a", D(2020, m, 1), float(v)) for m, v in zip(range(1, 9), [3, 1, 4, 1, 5, 9, 2, 6])]
    changed = base[:-1] + [("a", D(2020, 8, 1), 1e9)]
    out = []
    for data in (base, changed):
        df = spark.createDataFrame(data, "f string, p date, v double")
        out.append(rows(w.add_trailing(w.add_lags(df, "f", "p", "v", [1]), "f", "p", "v").drop("v"), "p"))
    assert out[0] == out[1]
    series = pd.Series([x[2] for x in base]).shift(1).rolling(4, min_periods=2)
    for got, mean, med, std in zip(out[0], series.mean(), series.median(), series.std()):
        for g, e in zip(got[3:], (mean, med, std)):
            assert (g is None and np.isnan(e)) or g == pytest.approx(e)


def test_growth_only_over_consecutive_periods(spark):
    data = [("a", D(2020, 1, 1), 10), ("a", D(2020, 2, 1), 15), ("a", D(2020, 4, 1), 30), ("a", D(2020, 5, 1), 0), ("a", D(2020, 6, 1), 4)]
    df = spark.createDataFrame(data, "f string, p date, v int")
    got = [x[-1] for x in rows(w.growth(df, "f", "p", "v", consecutive=True), "p")]
    assert got == [None, 50.0, None, -100.0, None]
    assert [x[-1] for x in rows(w.growth(df, "f", "p", "v"), "p")] == [None, 50.0, 100.0, -100.0, None]


def test_first_reason_stops_at_first_rule(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (0, 5), (0, 0)], "a int, b int")
    rules = [("first", F.col("a") == 1), ("second", F.col("b") >= 1), (F.lit(None).cast("string"), None)]
    got = [x[0] for x in df.select(r.first_reason(rules)).collect()]
    assert got == ["first", "second", "second", None]


def test_duplicates_and_ambiguous_ids_on_a_hot_parent(spark):
    data = [("hot", i, i % 2 and "x", f"n{i % 50}") for i in range(300)] + [("p", 0, "x", "A"), ("p", 1, "x", "a"), ("p", 2, None, None)]
    df = spark.createDataFrame([(p, i, t or None, n) for p, i, t, n in data], "p string, pos int, id string, name string")
    repeats = {(x.p, x.pos) for x in r.duplicate_within(df, ["p", "name"], "pos").where("is_repeat").collect()}
    assert repeats == {("hot", i) for i in range(50, 300)}
    flagged = r.flag_duplicates(df, ["p", "id"]).where("is_duplicated").count()
    assert flagged == 300 + 2
    out = {(x.p, x.pos): (x.id, x.identity_status) for x in r.null_ambiguous_ids(df, "p", "id", "name").collect()}
    assert out[("hot", 1)] == (None, "ambiguous_source_id")
    assert out[("hot", 0)] == (None, "source_id_missing")
    assert out[("p", 0)] == ("x", "source_provided_not_verified")
    assert len(out) == 303


def test_iqr_flag_excludes_the_fence_itself(spark):
    # Quartiles 10 and 30, so the upper fence is exactly 60 in both families.
    data = [(f, v) for f in "ab" for v in (0.0, 10.0, 20.0, 30.0)] + [("a", 60.0), ("b", 60.01)]
    df = spark.createDataFrame(data, "f string, v double")
    flagged = r.iqr_flag(df, ["f"], "v").where("v_iqr_flag")
    assert rows(flagged.select("f", "v"), "f") == [("b", 60.01)]


def test_iqr_flag_sends_the_fences_to_the_rows(spark):
    df = spark.range(2000).selectExpr("if(id % 2 = 0, null, 'a') f", "id * 1.0d v")
    flagged = r.iqr_flag(df, ["f"], "v")
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(f" not in plan
    # Quartiles of 0, 2, .. 1998 are 499.5 and 1498.5: no value lies outside, nulls included.
    assert flagged.count() == 2000 and flagged.where("v_iqr_flag").isEmpty()


def test_reconcile_statuses(spark):
    parents = spark.createDataFrame([(i, 1000) for i in range(5)], "k int, pool long")
    kids = spark.createDataFrame([(0, 600), (0, 400), (1, 1001), (2, 998), (3, 1003)], "k int, v long")
    got = {x.k: (x.diff_cents, x.status) for x in rec.reconcile(parents, kids, "k", "pool", "v").collect()}
    assert got == {
        0: (0, "matched"), 1: (1, "rounding_difference"), 2: (-2, "rounding_difference"),
        3: (3, "needs_review"), 4: (None, None),
    }


def test_breakdown_acceptance(spark):
    parents = spark.createDataFrame([(i, 100) for i in range(4)], "k int, pool long")
    kids = spark.createDataFrame([(0, "NA", 98), (1, "AA", 50), (1, "AA", 50), (2, "BB", 97)], "k int, c string, v long")
    audit = rec.audit_breakdown(kids, parents, "k", "c", "v", "pool")
    got = {x.k: x.status for x in audit.collect()}
    assert got == {0: "reconciled", 1: "unavailable", 2: "total_mismatch", 3: "unavailable"}
    kept, _ = rec.accept_breakdown(kids, audit, "k")
    assert rows(kept, "k") == [(0, "NA", 98)]


def test_correlations(spark):
    rng = random.Random(5)
    data = [("a", float(rng.randint(0, 9)), rng.random()) for _ in range(40)]
    data += [("flat", 1.0, float(i)) for i in range(5)] + [("short", 1.0, 2.0), ("short", 2.0, 1.0)]
    df = spark.createDataFrame(data + [("a", None, 1.0)], "f string, x double, y double")
    pdf = pd.DataFrame(data, columns=["f", "x", "y"])
    for method in ("pearson", "spearman"):
        got = {x.f: x.c for x in st.corr_by(df, "f", [("c", "x", "y")], method).collect()}
        a = pdf[pdf.f == "a"]
        expected = a.x.rank().corr(a.y.rank()) if method == "spearman" else a.x.corr(a.y)
        assert got["a"] == pytest.approx(expected)
        assert got["flat"] is None
    trimmed = {(x.f, x["sample"], x.method): (x.n, x["corr"]) for x in st.corr_trimmed(df, "f", "x", "y").collect()}
    assert trimmed[("short", "all_rows", "pearson")] == (2, None)
    assert trimmed[("a", "all_rows", "pearson")][1] == pytest.approx(pdf[pdf.f == "a"][["x", "y"]].corr().iloc[0, 1])


def test_run_checks_limits_ids_but_counts_all(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("odd"))
    out = {x["check"]: x for x in c.run_checks(df, {"even": F.col("odd") == 0, "never": F.col("id") < 0}, "id").collect()}
    assert out["even"]["bad_rows"] == 500 and len(out["even"]["sample_ids"]) == 20
    assert out["never"]["passed"] and out["never"]["bad_rows"] == 0 and out["never"]["sample_ids"] == []
    with pytest.raises(ValueError, match="even"):
        c.require_passed(c.run_checks(df, {"even": F.col("odd") == 0}, "id"))


def test_checked_join_rejects_a_broken_promise(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError, match="right"):
        j.checked_join(a, b, ["k"], "left", "many_to_one")
    with pytest.raises(ValueError, match="left"):
        j.checked_join(b, a, ["k"], "left", "one_to_one")
    assert rows(j.checked_join(a, b.limit(1), ["k"], indicator="seen"), "k")[1] == (2, None, False)
    with pytest.raises(ValueError, match="missing columns"):
        j.require_columns(a, ["k", "z"])


def test_duplicate_sets(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (2, "a"), (3, "a")], "p int, i string")
    assert rows(r.duplicate_sets(df, "p", "i"), "p") == [(1, 2, None), (2, 2, 1), (3, 1, None)]


def test_describe_matches_pandas(spark):
    values = [5.0, 1.0, 1.0, 9.0, 2.5]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0)], "f string, v double")
    out = {x.f: x for x in st.describe_by(df, "f", ["v"]).collect()}
    d = pd.Series(values).describe()
    assert (out["a"].n, out["a"]["mean"], out["a"].q25, out["a"].q50, out["a"].q75) == (
        5, d["mean"], d["25%"], d["50%"], d["75%"])
    assert out["a"]["std"] == pytest.approx(statistics.stdev(values))
    assert out["b"]["std"] is None


def log_row(key, status="matched", tournament=None, items=None, slug="dota-2"):
    import json

    url = f"https://x.org/tournaments/{key}"
    t = {
        "source_tournament_id": key, "source_game_id": "231", "source_url": url,
        "tournament_name_raw": "Cup", "start_date": "2020-01-01", "end_date": "2020-01-02",
        "prize_pool_usd": "100.00",
    }
    t.update(tournament or {})
    if items is None:
        items = [("A", "1", "60.00"), ("B", "2", "40.00")]
    listed = [
        {
            "source_tournament_id": key, "source_url": url, "game_slug": slug,
            "team_name_raw": n, "source_team_id": i, "prize_money_usd": m,
            "rank_min": 1, "rank_max": 1, **(extra[0] if extra else {}),
        }
        for n, i, m, *extra in items
    ]
    t = {k: v for k, v in t.items() if v != "drop"}
    return (key, slug, "231", url, status, None, None, None, None, json.dumps(t), json.dumps(listed), None)


LOG = {
    "1": (log_row("1"), None),
    "2": (log_row("2", tournament={"start_date": "2020-01-03"}), "invalid_date"),
    "3": (log_row("3", tournament={"prize_pool_usd": "drop", "tournament_name_raw": " "}), "missing_tournament_name"),
    "4": (log_row("4", tournament={"prize_pool_usd": "drop"}), "missing_money"),
    "5": (log_row("5", items=[("A", "1", "60.02"), ("B", "2", "40.00")]), "stored_reconciliation_status_mismatch"),
    "6": (log_row("6", "rounding_difference", items=[("A", "1", "60.02"), ("B", "2", "40.00")]), None),
    "7": (log_row("7", items=[("A", "1", "60.00"), ("a ", "2", "40.00"), ("C", "3", "-5")]), "duplicate_team_name"),
    "8": (log_row("8", items=[("A", "1", "60.00"), ("C", "3", "-5"), ("a", "2", "40.00")]), "invalid_money"),
    "9": (log_row("9", items=[("A", "1", "60.00"), ("B", "1", "40.00")]), "ambiguous_source_team_id"),
    "10": (log_row("10", "needs_review"), "prize_allocation_pending_review"),
    "11": (log_row("11", "tournament_only"), "placements_unavailable_or_unapproved"),
    "12": (log_row("12", items=[]), "missing_placements"),
    "13": (log_row("13", "failed"), "failed_or_missing_tournament"),
    "14": (log_row("14", items=[("A coach", "1", "100.00")]), "supplementary_roster_allocation_needs_review"),
    "15": (log_row("15", items=[("A", "1", "100.00", {"rank_min": None, "rank_max": None})]), "missing_rank_and_outcome"),
    "16": (log_row("16", items=[("A", "1", "100.00", {"rank_min": 3, "rank_max": 2})]), "invalid_rank_range"),
    "x1": (log_row("x1"), "invalid_tournament_id"),
    "17": (log_row("17", tournament={"start_date": "2011-12-31"}), "start_date_outside_scope"),
    "18": (log_row("18", tournament={"start_date": "2012-01-01", "end_date": "2012-01-01"}), None),
    "19": (log_row("19", slug="other"), "game_outside_scope"),
    "20": (log_row("20", tournament={"date_validation_status": "invalid_date"}), "invalid_date"),
    "22": ((*log_row("22")[:9], '{"source_url": "x"', *log_row("22")[10:]), "unreadable_payload"),
    "23": ((*log_row("23")[:10], '[{"a": 1}, ', None), "unreadable_payload"),
    "24": ((*log_row("24")[:9], "[]", *log_row("24")[10:]), "unreadable_payload"),
    "25": (log_row("25", items=[("Ａe\u0301", "1", "60.00"), ("Ａé", "2", "40.00")]), "duplicate_team_name"),
    "26": (log_row("26", items=[("Straße", "1", "60.00"), ("STRASSE", "1", "40.00")]), "duplicate_team_name"),
    "21": (log_row("21", items=[("A", "1", "100.00", {"rank_min": None, "rank_max": None, "result_outcome": "WIN"})]), None),
}


def test_clean_log_rules(spark):
    log = spark.createDataFrame([v[0] for v in LOG.values()], LOG_SCHEMA)
    config = spark.createDataFrame(
        [("dota-2", "g1", "231", "Dota 2", "Dota 2")],
        "game_slug string, game_id string, earnings_game_id string, game_family string, game_name string",
    )
    out = clean_log(log, config, "2012-01-01", "2025-12-31")
    for df in (out.parents, out.children, out.quarantine, out.out_of_scope):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # Only the configuration is joined; rules and Python calls stand once.
        assert plan.count("Join") == 1 and plan.count("hashpartitioning") <= 2
        assert plan.count("from_json") <= 4 and plan.count("ArrowEvalPython") <= 3
    got = {x.tournament_id: x.reason for x in out.quarantine.collect()}
    got.update({x.tournament_id: x.reason for x in out.out_of_scope.collect()})
    assert got == {k: reason for k, (_, reason) in LOG.items() if reason}
    kids = out.children.groupBy("tournament_id").count().collect()
    assert {x[0]: x[1] for x in kids} == {
        "earnings:1": 2, "earnings:6": 2, "earnings:9": 2, "earnings:18": 2, "earnings:21": 1,
    }
    assert out.children.select("placement_id").distinct().count() == out.children.count()
    nine = out.children.where("tournament_id = 'earnings:9'").collect()
    assert {(x.source_team_id, x.key_basis) for x in nine} == {(None, "tournament_and_team_name")}


def test_audit_of_a_clean_log(spark):
    log = spark.createDataFrame([v[0] for v in LOG.values()], LOG_SCHEMA)
    config = spark.createDataFrame(
        [("dota-2", "g1", "231", "Dota 2", "Dota 2")],
        "game_slug string, game_id string, earnings_game_id string, game_family string, game_name string",
    )
    out = clean_log(log, config, "2012-01-01", "2025-12-31")
    out = CleanLog(*(df.cache() for df in (out.parents, out.children, out.quarantine, out.out_of_scope)))
    scope = (["dota-2"], "2012-01-01", "2025-12-31")
    found = audit_clean_log(log, out, *scope, minimum_children=5).collect()
    assert len(found) == 24 and [x.check for x in found if not x.passed] == []
    twice = CleanLog(out.parents.union(out.parents.limit(1)), out.children.union(out.children.limit(1)), out.quarantine, out.out_of_scope)
    failed = {x.check for x in audit_clean_log(log, twice, *scope, minimum_children=99).collect() if not x.passed}
    assert {"parents: key_empty_or_repeated", "children: key_empty_or_repeated", "children: name_empty_or_repeated",
            "children: fewer_than_required"} <= failed
    none = CleanLog(*(df.limit(0) for df in (out.parents, out.children, out.quarantine, out.out_of_scope)))
    assert {x.check for x in audit_clean_log(log, none, *scope).collect() if not x.passed} == {"places: not_in_exactly_one"}


def test_moments_of_very_large_cents(spark):
    big = 2**53
    values = [big, big + 1, big + 3, -big, 7, 7, None]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)] + [("c", big)], "family string, x long")
    got = {r.family: r for r in st.describe_by(df, "family", ["x"]).collect()}
    known = [v for v in values if v is not None]
    mean = Fraction(sum(known), len(known))
    exact = math.sqrt(sum((v - mean) ** 2 for v in known) / (len(known) - 1))
    assert got["a"].n == 6 and got["a"]["std"] == pytest.approx(exact, rel=1e-14)
    near = spark.createDataFrame([("a", big + d) for d in (0, 1, 2, 3)], "family string, x long")
    assert st.describe_by(near, "family", ["x"]).first()["std"] == pytest.approx(math.sqrt(5 / 3), rel=1e-14)
    assert (got["b"].n, got["b"]["mean"], got["b"]["std"]) == (0, None, None)
    assert (got["c"].n, got["c"]["std"], got["c"]["max"]) == (1, None, float(big))
    halves = spark.createDataFrame([("a", 0.5), ("a", 1.5), ("a", 4.0)], "family string, x double")
    assert st.describe_by(halves, "family", ["x"]).first()["std"] == pytest.approx(1.8027756, rel=1e-6)


def test_flows_with_several_outputs_judge_the_log_once(spark, sf):
    from prizelens.queries.rules import _stored_cleaned

    out = _stored_cleaned(spark, sf)
    for df in (out.parents, out.children, out.quarantine, out.out_of_scope):
        assert "from_json" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_money_cents_rounds_half_up_and_refuses_what_is_no_amount(spark):
    from prizelens.functions.money import money_cents

    texts = ["1.005", "0", "-1", "x", "9999999999999999.99", "10000000000000000", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [x.c for x in df.select("i", money_cents(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [101, 0, None, None, 999999999999999999, None, None]
