import datetime

import pytest
from pyspark.sql import functions as F

from prizelens.operators import forecast as fc
from prizelens.operators.scoring import predictions_long, score

D = datetime.date


@pytest.fixture(scope="module")
def grid(spark):
    """Two families on a line plus a season; one starts late, one test gap."""
    data = []
    for i in range(32):
        start = D(2014 + i // 4, 1 + 3 * (i % 4), 1)
        split = "train" if i < 24 else "validation" if i < 28 else "test"
        for family, base in (("a", 100.0), ("b", 500.0)):
            value = base + 10.0 * i + (i % 4) * 7.0
            missing = (family == "b" and i < 5) or (family == "a" and i == 30)
            data.append((family, f"{start.year}Q{i % 4 + 1}", start, split, None if missing else value))
    return spark.createDataFrame(data, "family string, quarter string, period_start date, split string, target double")


def test_linear_finds_the_closed_form(spark, grid):
    rows = fc.feature_table(grid, "target")
    fitted = fc.fit_linear(fc.fit_rows_of(rows, "target", ["train"]), "target")
    got = fitted.predict(fc.predict_rows_of(rows, "validation"), "p").collect()
    assert len(got) == 8
    for x in got:
        assert x.p == pytest.approx(x.target, abs=1e-3)


def test_features_do_not_see_the_present(spark, grid):
    changed = grid.withColumn(
        "target", F.when(F.col("quarter") == "2021Q4", F.lit(1e9)).otherwise(F.col("target"))
    )
    keep = ["family", "quarter", *fc.FEATURES]
    a, b = (sorted(map(str, fc.feature_table(g, "target").select(list(dict.fromkeys(keep))).collect())) for g in (grid, changed))
    assert a == b


def test_protocol(spark, grid):
    rows = fc.feature_table(grid, "target").cache()
    out, linear, forest = fc.rolling_one_step(rows, "target", "source", fc.FOREST_GRID[0], trees=20)
    got = out.collect()
    assert len(got) == 16
    gap = [x for x in got if not x.evaluation_available]
    assert [(x.family, x.quarter, x.evaluation_status) for x in gap] == [("a", "2021Q3", "target_missing_prediction_only")]
    assert all(x.prediction_random_forest >= 0 and x.prediction_linear_regression >= 0 for x in got)
    long = predictions_long(out, fc.MODELS, "random_forest", "seasonal_naive")
    scores = {(x.split, x.model, x.family): x for x in score(long, ["split", "model"], "family").collect()}
    overall = scores[("test", "seasonal_naive", "Overall")]
    assert (overall.n_total, overall.n_evaluated, overall.coverage_pct) == (8, 7, 87.5)
    assert overall.mae_usd == pytest.approx(40.0)
    assert scores[("test", "seasonal_naive", "a")].r2_diagnostic is None
    assert scores[("validation", "linear_regression", "Overall")].mae_usd < 1e-3
    names = {x.feature for x in fc.diagnostics(linear).collect()}
    assert "family_b" in names and "family_a" not in names and "quarter_of_year_1" not in names
    assert sum(x.value for x in fc.diagnostics(forest).collect()) == pytest.approx(1.0)


def test_tuning_orders_by_error(spark, grid):
    rows = fc.feature_table(grid, "target").cache()
    out = fc.tune_forest(rows, "target", fc.FOREST_GRID[:2], trees=10).collect()
    assert len(out) == 2 and out[0].rmse <= out[1].rmse


def test_unseen_levels_and_gaps(spark, grid):
    rows = fc.feature_table(grid, "target")
    fitted = fc.fit_forest(fc.fit_rows_of(rows, "target", ["train"]).where("family = 'b'"), "target", fc.FOREST_GRID[0], trees=5)
    got = fitted.predict(fc.predict_rows_of(rows, "validation"), "p")
    assert got.where("p IS NULL").count() == 0
    assert set(got.columns) == {*rows.columns, "p"}


def test_levels_have_no_limit(spark):
    """3,000 families fit and predict; a family that the fit rows lack is all zeros."""
    rows = spark.range(6_000).select(
        F.concat(F.lit("f"), F.col("id") % 3_000).alias("family"),
        F.lit("1").alias("quarter_of_year"),
        *((F.col("id") % (7 + i)).cast("double").alias(c) for i, c in enumerate(fc.NUMERIC)),
        (F.col("id") % 3_000).cast("double").alias("target"),
    )
    fitted = fc.fit_forest(rows, "target", fc.FOREST_GRID[0], trees=2)
    assert len(fitted.design.levels["family"]) == 3_000
    other = rows.limit(5).withColumn("family", F.lit("unseen"))
    assert fitted.predict(other, "p").where("p is not null").count() == 5


def test_baseline_scores_of_large_whole_numbers(spark):
    from prizelens.operators.scoring import baseline_scores

    df = spark.createDataFrame(
        [("a", 0, 4_000_000_000), ("a", 4_000_000_000, 0), ("a", None, 5)],
        "family string, x bigint, prediction bigint",
    )
    assert [tuple(r) for r in baseline_scores(df, ["family"], "x").collect()] == [
        ("a", 2, 4e9, 4e9)
    ]
