"""Forecasting.

What a fitted model gives on real money has no closed form. The twins see fitted numbers on
targets that have one: a straight line, which least squares repeats exactly, and a step
in time, which a tree of depth 1 repeats exactly. On real money they see that forests stay
inside the range of what they were fitted on.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prizelens.operators import forecast as fc
from prizelens.operators.scoring import seasonal_naive
from prizelens.queries.aggregations import rounded
from prizelens.queries.registry import query
from prizelens.queries.shapes import GRID, grid
from prizelens.session import ensure_checkpoint_dir

KEYS = ["family", "quarter", "period_start", "split"]
SETTING = fc.FOREST_GRID[0]
TARGETS = {"source": "target_usd", "strict_quality": "strict_target_usd"}
TREES = 500
STUMP = fc.ForestSetting(1, 1, "all")
STEP = 14  # period at which the step target jumps


def features(spark, sf, target="target_usd"):
    """The feature table, written once: every fit below reads it several times."""
    ensure_checkpoint_dir(spark)
    table = grid(spark, sf).select(*KEYS, *TARGETS.values())
    return fc.feature_table(table, target).checkpoint()


@query(
    "m01_seasonal_naive",
    f"""
    WITH {GRID}
    SELECT family, quarter, target_usd, lag(target_usd, 4) OVER (PARTITION BY family ORDER BY period_start) AS prediction
    FROM grid
    """,
)
def naive(spark, sf):
    return seasonal_naive(
        grid(spark, sf), "family", "period_start", "target_usd", 4
    ).select("family", "quarter", "target_usd", "prediction")


@query(
    "m02_feature_table",
    f"""
    WITH {GRID}
    SELECT family, quarter, split, target_usd, lag(target_usd, 1) OVER w AS lag_1, lag(target_usd, 2) OVER w AS lag_2,
      lag(target_usd, 4) OVER w AS lag_4,
      CASE WHEN count(target_usd) OVER b >= 2 THEN round(avg(target_usd) OVER b, 4) END AS rolling_mean_4,
      CASE WHEN count(target_usd) OVER b >= 2 THEN round(quantile_cont(target_usd, 0.5) OVER b, 4) END AS rolling_median_4,
      CASE WHEN count(target_usd) OVER b >= 2 THEN round(stddev_samp(target_usd) OVER b, 2) END AS rolling_std_4,
      CAST(row_number() OVER w - 1 AS INTEGER) AS time_index, CAST(quarter(period_start) AS VARCHAR) AS quarter_of_year
    FROM grid WINDOW w AS (PARTITION BY family ORDER BY period_start),
      b AS (PARTITION BY family ORDER BY period_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)
    """,
)
def feature_table(spark, sf):
    out = fc.feature_table(grid(spark, sf), "target_usd").select(
        "family", "quarter", "split", "target_usd", *fc.NUMERIC, "quarter_of_year"
    )
    return rounded(rounded(out, 4, "rolling_mean_4", "rolling_median_4"), 2, "rolling_std_4")


@query(
    "m03_linear_regression",
    f"""
    WITH {GRID}, t AS (
      SELECT family, quarter, period_start, split, row_number() OVER (PARTITION BY family ORDER BY period_start) AS k,
        CAST(CAST(substr(family, 1, 1) AS INTEGER) * 10000 + 100 * (year(period_start) * 4 + quarter(period_start)) AS DOUBLE) AS y
      FROM grid)
    SELECT family, quarter, period_start, split, y AS target_usd, y AS prediction FROM t WHERE split = 'validation' AND k > 4
    """,
)
def linear_regression(spark, sf):
    """A target that is an exact linear function of the features comes back as predicted."""
    start = F.col("period_start")
    line = F.substring("family", 1, 1).cast("int") * 10000 + 100 * (F.year(start) * 4 + F.quarter(start))
    rows = grid(spark, sf).select(*KEYS, line.cast("double").alias("target_usd"))
    ensure_checkpoint_dir(spark)
    rows = fc.feature_table(rows, "target_usd").checkpoint()
    fitted = fc.fit_linear(fc.fit_rows_of(rows, "target_usd", ["train"]), "target_usd")
    predicted = fitted.predict(fc.predict_rows_of(rows, "validation"), "prediction")
    return predicted.select(*KEYS, "target_usd", F.round("prediction", -1).alias("prediction"))


# A straight line in time per family, with the real gaps; its first fit row has period 5.
LINE = """line AS (
      SELECT *, lag(y, 4) OVER (PARTITION BY family ORDER BY period_start) AS y_4 FROM (
        SELECT family, quarter, period_start, split, CASE WHEN target_usd IS NOT NULL THEN {base} + CAST(
          CAST(substr(family, 1, 1) AS INTEGER) * 10000 + 100 * (year(period_start) * 4 + quarter(period_start)) AS DOUBLE) END AS y
        FROM grid))"""
# Distance of a train row from the step: bagging blurs the two periods next to it.
STEPPED = f"""stepped AS (
      SELECT *, lag(y, 4) OVER (PARTITION BY family ORDER BY period_start) AS y_4, abs(k - {STEP} + 0.5) < 2 AS near_step FROM (
        SELECT family, quarter, period_start, split, k, CASE WHEN k < {STEP} THEN 1000.0::DOUBLE ELSE 5000.0::DOUBLE END AS y
        FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY period_start) - 1 AS k FROM grid)))"""


def line_grid(spark, sf):
    """The grid with two straight lines as targets, null where no money was observed."""
    start = F.col("period_start")
    line = F.substring("family", 1, 1).cast("int") * 10000 + 100 * (F.year(start) * 4 + F.quarter(start))
    lines = {
        t: F.when(F.col("target_usd").isNotNull(), (line + base).cast("double"))
        for base, t in zip((0, 5_000_000), TARGETS.values())
    }
    return grid(spark, sf).select(*KEYS, *[c.alias(t) for t, c in lines.items()])


def stepped_features(spark, sf):
    """Features of a target that jumps once, at the same period for all families."""
    ensure_checkpoint_dir(spark)
    rows = fc.time_index(grid(spark, sf).select(*KEYS), "family", "period_start")
    rows = rows.withColumn("target_usd", F.when(F.col("time_index") < STEP, 1000.0).otherwise(5000.0))
    return fc.feature_table(rows.drop("time_index"), "target_usd").checkpoint()


def in_range(predicted: str, fit_rows, target: str):
    """Whether a prediction lies between the least and the largest target of the fit rows,
    but for the last digits."""
    low, high = fit_rows.agg(F.min(target), F.max(target)).first()
    value, slack = F.col(predicted), abs(high) * 1e-9
    return F.coalesce(value.between(low - slack, high + slack), F.lit(False))


@query(
    "m04_random_forest",
    f"""
    WITH {GRID}
    SELECT family, quarter, period_start, split, target_usd, true AS in_range
    FROM (SELECT *, lag(target_usd, 4) OVER (PARTITION BY family ORDER BY period_start) AS lag_4 FROM grid)
    WHERE split = 'validation' AND lag_4 IS NOT NULL
    """,
)
def random_forest(spark, sf):
    rows = features(spark, sf)
    train = fc.fit_rows_of(rows, "target_usd", ["train"])
    fitted = fc.fit_forest(train, "target_usd", SETTING, TREES)
    predicted = fitted.predict(fc.predict_rows_of(rows, "validation"), "prediction")
    return predicted.select(
        *KEYS, "target_usd", in_range("prediction", train, "target_usd").alias("in_range")
    )


@query(
    "m04_forest_of_a_step",
    f"""
    WITH {GRID}, {STEPPED}
    SELECT family, quarter, period_start, split, y AS target_usd, near_step, CASE WHEN NOT near_step THEN y END AS prediction
    FROM stepped WHERE split <> 'test' AND y_4 IS NOT NULL
    """,
)
def forest_of_a_step(spark, sf):
    """Trees of depth 1 repeat a target that jumps once; beside the jump bagging may blur."""
    rows = stepped_features(spark, sf)
    train = fc.fit_rows_of(rows, "target_usd", ["train"])
    fitted = fc.fit_forest(train, "target_usd", STUMP, TREES)
    seen = rows.where((F.col("split") != "test") & F.col("lag_4").isNotNull())
    near = F.abs(F.col("time_index") - STEP + 0.5) < 2
    return fitted.predict(seen, "prediction").select(
        *KEYS, "target_usd", near.alias("near_step"),
        F.when(~near, F.round("prediction", 4)).alias("prediction"),
    )


@query(
    "m05_forest_tuning",
    f"""
    WITH {GRID}, v AS (
      SELECT count(*) AS n FROM (SELECT *, lag(target_usd, 4) OVER (PARTITION BY family ORDER BY period_start) AS lag_4 FROM grid)
      WHERE split = 'validation' AND lag_4 IS NOT NULL AND target_usd IS NOT NULL)
    SELECT c.*, n, true AS scored FROM v, (VALUES """
    + ", ".join(f"({i}, {s.depth}, {s.leaf}, '{s.features}')" for i, s in enumerate(fc.FOREST_GRID, 1))
    + """) AS c(candidate_id, max_depth, min_leaf, feature_share)
    """,
)
def forest_tuning(spark, sf):
    """All candidates on real money: each is scored on the same rows."""
    scores = fc.tune_forest(features(spark, sf), "target_usd", trees=TREES)
    sound = (F.col("mae") > 0) & (F.col("rmse") >= F.col("mae"))
    return scores.select(*fc.CANDIDATE, "n", sound.alias("scored"))


# Without a split a forest predicts about the mean of its fit rows; one split suffices.
STEP_CANDIDATES = [fc.ForestSetting(0, 1, "all"), STUMP]


@query(
    "m05_choice_on_a_step",
    f"""
    WITH {GRID}, {STEPPED}, v AS (SELECT count(*) AS n FROM stepped WHERE split = 'validation' AND y_4 IS NOT NULL)
    SELECT c.*, n FROM v, (VALUES (2, 1, 1, 'all', 1, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0, 1, 'all', 2, NULL, NULL))
      AS c(candidate_id, max_depth, min_leaf, feature_share, place, mae, rmse)
    """,
)
def choice_on_a_step(spark, sf):
    """The candidate that can split wins, without an error; the other one's is not exact."""
    scores = fc.tune_forest(stepped_features(spark, sf), "target_usd", STEP_CANDIDATES, TREES)
    place = F.when(F.col("rmse") == F.min("rmse").over(Window.partitionBy()), 1).otherwise(2)
    exact = scores.withColumn("place", place)
    return exact.select(
        *fc.CANDIDATE, "place", "n",
        *[F.when(F.col("place") == 1, F.round(c, 3)).alias(c) for c in ("mae", "rmse")],
    )


FRAME = """SELECT family, quarter, split, '{policy}' AS target_policy, y AS actual_usd,
      y_4 AS prediction_seasonal_naive, y - y_4 AS residual_seasonal_naive,
      coalesce(y, {base} + 100 * (year(period_start) * 4 + quarter(period_start)) + CAST(substr(family, 1, 1) AS INTEGER) * 10000) AS prediction_linear_regression,
      CASE WHEN y IS NOT NULL THEN 0.0::DOUBLE END AS residual_linear_regression,
      true AS forest_in_range, y IS NOT NULL AS evaluation_available,
      CASE WHEN y IS NOT NULL THEN 'evaluated' ELSE 'target_missing_prediction_only' END AS evaluation_status,
      'rolling_one_step' AS protocol
    FROM ({cte} SELECT * FROM line WHERE split <> 'train' AND y_4 IS NOT NULL)"""


def _frame_sql(*policies: str) -> str:
    bases = dict(zip(TARGETS, (0, 5_000_000)))
    return f"WITH {GRID} " + " UNION ALL ".join(
        FRAME.format(policy=p, base=bases[p], cte="WITH " + LINE.format(base=bases[p]))
        for p in policies
    )


def _frame(predictions, lines):
    """The prediction table with the fitted line in tens and the forest's range."""
    wide = lines.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"), F.col("split").alias("s"), F.col(t).alias("y")) for p, t in TARGETS.items()
    ])).alias("x")).select("x.*")
    known = wide.where("s <> 'test'").groupBy("p").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    out = predictions.join(known, F.col("p") == F.col("target_policy"))
    forest = F.col("prediction_random_forest")
    return out.select(
        "family", "quarter", "split", "target_policy", "actual_usd",
        "prediction_seasonal_naive", "residual_seasonal_naive",
        F.round("prediction_linear_regression", -1).alias("prediction_linear_regression"),
        (F.round("residual_linear_regression", -1) + 0.0).alias("residual_linear_regression"),
        F.coalesce(forest.between(F.col("low") - 1, F.col("high") + 1), F.lit(False)).alias("forest_in_range"),
        "evaluation_available", "evaluation_status", "protocol",
    )


@query("m06_rolling_one_step", _frame_sql("source"))
def rolling_one_step(spark, sf):
    ensure_checkpoint_dir(spark)
    lines = line_grid(spark, sf).checkpoint()
    rows = fc.feature_table(lines, "target_usd").checkpoint()
    predictions, _, _ = fc.rolling_one_step(rows, "target_usd", "source", SETTING, TREES)
    return _frame(predictions, lines)


@query(
    "m07_prediction_table",
    f"""
    WITH {GRID}
    SELECT family, quarter, period_start, split, 'source' AS target_policy, target_usd AS actual_usd,
      greatest(lag_4, 0.0) AS prediction_seasonal_naive, target_usd - greatest(lag_4, 0.0) AS residual_seasonal_naive,
      target_usd IS NOT NULL AS evaluation_available, true AS residuals_add_up, true AS models_predict,
      CASE WHEN target_usd IS NOT NULL THEN 'evaluated' ELSE 'target_missing_prediction_only' END AS evaluation_status,
      'rolling_one_step' AS protocol
    FROM (SELECT *, lag(target_usd, 4) OVER (PARTITION BY family ORDER BY period_start) AS lag_4 FROM grid)
    WHERE split <> 'train' AND lag_4 IS NOT NULL
    """,
)
def prediction_table(spark, sf):
    """On real money: every model predicts, and actual less prediction is the residual."""
    predictions, _, _ = fc.rolling_one_step(
        features(spark, sf), "target_usd", "source", SETTING, TREES
    )
    fits = {"residuals_add_up": F.lit(True), "models_predict": F.lit(True)}
    for m in ("linear_regression", "random_forest"):
        value, rest = F.col(f"prediction_{m}"), F.col(f"residual_{m}")
        fits["residuals_add_up"] &= rest.eqNullSafe(F.col("actual_usd") - value)
        fits["models_predict"] &= F.coalesce(value >= 0, F.lit(False))
    out = predictions.withColumns(fits)
    return out.select([c for c in out.columns if not c.endswith(("linear_regression", "random_forest"))])


@query("m08_target_policies", _frame_sql(*TARGETS))
def target_policies(spark, sf):
    ensure_checkpoint_dir(spark)
    lines = line_grid(spark, sf).checkpoint()
    settings = dict.fromkeys(TARGETS, SETTING)
    return _frame(fc.run_policies(lines, TARGETS, settings, TREES), lines)


@query(
    "m09_primary_model",
    f"""
    WITH {GRID}, {LINE.format(base=0)}
    SELECT 'linear_regression' AS model, count(*) AS n_evaluated, 0.0::DOUBLE AS rmse_usd
    FROM line WHERE split = 'validation' AND y_4 IS NOT NULL AND y IS NOT NULL
    """,
)
def primary_model(spark, sf):
    """On a straight line least squares has no error, so it must be chosen."""
    ensure_checkpoint_dir(spark)
    lines = line_grid(spark, sf).checkpoint()
    predictions = fc.run_policies(lines, {"source": "target_usd"}, {"source": SETTING}, TREES)
    return fc.select_primary(predictions).select(
        "model", "n_evaluated", F.round(F.round("rmse_usd", -1) + 0.0, 1).alias("rmse_usd")
    )


@query(
    "m10_model_diagnostics",
    f"""
    WITH {GRID}, g AS (SELECT DISTINCT family FROM grid),
    names AS (SELECT unnest(['lag_1', 'lag_2', 'lag_4', 'rolling_mean_4', 'rolling_median_4', 'rolling_std_4', 'time_index']) AS feature
      UNION ALL SELECT 'family_' || family FROM g UNION ALL SELECT 'quarter_of_year_' || q FROM range(1, 5) AS r(q))
    SELECT feature, feature = 'time_index' AS decides, 1.0::DOUBLE AS total FROM names
    """,
)
def model_diagnostics(spark, sf):
    """Only time tells a step in time: it has all importance, but for bags that lack the rows
    beside the step. Importances add up to 1."""
    train = fc.fit_rows_of(stepped_features(spark, sf), "target_usd", ["train", "validation"])
    rows = fc.diagnostics(fc.fit_forest(train, "target_usd", STUMP, TREES))
    whole = F.sum("value").over(Window.partitionBy())  # one row per feature
    return rows.select("feature", (F.col("value") > 0.9).alias("decides"), F.round(whole, 6).alias("total"))


@query(
    "m10_linear_coefficients",
    f"""
    WITH {GRID}
    SELECT 'family_' || family AS feature, 'coefficient' AS kind FROM grid GROUP BY family HAVING family > (SELECT min(family) FROM grid)
    UNION ALL SELECT 'quarter_of_year_' || q, 'coefficient' FROM range(2, 5) AS r(q)
    UNION ALL SELECT unnest(['lag_1', 'lag_2', 'lag_4', 'rolling_mean_4', 'rolling_median_4', 'rolling_std_4', 'time_index']), 'coefficient'
    """,
)
def linear_coefficients(spark, sf):
    """Names of the coefficients on real money: the first level of a category has none."""
    train = fc.fit_rows_of(features(spark, sf), "target_usd", ["train", "validation"])
    return fc.diagnostics(fc.fit_linear(train, "target_usd")).where(
        F.col("magnitude").isNotNull()
    ).select("feature", "kind")
