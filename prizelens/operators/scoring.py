"""Baselines, prediction tables in long form, scores and error analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prizelens.functions.money import clip_zero
from prizelens.functions.text import sign_label
from prizelens.operators.stats import pct
from prizelens.operators.windows import add_lags, global_rank

PROTOCOL = "rolling_one_step"


def _squared(error: Column) -> Column:
    """As a double, since squares of cents pass the range of whole numbers."""
    error = error.cast("double")
    return error * error


def seasonal_naive(
    grid: DataFrame, family: str, period: str, x: str, lag: int = 4, clipped=False
) -> DataFrame:
    """Prediction = the value ``lag`` periods earlier on the complete grid."""
    out = add_lags(grid, family, period, x, [lag])
    value = F.col(f"lag_{lag}")
    return out.withColumn(
        "prediction", clip_zero(value) if clipped else value
    ).drop(f"lag_{lag}")


def baseline_scores(
    predicted: DataFrame, by: Sequence[str], x: str, prediction: str = "prediction"
) -> DataFrame:
    """n, MAE and RMSE over rows where target and prediction exist."""
    error = F.col(prediction) - F.col(x)
    return predicted.groupBy(*by).agg(
        F.count(error).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(_squared(error))).alias("rmse"),
    )


def availability(actual: Column) -> dict[str, Column]:
    """Evaluation columns of a prediction row."""
    return {
        "evaluation_available": actual.isNotNull(),
        "evaluation_status": F.when(actual.isNotNull(), F.lit("evaluated")).otherwise(
            F.lit("target_missing_prediction_only")
        ),
        "protocol": F.lit(PROTOCOL),
    }


def prediction_table(
    df: DataFrame, keys: Sequence[str], actual: str, models: Sequence[str]
) -> DataFrame:
    """Wide table: actual, ``prediction_m`` and ``residual_m`` per model."""
    return df.select(
        *keys,
        F.col(actual).alias("actual_usd"),
        *[f"prediction_{m}" for m in models],
        *[
            (F.col(actual) - F.col(f"prediction_{m}")).alias(f"residual_{m}")
            for m in models
        ],
        *[c.alias(n) for n, c in availability(F.col(actual)).items()],
    )


def predictions_long(
    wide: DataFrame, models: dict[str, str], primary: str, baseline: str
) -> DataFrame:
    """One row per period and model with label, residual, errors and direction."""
    fixed = [c for c in wide.columns if not c.startswith(("prediction_", "residual_"))]
    renamed = wide.select(*fixed, *[F.col(f"prediction_{m}").alias(m) for m in models])
    long = renamed.unpivot(fixed, list(models), "model", "predicted_usd")
    label = F.lit(None).cast("string")
    for name, text in models.items():
        label = F.when(F.col("model") == name, F.lit(text)).otherwise(label)
    residual = F.col("actual_usd") - F.col("predicted_usd")
    return long.withColumns(
        {
            "model_label": label,
            "residual_usd": residual,
            "absolute_error_usd": F.abs(residual),
            "squared_error_usd2": residual * residual,
            "error_direction": sign_label(
                residual, "overprediction", "underprediction", "not_evaluated_or_exact"
            ),
            "is_primary_model": F.col("model") == primary,
            "is_baseline_model": F.col("model") == baseline,
        }
    )


def _with_overall(df: DataFrame, by: Sequence[str], family: str, aggs: list[Column]):
    keys = [*by, family]
    out = df.groupingSets([keys, list(by)], *keys).agg(
        *aggs, F.grouping(family).alias("_overall")
    )
    return out.withColumn(
        family, F.when(F.col("_overall") == 1, F.lit("Overall")).otherwise(F.col(family))
    ).drop("_overall")


def score(
    long: DataFrame, by: Sequence[str], family: str, min_r2_rows: int = 4
) -> DataFrame:
    """MAE, RMSE, coverage and R² per group, and over all families as Overall.

    Overall is computed from the rows, never as a mean of family scores.
    """
    ok = F.col("evaluation_available")
    actual = F.when(ok, F.col("actual_usd"))
    error = F.when(ok, F.col("actual_usd") - F.col("predicted_usd"))
    n = F.col("n_evaluated")
    out = _with_overall(
        long,
        by,
        family,
        [
            F.count(F.lit(1)).alias("n_total"),
            F.count_if(ok).alias("n_evaluated"),
            F.avg(F.abs(error)).alias("mae_usd"),
            F.sqrt(F.avg(_squared(error))).alias("rmse_usd"),
            F.sum(_squared(error)).alias("_sse"),
            F.var_pop(actual).alias("_var"),
        ],
    )
    return out.withColumns(
        {
            "coverage_pct": pct(n, F.col("n_total")),
            "r2_diagnostic": F.when(
                n >= min_r2_rows,
                F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_var") * n),
            ),
        }
    ).drop("_sse", "_var")


def forecast_summary(long: DataFrame, by: Sequence[str], family: str) -> DataFrame:
    """Dashboard summary: totals on evaluated and on all periods, errors."""
    ok = F.col("evaluation_available")
    residual = F.when(ok, F.col("residual_usd"))
    out = _with_overall(
        long,
        by,
        family,
        [
            F.count(F.lit(1)).alias("total_periods"),
            F.count_if(ok).alias("evaluated_periods"),
            F.sum(F.when(ok, F.col("actual_usd"))).alias("actual_usd"),
            F.sum(F.when(ok, F.col("predicted_usd"))).alias("predicted_evaluated_usd"),
            F.sum("predicted_usd").alias("predicted_all_usd"),
            F.avg(residual).alias("mean_residual_usd"),
            F.avg(F.abs(residual)).alias("mae_usd"),
            F.sqrt(F.avg(_squared(residual))).alias("rmse_usd"),
        ],
    )
    return out.withColumn(
        "coverage_pct", pct(F.col("evaluated_periods"), F.col("total_periods"))
    )


def error_analysis(long: DataFrame, tie: Sequence[str]) -> DataFrame:
    """Evaluated rows of one model ranked by absolute error, with error share."""
    rows = long.where(F.col("evaluation_available"))
    ranked = global_rank(
        rows,
        [F.col("absolute_error_usd").desc(), *[F.col(c) for c in tie]],
        "absolute_error_rank",
    )
    total = rows.agg(F.sum("absolute_error_usd").alias("_total"))
    one = F.lit(1).alias("_one")
    return (
        ranked.select("*", one)
        .join(F.broadcast(total.select("*", one)), "_one")
        .withColumn(
            "absolute_error_share_pct",
            pct(F.col("absolute_error_usd"), F.col("_total")),
        )
        .drop("_one", "_total")
    )


def error_share(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Absolute error per group and its percent of the total."""
    rows = long.where(F.col("evaluation_available"))
    sums = rows.groupBy(*by).agg(F.sum("absolute_error_usd").alias("abs_error_usd"))
    total = rows.agg(F.sum("absolute_error_usd").alias("_total"))
    one = F.lit(1).alias("_one")
    return (
        sums.select("*", one)
        .join(F.broadcast(total.select("*", one)), "_one")
        .withColumn("error_share_pct", pct(F.col("abs_error_usd"), F.col("_total")))
        .drop("_one", "_total")
    )


def select_best(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The first row in a stated order."""
    return df.orderBy(*order).limit(1)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The ``k`` first rows; Spark keeps ``k`` per task and merges."""
    return df.orderBy(*order).limit(k)
