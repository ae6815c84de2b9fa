"""Feature table and quarterly forecasters on ``pyspark.ml``.

Features come from lags and trailing windows of earlier periods only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prizelens.functions.money import clip_zero
from prizelens.operators.joins import union_all
from prizelens.operators.quantiles import exact_quantiles
from prizelens.operators.scoring import (
    baseline_scores,
    predictions_long,
    prediction_table,
    score,
    select_best,
)
from prizelens.operators.windows import add_lags, add_trailing, time_index

NUMERIC = [
    "lag_1",
    "lag_2",
    "lag_4",
    "rolling_mean_4",
    "rolling_median_4",
    "rolling_std_4",
    "time_index",
]
CATEGORICAL = ["family", "quarter_of_year"]
FEATURES = NUMERIC + CATEGORICAL
MODELS = {
    "seasonal_naive": "Seasonal naive (t-4)",
    "linear_regression": "Linear regression",
    "random_forest": "Random forest",
}

@dataclass(frozen=True)
class ForestSetting:
    """One candidate: depth (30 is the deepest Spark grows), leaf size, features."""

    depth: int
    leaf: int
    features: str


# The six forest settings that are compared.
FOREST_GRID = [
    ForestSetting(4, 1, "sqrt"),
    ForestSetting(4, 2, "0.8"),
    ForestSetting(8, 1, "sqrt"),
    ForestSetting(8, 2, "0.8"),
    ForestSetting(30, 1, "sqrt"),
    ForestSetting(30, 2, "0.8"),
]


def feature_table(grid: DataFrame, target: str) -> DataFrame:
    """Grid (family, period_start, split, target) plus the allowed features."""
    out = add_lags(grid, "family", "period_start", target, [1, 2, 4])
    out = add_trailing(out, "family", "period_start", target)
    out = time_index(out, "family", "period_start")
    return out.withColumn("quarter_of_year", F.quarter("period_start").cast("string"))


@dataclass
class Design:
    """What was learnt from the fit rows: medians, gap indicators, category levels.

    Levels stay inside the indexer and become one sparse vector per category, so their
    number is not limited; a level that the fit rows do not have is all zeros.
    """

    medians: dict[str, float]
    indexer: StringIndexerModel
    drop_first: bool
    indicators: list[str] = field(default_factory=list)

    @property
    def levels(self) -> dict[str, tuple[str, ...]]:
        return dict(zip(CATEGORICAL, self.indexer.labelsArray))

    @property
    def gaps(self) -> list[str]:
        return [f"{c}_missing" for c in self.indicators]

    @property
    def columns(self) -> list[str]:
        first = 1 if self.drop_first else 0
        dummies = [f"{c}_{v}" for c, vs in self.levels.items() for v in vs[first:]]
        return [*self.medians, *self.gaps, *dummies]

    def apply(self, df: DataFrame) -> DataFrame:
        """Filled numbers and indicators."""
        cols = {f"{c}_missing": F.col(c).isNull().cast("double") for c in self.indicators}
        for c, m in self.medians.items():
            cols[c] = F.coalesce(F.col(c).cast("double"), F.lit(m))
        return df.withColumns(cols)

    def stages(self) -> tuple[list, list[str]]:
        """Pipeline stages for the categories, and the columns of their vectors."""
        encoder = OneHotEncoder(
            inputCols=[f"_ix_{c}" for c in CATEGORICAL],
            outputCols=[f"_oh_{c}" for c in CATEGORICAL],
            dropLast=True,  # the last index is that of unseen levels
        )
        stages, vectors = [self.indexer, encoder], []
        for c, levels in self.levels.items():
            if not self.drop_first:
                vectors.append(f"_oh_{c}")
            elif len(levels) > 1:
                stages.append(
                    VectorSlicer(
                        inputCol=f"_oh_{c}", outputCol=f"_cut_{c}", indices=list(range(1, len(levels)))
                    )
                )
                vectors.append(f"_cut_{c}")
        return stages, vectors


def learn_design(fit_rows: DataFrame, drop_first: bool, indicators: bool) -> Design:
    """Exact medians, gaps and category levels of the fit rows."""
    long = fit_rows.select(
        F.explode(
            F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in NUMERIC))
        ).alias("_x")
    ).select("_x.name", "_x.value")
    found = {r["name"]: r["median"] for r in exact_quantiles(long, ["name"], "value", {"median": 0.5}).collect()}
    gaps = fit_rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in NUMERIC]).first()
    # A feature without any value in the fit rows cannot be filled: it is left out.
    medians = {c: found[c] for c in NUMERIC if c in found}
    indexer = StringIndexer(
        inputCols=CATEGORICAL,
        outputCols=[f"_ix_{c}" for c in CATEGORICAL],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    ).fit(fit_rows)
    missing = [c for c in medians if gaps[c] > 0] if indicators else []
    return Design(medians, indexer, drop_first, missing)


@dataclass
class Fitted:
    design: Design
    model: PipelineModel

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        """Add a prediction clipped at zero; the input columns stay as they were."""
        keep = df.columns
        stash = {f"_in_{c}": F.col(c) for c in self.design.medians}
        out = self.model.transform(self.design.apply(df.withColumns(stash)))
        return out.select(
            *[
                F.col(f"_in_{c}").alias(c) if c in self.design.medians else F.col(c)
                for c in keep
            ],
            clip_zero(F.col("_prediction")).alias(name),
        )


def fit_linear(fit_rows: DataFrame, target: str) -> Fitted:
    """Median fill, dummies without the first level, scaling, least squares."""
    design = learn_design(fit_rows, drop_first=True, indicators=False)
    coded, dummies = design.stages()
    stages = [
        *coded,
        VectorAssembler(inputCols=list(design.medians), outputCol="_numbers"),
        StandardScaler(
            inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True
        ),
        VectorAssembler(inputCols=["_scaled", *dummies], outputCol="_features"),
        LinearRegression(
            featuresCol="_features",
            labelCol=target,
            predictionCol="_prediction",
            regParam=0.0,
            solver="auto",
            standardization=False,
        ),
    ]
    return Fitted(design, Pipeline(stages=stages).fit(design.apply(fit_rows)))


def fit_forest(
    fit_rows: DataFrame, target: str, setting: ForestSetting, trees: int = 500
) -> Fitted:
    """Median fill plus gap indicators, full dummies, bagged regression trees."""
    design = learn_design(fit_rows, drop_first=False, indicators=True)
    coded, dummies = design.stages()
    stages = [
        *coded,
        VectorAssembler(
            inputCols=[*design.medians, *design.gaps, *dummies], outputCol="_features"
        ),
        RandomForestRegressor(
            featuresCol="_features",
            labelCol=target,
            predictionCol="_prediction",
            numTrees=trees,
            seed=42,
            maxDepth=setting.depth,
            minInstancesPerNode=setting.leaf,
            featureSubsetStrategy=setting.features,
            maxMemoryInMB=512,
            cacheNodeIds=False,
        ),
    ]
    return Fitted(design, Pipeline(stages=stages).fit(design.apply(fit_rows)))


def fit_rows_of(featured: DataFrame, target: str, splits: Sequence[str]) -> DataFrame:
    return featured.where(
        F.col("split").isin(*splits)
        & F.col(target).isNotNull()
        & F.col("lag_4").isNotNull()
    )


def predict_rows_of(featured: DataFrame, split: str) -> DataFrame:
    return featured.where((F.col("split") == split) & F.col("lag_4").isNotNull())


CANDIDATE = ["candidate_id", "max_depth", "min_leaf", "feature_share"]


def candidate_predictions(
    featured: DataFrame,
    target: str,
    grid: Sequence[ForestSetting] = FOREST_GRID,
    trees: int = 500,
) -> DataFrame:
    """Validation rows with each candidate's prediction; the candidate is a column.

    Every candidate is fitted on the same train rows. Scores are taken from this table,
    so a choice can be repeated from stored predictions without a fit.
    """
    train = fit_rows_of(featured, target, ["train"]).persist()
    check = fit_rows_of(featured, target, ["validation"])
    parts = []
    for number, setting in enumerate(grid, start=1):
        scored = fit_forest(train, target, setting, trees).predict(check, "prediction")
        parts.append(
            scored.select(
                F.lit(number).alias("candidate_id"),
                F.lit(setting.depth).alias("max_depth"),
                F.lit(setting.leaf).alias("min_leaf"),
                F.lit(setting.features).alias("feature_share"),
                "family", "period_start", target, "prediction",
            )
        )
    train.unpersist()
    return union_all(*parts)


def candidate_scores(predictions: DataFrame, target: str) -> DataFrame:
    """Scores of all candidates in one pass, best first."""
    return baseline_scores(predictions, CANDIDATE, target).orderBy("rmse", "mae", "candidate_id")


def tune_forest(
    featured: DataFrame,
    target: str,
    grid: Sequence[ForestSetting] = FOREST_GRID,
    trees: int = 500,
) -> DataFrame:
    """Each setting fitted on train and scored on validation, best first."""
    return candidate_scores(candidate_predictions(featured, target, grid, trees), target)


def rolling_one_step(
    featured: DataFrame,
    target: str,
    policy: str,
    setting: ForestSetting,
    trees: int = 500,
    splits: Sequence[str] = ("validation", "test"),
) -> tuple[DataFrame, Fitted, Fitted]:
    """Validation is predicted from train, test from train and validation.

    Fit rows need the target and ``lag_4``; predicted rows need ``lag_4`` only.
    Returns the prediction table and the two models of the last split.
    """
    earlier = {"validation": ["train"], "test": ["train", "validation"]}
    parts, linear, forest = [], None, None
    for split in splits:
        fit_rows = fit_rows_of(featured, target, earlier[split]).persist()
        linear = fit_linear(fit_rows, target)
        forest = fit_forest(fit_rows, target, setting, trees)
        fit_rows.unpersist()
        rows = predict_rows_of(featured, split).withColumns(
            {
                "target_policy": F.lit(policy),
                "prediction_seasonal_naive": clip_zero(F.col("lag_4")),
            }
        )
        rows = linear.predict(rows, "prediction_linear_regression")
        rows = forest.predict(rows, "prediction_random_forest")
        parts.append(
            prediction_table(
                rows,
                ["family", "quarter", "period_start", "split", "target_policy"],
                target,
                list(MODELS),
            )
        )
    return union_all(*parts), linear, forest


def run_policies(
    grid: DataFrame,
    targets: dict[str, str],
    settings: dict[str, ForestSetting] | None = None,
    trees: int = 500,
) -> DataFrame:
    """The protocol for every target policy; untuned policies are tuned first."""
    parts = []
    for policy, target in targets.items():
        featured = feature_table(grid, target).persist()
        setting = (settings or {}).get(policy)
        if setting is None:
            best = tune_forest(featured, target, trees=trees).first()
            setting = FOREST_GRID[best["candidate_id"] - 1]
        predictions, _, _ = rolling_one_step(featured, target, policy, setting, trees)
        parts.append(predictions)
        featured.unpersist()
    return union_all(*parts)


def select_primary(predictions: DataFrame) -> DataFrame:
    """The model with the lowest Overall validation RMSE on the source policy."""
    rows = predictions.where(
        (F.col("split") == "validation") & (F.col("target_policy") == "source")
    )
    scores = score(
        predictions_long(rows, MODELS, "random_forest", "seasonal_naive"),
        ["model"],
        "family",
    )
    return select_best(
        scores.where(F.col("family") == "Overall"),
        [F.col("rmse_usd"), F.col("mae_usd"), F.col("model")],
    )


def diagnostics(fitted: Fitted) -> DataFrame:
    """Feature names with linear coefficients or forest importances, largest first."""
    last = fitted.model.stages[-1]
    spark = SparkSession.active()
    if hasattr(last, "coefficients"):
        kind, values = "coefficient", last.coefficients.toArray()
    else:
        kind, values = "importance", last.featureImportances.toArray()
    rows = [
        (name, kind, float(v), abs(float(v)))
        for name, v in zip(fitted.design.columns, values)
    ]
    return spark.createDataFrame(
        rows, "feature string, kind string, value double, magnitude double"
    ).orderBy(F.col("magnitude").desc(), "feature")
