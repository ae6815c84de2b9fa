"""Descriptive release: the KPI table and the dashboard evidence.

Metrics are a registry: each names its aggregate, unit and note. All metrics of a source
table are worked out in one pass (families and the total as grouping sets) and come out as
rows. Only medians and the largest share of a group need a pass of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prizelens.functions.money import cents_to_usd
from prizelens.operators.joins import union_all
from prizelens.operators.quantiles import exact_quantiles
from prizelens.operators.stats import country_totals, pct, pearson
from prizelens.operators.windows import top_n

ALL = "All"
COLUMNS = ["section", "family", "metric", "period", "value", "text", "unit", "note"]


@dataclass(frozen=True)
class Metric:
    """An aggregate ``value`` (a number, or a text where ``text``) with its labels.

    ``overall`` gives it for the whole table, ``each`` per family. ``note`` and ``period`` may
    be aggregates too.
    """

    section: str
    name: str | Column
    unit: str
    note: str | Column
    value: Column
    period: str | Column = ""
    text: bool = False
    overall: bool = False
    each: bool = True

    def row(self) -> Column:
        value = F.lit(None).cast("double") if self.text else self.value.cast("double")
        text = self.value.cast("string") if self.text else F.lit(None).cast("string")
        fields = {
            "section": self.section, "metric": self.name, "period": self.period,
            "value": value, "text": text, "unit": self.unit, "note": self.note,
        }
        return F.struct(
            F.lit(self.overall).alias("overall"), F.lit(self.each).alias("each"),
            *[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in fields.items()],
        )


def measured(df: DataFrame, metrics: Sequence[Metric], family: str = "family") -> DataFrame:
    """The metrics of one table as rows, in one aggregate over families and the whole."""
    rows = df.groupingSets([[family], []], family).agg(
        F.grouping(family).alias("_all"), F.array(*[m.row() for m in metrics]).alias("_rows")
    )
    wanted = F.when(F.col("_all") == 1, F.col("_m.overall")).otherwise(F.col("_m.each"))
    label = F.when(F.col("_all") == 1, F.lit(ALL)).otherwise(F.col(family).cast("string"))
    return rows.select(label.alias("family"), "_all", F.explode("_rows").alias("_m")).where(
        wanted
    ).select(*[F.col("family") if c == "family" else F.col(f"_m.{c}").alias(c) for c in COLUMNS])


@dataclass(frozen=True)
class Release:
    """The tables of a release; those that are absent give no metrics.

    parents: family, start_date, pool_cents, strict, reconciled. children: family.
    attention: family, month_start, hours. countries: family, country_code, country_name,
    prize_cents of reconciled parents. panel: family, hours, pool. grid: family, quarter,
    target_usd. errors: family, quarter, absolute_error_usd of the primary model.
    """

    name: str
    stage: str
    parents: DataFrame | None = None
    children: DataFrame | None = None
    attention: DataFrame | None = None
    countries: DataFrame | None = None
    panel: DataFrame | None = None
    grid: DataFrame | None = None
    errors: DataFrame | None = None
    year: int = 2025
    largest_errors: int = 10
    extra: dict[str, tuple[DataFrame, tuple[Metric, ...]]] = field(default_factory=dict)


def parent_metrics(year: int) -> list[Metric]:
    """Over one row per (family, year), to which parents are reduced first."""
    pool, share = F.sum("pool_cents"), pct(F.sum("strict_cents"), F.sum("pool_cents"))
    covered = pct(F.sum("reconciled_cents"), F.sum("pool_cents"))
    one = {"overall": True, "each": False}
    return [
        Metric("scope", "tournaments", "rows", "one row per tournament", F.sum("n"), **one),
        Metric("scope", "total_source_pool", "USD", "nominal, not inflation-adjusted", cents_to_usd(pool), **one),
        Metric("scope", "earliest_tournament", "date", "first day in scope", F.min("first"), text=True, **one),
        Metric("scope", "latest_tournament", "date", "source coverage not verified", F.max("last"), text=True, **one),
        Metric("quality", "strict_pool_retained", "percent", "what the strict filter keeps", share, **one),
        Metric("quality", "country_pool_coverage", "percent", "of the source pool, not the market", covered, **one),
        Metric("family", "tournaments", "rows", "observed tournaments", F.sum("n")),
        Metric("family", "source_pool", "USD", "nominal source total", cents_to_usd(pool)),
        Metric("family", "strict_pool_retained", "percent", "sensitivity to the quality policy", share),
        Metric("family", "least_country_coverage", "percent", "lowest year of reconciled money",
               F.min(pct(F.col("reconciled_cents"), F.col("pool_cents")))),
        Metric("family", "tournaments_of_year", "rows", "may reflect incomplete coverage",
               F.coalesce(F.sum(F.when(F.col("year") == year, F.col("n"))), F.lit(0)), period=str(year)),
        Metric("countries", "country_pool_coverage", "percent", "reconciled over source money", covered, "all observed"),
    ]


def by_year(parents: DataFrame) -> DataFrame:
    """Parents per (family, year): the one pass over them that sums need."""
    zero = F.lit(0).cast("bigint")
    return parents.groupBy("family", F.year("start_date").alias("year")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("pool_cents").alias("pool_cents"),
        F.coalesce(F.sum(F.when(F.col("strict"), F.col("pool_cents"))), zero).alias("strict_cents"),
        F.coalesce(F.sum(F.when(F.col("reconciled"), F.col("pool_cents"))), zero).alias("reconciled_cents"),
        F.min("start_date").alias("first"),
        F.max("start_date").alias("last"),
    )


def counted(section: str, name: str, unit: str, note: str) -> list[Metric]:
    return [Metric(section, name, unit, note, F.count(F.lit(1)), overall=True, each=False)]


def attention_metrics() -> list[Metric]:
    span = F.concat_ws(" to ", F.min("month_start"), F.max("month_start"))
    return [
        *counted("scope", "attention_observations", "family-months", "main category, not per tournament"),
        Metric("family", "attention_months", "months", span, F.count(F.lit(1))),
    ]


def panel_metrics() -> list[Metric]:
    both = F.col("hours").isNotNull() & F.col("pool").isNotNull()
    n = F.count(F.when(both, 1))
    return [Metric(
        "attention", "pearson_hours_pool", "coefficient",
        F.concat(F.lit("descriptive, n="), n), pearson("_hours", "_pool"), "matched periods",
    )]


def complete_pairs(panel: DataFrame) -> DataFrame:
    """Hours and pool as doubles, null together."""
    both = F.col("hours").isNotNull() & F.col("pool").isNotNull()
    return panel.withColumns({f"_{c}": F.when(both, F.col(c).cast("double")) for c in ("hours", "pool")})


def grid_metrics(year: int) -> list[Metric]:
    quarters = [f"{year}Q{q}" for q in range(1, 5)]
    absent = F.col("target_usd").isNull()
    listed = F.array_join(F.array_compact(F.array(*[
        F.max(F.when(absent & (F.col("quarter") == q), F.lit(q))) for q in quarters
    ])), " | ")
    return [
        Metric("forecast", "missing_quarters", "quarters", "never imputed as zero",
               F.when(listed == "", F.lit("no missing quarters")).otherwise(listed), str(year), text=True),
        Metric("prizes", "total_source_pool", "USD", "sum of observed quarters", F.sum("target_usd"), "all observed"),
        Metric("prizes", "peak_quarter_pool", "USD", "largest observed quarter", F.max("target_usd"),
               F.max_by("quarter", F.struct("target_usd", "quarter"))),
    ]


def _rows(df: DataFrame, section: str, metric, period, value, unit: str, note: str) -> DataFrame:
    """Rows of the KPI table from a small table with ``family``."""
    def column(c):
        return c if isinstance(c, Column) else F.lit(c)

    return df.select(
        F.lit(section).alias("section"), F.col("family").cast("string").alias("family"),
        column(metric).alias("metric"), column(period).alias("period"),
        value.cast("double").alias("value"), F.lit(None).cast("string").alias("text"),
        F.lit(unit).alias("unit"), F.lit(note).alias("note"),
    )


def kpi_table(release: Release) -> DataFrame:
    """Section, family, metric, period, value or text, unit and note of a release.

    Numbers stand in ``value``, texts and dates in ``text``. ``release.extra`` adds tables with
    metrics of their own.
    """
    r, parts = release, []
    if r.parents is not None:
        spark = r.parents.sparkSession
        names = [("release_folder", r.name, "newest release"), ("release_stage", r.stage, "coverage not verified")]
        parts.append(spark.createDataFrame(
            [("release", ALL, n, "", None, t, "text", note) for n, t, note in names],
            "section string, family string, metric string, period string, value double, "
            "text string, unit string, note string",
        ))
        parts.append(measured(by_year(r.parents), parent_metrics(r.year)))
        median = exact_quantiles(r.parents, ["family"], "pool_cents", {"q": 0.5})
        parts.append(_rows(median, "family", "median_pool", "", cents_to_usd(F.col("q")), "USD", "typical tournament"))
    if r.children is not None:
        parts.append(measured(r.children, counted("scope", "placements", "rows", "accepted team results")))
    if r.attention is not None:
        parts.append(measured(r.attention, attention_metrics()))
    if r.countries is not None:
        parts.append(measured(r.countries, counted("scope", "country_observations", "rows", "reconciled tables only")))
        shares = country_totals(r.countries, "family", "country_code", "country_name", "prize_cents")
        first = top_n(shares, ["family"], [F.desc("prize_cents"), F.asc("country_code")], 1, "_rank")
        parts.append(_rows(
            first, "countries", F.concat(F.lit("top_country_"), F.col("country_code"), F.lit("_share")),
            "all observed", F.col("share_pct"), "percent", "share of reconciled money",
        ))
    if r.panel is not None:
        parts.append(measured(complete_pairs(r.panel), panel_metrics()))
        hours = r.panel.groupBy("family").agg(F.count("hours").alias("n"))
        median = exact_quantiles(r.panel, ["family"], "hours", {"q": 0.5}).join(hours, "family")
        parts.append(_rows(
            median, "attention", "median_hours", F.concat(F.lit("n="), "n"), F.col("q"), "hours", "per period",
        ))
    if r.grid is not None:
        parts.append(measured(r.grid, grid_metrics(r.year)))
    if r.errors is not None:
        worst = r.errors.where("absolute_error_usd IS NOT NULL").orderBy(
            F.desc("absolute_error_usd"), "family", "quarter"
        ).limit(r.largest_errors)
        parts.append(_rows(
            worst, "errors", "absolute_error", F.col("quarter"), F.col("absolute_error_usd"), "USD",
            "largest errors of the primary model",
        ))
    parts += [measured(df, metrics) for df, metrics in r.extra.values()]
    return union_all(*parts)
