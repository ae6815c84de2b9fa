"""Dates and calendar keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Date shapes found in page text.
ISO_DAY = r"(\d{4}-\d{2}-\d{2})"
DOTTED_DAY = r"(?<!\d)(\d{2}\.\d{2}\.(?:\d{4}|\d{2}))(?!\d)"

STEPS = {
    "day": "interval 1 day",
    "month": "interval 1 month",
    "quarter": "interval 3 month",
}


def parse_day(col: Column) -> Column:
    """Strict ``YYYY-MM-DD`` text to a date, else null."""
    return F.when(
        col.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(col, "yyyy-MM-dd")
    )


def range_reason(start: Column, end: Column) -> Column:
    """Reversed or unreadable ranges are flagged, never swapped."""
    return F.when(
        start.isNull() | end.isNull() | (start > end), F.lit("invalid_date")
    )


def valid_range(start: Column, end: Column) -> Column:
    return F.coalesce(start <= end, F.lit(False))


def quarter_label(day: Column) -> Column:
    """``2024Q3``."""
    return F.concat(
        F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")
    )


def period_of(day: Column, step: str) -> Column:
    """First day of the period that holds ``day``."""
    if step == "day":
        return day.cast("date")
    return F.trunc(day, step)


def shift_period(day: Column, step: str, n: int) -> Column:
    if step == "day":
        return F.date_add(day, n)
    return F.add_months(day, n * (3 if step == "quarter" else 1))


def with_calendar(df: DataFrame, date_col: str) -> DataFrame:
    """Add year, quarter, month_start and period_start (of the quarter)."""
    day = F.col(date_col)
    return df.withColumns(
        {
            "year": F.year(day),
            "quarter": quarter_label(day),
            "month_start": F.trunc(day, "month"),
            "period_start": F.trunc(day, "quarter"),
        }
    )


def month_start(year: Column, month: Column) -> Column:
    """First of the month from two numbers; fractions or bad values give null."""
    y, m = year.try_cast("decimal(12,4)"), month.try_cast("decimal(12,4)")
    whole = (y == F.floor(y)) & (m == F.floor(m)) & m.between(1, 12)
    return F.when(
        whole, F.make_date(y.try_cast("int"), m.try_cast("int"), F.lit(1))
    )


def time_split(day: Column, train_end: int, validation_end: int) -> Column:
    """train / validation / test by calendar year."""
    return (
        F.when(F.year(day) <= train_end, F.lit("train"))
        .when(F.year(day) <= validation_end, F.lit("validation"))
        .when(day.isNotNull(), F.lit("test"))
    )


def scope_hint(day: Column, low: str, high: str) -> Column:
    """in_scope / outside_scope / unknown_date."""
    return (
        F.when(day.isNull(), F.lit("unknown_date"))
        .when(day.between(F.lit(low).cast("date"), F.lit(high).cast("date")), "in_scope")
        .otherwise("outside_scope")
    )


def dates_in_text(col: Column, dotted: bool = False) -> Column:
    """Struct(first_day, last_day, n) of the dates written in free text.

    ISO dates by default; ``dotted`` reads ``DD.MM.YYYY`` and ``DD.MM.YY``
    (two-digit years belong to this century). A date that does not exist is null.
    """
    if dotted:
        found = F.transform(
            F.regexp_extract_all(col, F.lit(DOTTED_DAY), F.lit(1)),
            lambda d: F.try_to_date(
                F.concat(
                    F.substring(d, 1, 6),
                    F.when(F.length(d) == 8, F.lit("20")).otherwise(F.lit("")),
                    F.substring(d, 7, 4),
                ),
                "dd.MM.yyyy",
            ),
        )
    else:
        found = F.transform(
            F.regexp_extract_all(col, F.lit(ISO_DAY), F.lit(1)),
            lambda d: F.try_to_date(d, "yyyy-MM-dd"),
        )
    return F.struct(
        F.try_element_at(found, F.lit(1)).alias("first_day"),
        F.try_element_at(found, F.lit(-1)).alias("last_day"),
        F.coalesce(F.size(found), F.lit(0)).alias("n"),
    )


def plausible_version(
    version: Column, day: Column, first_year: dict[str, int]
) -> Column:
    """False when a version is dated before the first year it can exist."""
    ok = F.lit(True)
    for name, year in first_year.items():
        ok = F.when((version == name) & (F.year(day) < year), F.lit(False)).otherwise(ok)
    return ok
