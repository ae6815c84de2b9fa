"""Money, counts and durations. Additive money is integer cents throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
WIDE = "decimal(38,18)"

# Text shapes of displayed money, counts and durations.
USD_IN_BRACKETS = r"(?i)\(\s*\$\s*([\d,]+(?:\.\d+)?)\s+USD\s*\)"
DISPLAYED_USD = r"^\$(\d+(?:\.\d{1,2})?)$"
DURATION = r"(?i)^\s*(\d+(?:\.\d+)?)\s*h(?:\s*(\d+)\s*m)?\s*$"
BLANK = r"(?U)\s+"


def money(col: Column) -> Column:
    """Non-negative amount rounded half-up to 0.01, else null."""
    value = col.try_cast(MONEY)
    return F.when(value >= 0, value)


def money_reason(col: Column) -> Column:
    """``missing_money`` / ``invalid_money`` / null when the amount is usable."""
    return F.when(col.isNull(), F.lit("missing_money")).when(
        money(col).isNull(), F.lit("invalid_money")
    )


def plain_amount(col: Column) -> Column:
    """Amount text without ``$`` and thousands commas."""
    return F.trim(F.translate(col.cast("string"), "$,", ""))


def is_cent_exact(col: Column) -> Column:
    """True when the amount is non-negative and has no fraction of a cent."""
    value = plain_amount(col).try_cast(WIDE)
    return F.coalesce((value >= 0) & (value == F.round(value, 2)), F.lit(False))


def to_cents(col: Column) -> Column:
    """Amount to integer cents; null for bad, negative or fractional cents."""
    value = plain_amount(col).try_cast(WIDE)
    return F.when(
        is_cent_exact(col), (value.try_cast("decimal(30,2)") * 100).try_cast("bigint")
    )


def amount_cents(amount: Column) -> Column:
    """An amount of two decimals, as ``extract_usd`` gives it, to integer cents."""
    return (amount * 100).cast("bigint")


def money_cents(col: Column) -> Column:
    """Text of an amount to integer cents, half-up; null where ``money`` is null."""
    return (money(col) * 100).cast("bigint")


def cents(col: Column) -> Column:
    """A double amount column to integer cents."""
    return F.round(col * 100).cast("bigint")


def cents_to_usd(col: Column) -> Column:
    return col.cast("double") / F.lit(100.0)


def log10p1(col: Column) -> Column:
    return F.log10(F.lit(1.0) + col)


def clip_zero(col: Column) -> Column:
    """Negative becomes zero, null stays null (``greatest`` would skip it)."""
    return F.when(col < 0, F.lit(0.0)).otherwise(col.cast("double"))


def extract_usd(text: Column, currency: Column) -> Column:
    """USD amount in display text.

    A bracketed ``($x USD)`` wins; a plain amount counts only when the currency
    label starts with USD. Anything else is null.
    """
    # In a lambda every mention is computed anew, so the pattern is asked for only where there
    # is a bracket, and the amount is written once.
    bracketed = F.nullif(F.regexp_extract(text, USD_IN_BRACKETS, 1), F.lit(""))
    bracketed = F.when(text.contains("("), F.translate(bracketed, ",", ""))
    plain = F.when(F.upper(currency).startswith("USD"), plain_amount(text))
    amount = F.coalesce(bracketed, plain).try_cast(MONEY)
    return F.try_element_at(F.filter(F.array(amount), lambda a: a >= 0), F.lit(1))


def displayed_usd(text: Column) -> Column:
    """``$`` and digits only; K/M suffixes and other currencies are null."""
    compact = F.regexp_replace(text, BLANK, "")
    # Leading zeros go first: a number of any length then casts by its value.
    amount = F.regexp_replace(F.regexp_extract(compact, DISPLAYED_USD, 1), r"^0+(?=\d)", "")
    return F.when(compact.rlike(DISPLAYED_USD), amount.try_cast(MONEY))


def compact_int(text: Column) -> Column:
    """Whole number with blanks (also non-breaking) as separators."""
    compact = F.regexp_replace(text, BLANK, "")
    return F.when(compact.rlike(r"^\d+$"), compact.try_cast("bigint"))


def duration_hours(text: Column) -> Column:
    """``12.5 h 30 m`` to hours; minutes must stay below 60."""
    hours = F.nullif(F.regexp_extract(text, DURATION, 1), F.lit("")).try_cast("double")
    minutes = F.coalesce(
        F.nullif(F.regexp_extract(text, DURATION, 2), F.lit("")).try_cast("int"),
        F.lit(0),
    )
    return F.when(hours.isNotNull() & (minutes < 60), hours + minutes / F.lit(60.0))


def rank_number(col: Column) -> Column:
    """Whole rank of at least 1, else null."""
    value = col.try_cast("decimal(38,6)")
    return F.when((value == F.floor(value)) & (value >= 1), value.try_cast("bigint"))


def rank_number_reason(col: Column) -> Column:
    return F.when(col.isNotNull() & rank_number(col).isNull(), F.lit("invalid_rank"))


def parse_rank(col: Column) -> Column:
    """Struct(rank_min, rank_max, outcome, error) from a rank label."""
    numbers = F.transform(
        F.regexp_extract_all(col, F.lit(r"(\d+)"), F.lit(1)),
        lambda part: part.try_cast("int"),
    )
    label = F.upper(F.trim(col))
    outcome = F.when(label.isin("WIN", "LOSE"), label)
    # Bound to a name, the numbers are found once, in a lambda, too.
    parsed = F.transform(
        F.array(numbers),
        lambda found: F.struct(
            F.array_min(found).alias("rank_min"),
            F.array_max(found).alias("rank_max"),
            outcome.alias("outcome"),
            F.when(
                F.coalesce(F.size(found), F.lit(0)) > 0, F.lit(None).cast("string")
            )
            .when(outcome.isNotNull(), F.lit(None).cast("string"))
            .otherwise(F.lit("unreadable_rank"))
            .alias("error"),
        ),
    )
    return F.element_at(parsed, 1)


def rank_reason(rank_min: Column, rank_max: Column, outcome: Column) -> Column:
    """Both or neither rank, in order; without ranks the outcome is required."""
    return (
        F.when(rank_min.isNull() != rank_max.isNull(), F.lit("incomplete_rank"))
        .when(rank_min > rank_max, F.lit("invalid_rank_range"))
        .when(
            rank_min.isNull()
            & ~F.coalesce(outcome.isin("WIN", "LOSE"), F.lit(False)),
            F.lit("missing_rank_and_outcome"),
        )
    )


def prize_status(difference: Column, tolerance) -> Column:
    """matched / rounding_difference / needs_review from a money difference."""
    return (
        F.when(difference == 0, F.lit("matched"))
        .when(F.abs(difference) <= F.lit(tolerance), F.lit("rounding_difference"))
        .when(difference.isNotNull(), F.lit("needs_review"))
    )
