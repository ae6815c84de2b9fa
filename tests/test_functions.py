import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from prizelens.functions import calendar as cal
from prizelens.functions import money as m
from prizelens.functions import text as t
from prizelens.functions import urls as u


def values(spark, rows, column, schema="v string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_clean_text(spark):
    rows = ["  a  \t b ", "", "   ", None, "é", "x\x1fy"]
    got = values(spark, rows, t.clean_text(F.col("v")))
    assert got == ["a b", None, None, None, "é", "x y"]


def test_name_key_folds_case(spark):
    got = values(spark, ["STRASSE", "Straße", "ABC", None], t.name_key(F.col("v")))
    assert got == ["strasse", "strasse", "abc", None]


def test_money_rounds_half_up_and_rejects(spark):
    rows = ["2.345", "0.005", "-1", "NaN", "abc", None, "1e3"]
    got = values(spark, rows, m.money(F.col("v")))
    assert got == [Decimal("2.35"), Decimal("0.01"), None, None, None, None, Decimal("1000.00")]
    reasons = values(spark, rows, m.money_reason(F.col("v")))
    assert reasons == [None, None] + ["invalid_money"] * 3 + ["missing_money", None]


def test_cents(spark):
    rows = ["$1,234.50", "1.005", "-2", "", None, "0", "7.1000"]
    assert values(spark, rows, m.to_cents(F.col("v"))) == [123450, None, None, None, None, 0, 710]
    exact = values(spark, rows, m.is_cent_exact(F.col("v")))
    assert exact == [True, False, False, False, False, True, True]


def test_usd_texts(spark):
    rows = [
        ("$350,000.00 ($3,444.00 USD)", "EUR"),
        ("$10,000.00", "USD - dollar"),
        ("$10,000.00", "EUR"),
        ("ten", "USD"),
        (None, "USD"),
    ]
    got = values(spark, rows, m.extract_usd(F.col("a"), F.col("c")), "a string, c string")
    assert got == [Decimal("3444.00"), Decimal("10000.00"), None, None, None]
    shown = values(spark, ["$ 1 000", "$5K", "5", "$1.25"], m.displayed_usd(F.col("v")))
    assert shown == [Decimal("1000.00"), None, None, Decimal("1.25")]


def test_counts_durations_ranks(spark):
    got = values(spark, ["1 234 567", "12k", ""], m.compact_int(F.col("v")))
    assert got == [1234567, None, None]
    hours = values(spark, ["12.5 h 30 m", "3h", "1 h 60 m", "h"], m.duration_hours(F.col("v")))
    assert hours == [13.0, 3.0, None, None]
    ranks = values(spark, ["3rd-4th", "1st", " win ", "none"], m.parse_rank(F.col("v")))
    assert [tuple(r) for r in ranks] == [
        (3, 4, None, None), (1, 1, None, None), (None, None, "WIN", None),
        (None, None, None, "unreadable_rank"),
    ]
    numbers = values(spark, ["1", "1.0", "0", "1.5", "x", None], m.rank_number(F.col("v")))
    assert numbers == [1, 1, None, None, None, None]


def test_dates(spark):
    rows = ["2024-02-29", "2023-02-29", "2024-2-1", "20240101", None]
    got = values(spark, rows, cal.parse_day(F.col("v")))
    assert got == [datetime.date(2024, 2, 29), None, None, None, None]
    text = ["01.02.24 – 03.02.2024", "31.02.2024", "none", "101.02.24"]
    days = values(spark, text, cal.dates_in_text(F.col("v"), dotted=True))
    assert [(r.first_day, r.last_day, r.n) for r in days] == [
        (datetime.date(2024, 2, 1), datetime.date(2024, 2, 3), 2),
        (None, None, 1), (None, None, 0), (None, None, 0),
    ]
    split = values(
        spark, ["2023-12-31", "2024-01-01", "2025-01-01", None],
        cal.time_split(F.col("v").cast("date"), 2023, 2024),
    )
    assert split == ["train", "validation", "test", None]


def test_urls(spark):
    rows = [
        ("https://a.org/x/y", "../z?q=1"), ("https://a.org/x/y", "/k#f"),
        ("https://a.org/x/y", "//b.org/m"), ("https://a.org/x/y", "?p=2"),
        ("https://a.org/x/y", "w"), ("https://a.org/x/y", "http://c.org"),
        ("https://a.org", "w"), ("https://a.org/x/y?k=1", "#top"),
    ]
    got = values(spark, rows, u.resolve(F.col("b"), F.col("h")), "b string, h string")
    assert got == [
        "https://a.org/z?q=1", "https://a.org/k#f", "https://b.org/m",
        "https://a.org/x/y?p=2", "https://a.org/x/w", "http://c.org",
        "https://a.org/w", "https://a.org/x/y?k=1#top",
    ]
    canon = values(
        spark,
        ["https://E.com/tournaments/a/b/?x#y", "http://e.com/tournaments/a", "https://f.com/tournaments/a"],
        u.canonical_url(F.col("v"), ["e.com"], "/tournaments/"),
    )
    assert canon == ["https://e.com/tournaments/a/b", None, None]


def test_labels(spark):
    assert values(spark, ["Head Coach", "coaches", "Coachella", "substitute"], t.is_supplement(F.col("v"))) == [
        True, True, False, True,
    ]
    assert values(spark, [" True", "FALSE", "1", None], t.to_bool(F.col("v"))) == [True, False, None, None]
    got = values(spark, [-1.0, 0.0, 2.0, None], t.sign_label(F.col("v"), "n", "p", "z"), "v double")
    assert got == ["n", "z", "p", "z"]
    clipped = values(spark, [-1.0, None, 2.0], m.clip_zero(F.col("v")), "v double")
    assert clipped == [0.0, None, 2.0]


def test_text_outside_the_gate_is_in_normal_form():
    import unicodedata

    import regex

    from prizelens.functions.text import MAY_COMPOSE

    gate = regex.compile(MAY_COMPOSE.replace("\\x{10000}-\\x{10FFFF}", "\\U00010000-\\U0010FFFF"))
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]):
        if not gate.match(c):
            for base in ("a", "A", "e", "\u0915", "\u1100", "\uac00"):
                assert unicodedata.is_normalized("NFC", base + c), hex(ord(c))
