"""Text clean-up, name keys, identifiers and flags as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Every code point that Python's ``str.split`` treats as a blank, and those of
# them that are not the plain space.
ODD_BLANKS = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = f"[ {ODD_BLANKS}]"
# What a single plain blank replaces; a blank that is one already is left alone.
BLANKS = f"[{ODD_BLANKS}]{BLANK}*+| {BLANK}++"
# The rare ones among them, and a few ranges that hold these and little else.
RARE_ASCII = r"[\x0b\x0c\x1c-\x1f]"
NEAR_RARE = r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u3000]"
# Nothing below the first combining mark changes under NFC or joins another character.
FROM_FIRST_MARK = r"[\u0300-\x{10FFFF}]"
# Characters that NFC may change or join to others: marks, Hangul letters, and the blocks
# that hold characters with a canonical form of their own. All others stay as they are.
MAY_COMPOSE = (
    r"[\p{M}\u0374\u037E\u0387\u0958-\u0DDF\u0F43-\u0FB9\u1000-\u11FF\u1B00-\u1B4F\u1F00-\u1FFF"
    r"\u2000-\u2001\u2126\u212A-\u212B\u2329-\u232A\u2ADC\uF900-\uFAFF\uFB1D-\uFB4F\x{10000}-\x{10FFFF}]"
)

# Page titles that mark an access check instead of content.
CHALLENGE_TITLES = "just a moment|access denied|attention required"

# Fixed value: team names that are staff or stand-ins, not a team.
SUPPLEMENT_PATTERN = r"(?i)\bcoach(?:es)?\b|\bsubstitut(?:e|es)\b"


@F.arrow_udf(StringType())
def _compose(values: pa.Array) -> pa.Array:
    return pa.array((nfc(v.as_py()) for v in values), pa.string())


@F.arrow_udf(StringType())
def _fold(values: pa.Array) -> pa.Array:
    return pa.array((casefold(v.as_py()) for v in values), pa.string())


@F.arrow_udf(ArrayType(StringType()))
def _compose_all(lists: pa.Array) -> pa.Array:
    return pa.array((x and [nfc(v) for v in x] for x in lists.to_pylist()), lists.type)


@F.arrow_udf(ArrayType(StringType()))
def _fold_all(lists: pa.Array) -> pa.Array:
    return pa.array((x and [casefold(v) for v in x] for x in lists.to_pylist()), lists.type)


def nfc(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFC", text)


def casefold(text: str | None) -> str | None:
    return None if text is None else text.casefold()


def is_ascii(col: Column) -> Column:
    """As many bytes as characters."""
    return F.octet_length(col) == F.length(col)


def may_compose(col: Column) -> Column:
    """Whether NFC could change the text, by tests of rising cost."""
    return ~is_ascii(col) & col.rlike(FROM_FIRST_MARK) & col.rlike(MAY_COMPOSE)


def compose(col: Column) -> Column:
    """Unicode NFC. Text that NFC cannot change never reaches Python: it is sent as null."""
    return F.coalesce(_compose(F.when(may_compose(col), col)), col)


def _where_needed(texts: Column, needed, udf) -> Column:
    """``udf`` on the texts of an array that need it, null at all others; empty where none does,
    and then nothing reaches Python."""
    hard = F.when(F.exists(texts, needed), F.transform(texts, lambda x: F.when(needed(x), x)))
    return F.coalesce(udf(hard), F.array().cast("array<string>"))


def squeeze(col: Column) -> Column:
    """Collapse runs of blanks, trim, empty becomes null.

    Line ends and tabs are replaced byte by byte; a pattern runs only over texts that hold
    a rarer blank or, after that, two blanks in a row.
    """
    plain = col
    for c in "\n\r\t":
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    rare = F.when(is_ascii(col), col.rlike(RARE_ASCII)).otherwise(col.rlike(NEAR_RARE))
    single = (
        F.when(rare, F.regexp_replace(col, BLANKS, " "))
        .when(plain.contains("  "), F.regexp_replace(plain, " {2,}", " "))
        .otherwise(plain)
    )
    return F.nullif(F.trim(single), F.lit(""))


def clean_text(col: Column) -> Column:
    """NFC, single blanks, trimmed; empty becomes null."""
    return squeeze(compose(col))


def clean_texts(texts: Column) -> Column:
    """``clean_text`` of every item of an array."""
    done = _where_needed(texts, may_compose, _compose_all)
    return F.zip_with(texts, done, lambda x, y: squeeze(F.coalesce(y, x)))


def name_key(col: Column) -> Column:
    """Case-folded key for name equality (``ß`` equals ``ss``)."""
    return F.coalesce(_fold(F.when(~is_ascii(col), col)), F.lower(col))


def name_keys(texts: Column) -> Column:
    """``name_key`` of every item of an array."""
    done = _where_needed(texts, lambda x: ~is_ascii(x), _fold_all)
    return F.zip_with(texts, done, lambda x, y: F.coalesce(y, F.lower(x)))


def is_supplement(col: Column) -> Column:
    """True for coach / substitute rows."""
    return col.rlike(SUPPLEMENT_PATTERN)


def strict_quality(note: Column, eligible: Column) -> Column:
    """No note and eligible; a null eligibility counts as not eligible."""
    return (F.coalesce(note, F.lit("")) == "") & F.coalesce(eligible, F.lit(False))


def to_bool(col: Column) -> Column:
    """``true``/``false`` text to boolean; anything else is null (see ``checks``)."""
    text = F.lower(F.trim(col.cast("string")))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def namespaced_id(source: str, col: Column) -> Column:
    return F.concat(F.lit(f"{source}:"), col.cast("string"))


def placement_key(parent: Column, team_id: Column, folded_name: Column) -> Column:
    """Struct(placement_id, key_basis): by team id where known, else by name."""
    named = team_id.isNotNull()
    key = F.when(named, F.concat(F.lit("id:"), team_id.cast("string"))).otherwise(
        F.concat(F.lit("name:"), folded_name)
    )
    return F.struct(
        F.sha2(F.concat(parent.cast("string"), F.lit("|"), key), 256).alias(
            "placement_id"
        ),
        F.when(named, F.lit("source_team_id"))
        .otherwise(F.lit("tournament_and_team_name"))
        .alias("key_basis"),
    )


def page_title(html: Column) -> Column:
    """Text of the first ``<title>``, blanks collapsed."""
    return squeeze(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def is_challenge(html: Column) -> Column:
    """True when the page title marks an access check."""
    return F.coalesce(
        F.lower(page_title(html)).rlike(CHALLENGE_TITLES), F.lit(False)
    )


def sign_label(col: Column, negative: str, positive: str, zero: str) -> Column:
    """Label by sign; null takes the zero label."""
    return (
        F.when(col < 0, F.lit(negative)).when(col > 0, F.lit(positive)).otherwise(zero)
    )


def label_or(col: Column, default: str) -> Column:
    """Null and empty text become ``default``."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))
