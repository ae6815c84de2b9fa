"""Quality rules with adaptive thresholds from mergeable quantile sketches.

The measures of a text are integers. Each group of texts (language and source) keeps a
sketch per measure: counts in log-linear buckets, exact below ``2 * STEPS`` and within
one part in ``STEPS`` above. Such counts add up: tasks merge theirs before the shuffle,
and the sketches of a language's sources merge into the language's own, which stands in
for sources too small to judge by themselves. A threshold is a robust fence, the upper
quartile plus a multiple of the spread, so a share of junk does not move it and clean
texts stay inside it. The verdict joins the thresholds back. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prizelens.llm.common import BLANKS, WORD, stored, words

STEPS = 16  # buckets per doubling
TEXT_GROUP = 16 << 20  # bytes of texts a task holds while it writes them
MIN_ROWS = 200  # texts below which a source takes its language's thresholds
MIN_WORDS = 50
FENCE = 8  # spreads above the upper quartile
# Measure and the least spread its fence assumes, in thousandths.
MEASURES = {
    "symbol_share": 40,
    "dup_line_share": 50,
    "repeat_share": 50,
    "word_length": 500,
}


def text_measures(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with the base counts of each text.

    ``n_words``; ``word_chars`` (code points in words); ``n_symbols`` (``#*$%&|<>``);
    ``n_dup_lines`` (lines with a word that equal an earlier line); ``n_lines`` (lines
    with a word); ``n_repeat_words`` (words in three-word windows that occur at least
    twice, the first included); ``base_failed``. A null text counts as empty.

    Windows are compared by a 64-bit hash, sorted with their positions inside the row,
    so the work grows with n log n and nothing of a text is shuffled.
    """
    body = F.coalesce(text, F.lit(""))
    own = ("_words", "_lines", "_marks", "_sorted", "_at")
    df = docs.withColumns({
        "_words": words(body),
        "_lines": F.filter(F.split(body, "\n"), lambda x: F.rlike(x, F.lit(WORD))),
        "word_chars": F.length(F.regexp_replace(body, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
    })
    n = F.size("_words")
    mark = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    df = df.withColumns({
        "n_words": n.cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_marks": F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), mark)).otherwise(
            F.array().cast("array<bigint>")
        ),
    })
    placed = F.transform("_marks", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_marks")) < F.size("_marks"), F.sort_array(placed)
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    same = lambda x, j: F.coalesce(F.get("_sorted", j)["h"] == x["h"], F.lit(False))
    df = df.withColumn(
        "_at",
        F.sort_array(F.transform(
            F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]
        )),
    )
    gap = lambda p, i: F.least(F.lit(3), p - F.coalesce(F.get("_at", i - 1), F.lit(-3)))
    df = df.withColumn(
        "n_repeat_words",
        F.aggregate(F.transform("_at", gap), F.lit(0).cast("long"), lambda a, x: a + x),
    )
    return df.drop(*own).withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def shares() -> dict[str, Column]:
    """The measures in thousandths of words or lines, as whole numbers."""
    per = lambda top, base: F.when(
        F.col(base) > 0, F.expr(f"(1000L * {top}) div {base}")
    ).otherwise(F.lit(0)).cast("long")
    return {
        "symbol_share": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "word_length": per("word_chars", "n_words"),
    }


def bucket(value: Column) -> Column:
    """The least value of the sketch bucket of ``value``: the leading bits, zeros behind."""
    low = 2 * STEPS
    bits = F.greatest(F.length(F.bin(value)) - F.length(F.bin(F.lit(low - 1))), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, bits), bits)


def sketches(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group, measure and bucket with its count; counts of the same bucket add."""
    pairs = F.explode(F.array(*(
        F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES
    )))
    return (
        df.select(*keys, pairs.alias("p")).select(*keys, "p.measure", "p.bucket")
        .groupBy(*keys, "measure", "bucket").agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and upper fence per group and measure, read off the sketch."""
    by = Window.partitionBy(*keys, "measure")
    upto = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumns({"upto": F.sum("n").over(upto), "rows": F.sum("n").over(by)})
    at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("rows"), F.col("bucket")))
    quarts = ranked.groupBy(*keys, "measure").agg(
        F.max("rows").alias("rows"), at(25).alias("q25"), at(75).alias("q75")
    )
    least = F.create_map(*(F.lit(x) for pair in MEASURES.items() for x in pair))
    spread = F.greatest(F.col("q75") - F.col("q25"), least[F.col("measure")].cast("long"))
    return quarts.select(*keys, "measure", "rows", (F.col("q75") + FENCE * spread).alias("fence"))


def thresholds(df: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (language, source) with a ``max_<measure>`` each.

    Sources with fewer than ``MIN_ROWS`` rows take the fence of their language, languages
    with fewer that of all texts; each level's sketch is the sum of those below it.
    """
    one = sketches(df, [lang, source])
    per_lang = one.groupBy(lang, "measure", "bucket").agg(F.sum("n").alias("n"))
    total = per_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    a, b, c = fences(one, [lang, source]), fences(per_lang, [lang]), fences(total, [])
    b = b.select(F.col(lang).alias("_lang"), F.col("measure").alias("_m"),
                 F.col("rows").alias("b_rows"), F.col("fence").alias("b_fence"))
    c = c.select(F.col("measure").alias("_cm"), F.col("fence").alias("c_fence"))
    joined = a.join(b, a[lang].eqNullSafe(b["_lang"]) & (a["measure"] == b["_m"])).join(
        F.broadcast(c), a["measure"] == c["_cm"]  # one row per measure
    )
    fence = (
        F.when(F.col("rows") >= MIN_ROWS, F.col("fence"))
        .when(F.col("b_rows") >= MIN_ROWS, F.col("b_fence"))
        .otherwise(F.col("c_fence"))
    )
    return joined.groupBy(lang, source).agg(
        *(F.max(F.when(F.col("measure") == m, fence)).alias(f"max_{m}") for m in MEASURES)
    )


def with_verdict(df: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``df`` with ``kept``: not failed by the base rules and inside every fence."""
    lim = limits.withColumnsRenamed({lang: "_lang", source: "_source"})
    out = df.join(
        lim, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source"))
    )
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & (F.col(m) <= F.col(f"max_{m}"))
    kept = ~F.col("base_failed") & inside
    return out.withColumn("kept", kept).drop("_lang", "_source", *(f"max_{m}" for m in MEASURES))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    return text_measures(docs, F.col(text)).withColumns(shares())


def quality_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, the base counts, ``base_failed`` and ``kept``.

    Documents that the base rules fail do not shape the thresholds. Null or empty texts
    have no words and fail; null languages and sources are groups of their own; repeated
    rows are judged alike; a table without rows gives none. Other columns are not read.
    """
    slim = stored(measured(docs.select(key, "lang", "source", text), text).drop(text), "measures")
    limits = thresholds(slim.where(~F.col("base_failed")))
    # A group with failed documents only has no threshold and nothing to judge.
    judged = with_verdict(slim.where(~F.col("base_failed")), limits)
    failed = slim.where("base_failed").withColumn("kept", F.lit(False))
    return judged.unionByName(failed).select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns as they are.

    Documents are stored once with their measures: thresholds then read the measures
    alone, and no filter is pushed into the array expressions that compute them.
    """
    packed = docs.select(F.struct("*").alias("_row"), "lang", "source", text)
    measures = stored(measured(packed, text).drop(text), "measured", TEXT_GROUP)
    seen = measures.where(~F.col("base_failed"))
    limits = stored(thresholds(seen.drop("_row")), "thresholds")
    return with_verdict(seen, limits).where("kept").select("_row.*")
