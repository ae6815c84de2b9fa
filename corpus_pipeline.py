"""A corpus pipeline over ``documents``: quality rules, line dedup, near-duplicate removal,
mixing to target weights, then SentencePiece pieces.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet in the shared folder and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``. ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prizelens.llm.common import WORD, stored, table, word_count
from prizelens.llm.linededup import dedup_lines
from prizelens.llm.mixing import mixed_documents
from prizelens.llm.neardup import without_near_duplicates
from prizelens.llm.pieces import decoded, encoded
from prizelens.llm.quality import quality_filter

PIECES = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document go; so does a document that is nothing
    but such passages."""
    had_words = F.coalesce(F.rlike(F.col("text"), F.lit(WORD)), F.lit(False))
    out = dedup_lines(docs.withColumn("_had", had_words))
    has_words = F.coalesce(F.rlike(F.col("text"), F.lit(WORD)), F.lit(False))
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.where(~F.col("_had") | has_words).withColumn("n_chars", changed).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity of 0.8 or more."""
    return without_near_duplicates(docs, k=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, so rows may repeat."""
    return mixed_documents(docs, "doc_id", "source", word_count(F.col("text")))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their texts and whether these decode to the text."""
    path = public_tokenizers.path(PIECES)
    out = docs.withColumn("ids", encoded(F.col("text"), F.col("doc_id"), path))
    out = out.withColumn("_back", decoded(F.col("ids"), path))
    return out.select(
        *docs.columns, "ids", F.size("ids").cast("long").alias("n_pieces"),
        F.col("_back").eqNullSafe(F.col("text")).alias("lossless"),
    )


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("mixing", mixing),
    ("pieces", pieces),
]
# Rolling hashes, MinHash and merge-dropout have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
