"""The dealt operators as named queries over the driver tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prizelens.llm.common import stored, table, word_count
from prizelens.llm.conversations import damaged, repair_audit
from prizelens.llm.extraction import extract_text
from prizelens.llm.lexical import ranked_search
from prizelens.llm.linededup import dedup_lines
from prizelens.llm.mixing import mix, with_copies
from prizelens.llm.neardup import near_duplicates
from prizelens.llm.packing import pack, pieces
from prizelens.llm.pieces import decoded, encoded
from prizelens.llm.quality import quality_verdicts
from prizelens.llm.token_counts import count_tokens
from prizelens.llm.token_files import byte_bpe_encoder, read_documents, write_ids
from prizelens.llm.vectorgraph import linked_vectors
from prizelens.llm.warc import round_trip
from prizelens.session import new_run_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


BYTE_BPE = "byte_bpe_50k.json"


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every whole text. Text null: 0."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = public_tokenizers.path(BYTE_BPE)
    out = count_tokens(docs, F.col("text"), path, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT rid, i, ws[i : i + 2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (
          SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM tri
          QUALIFY count(*) OVER (PARTITION BY rid, k) > 1) GROUP BY rid),
m AS (SELECT rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
             coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
s AS (SELECT rid, lang, source, measure, least_spread,
             (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) AS bucket, v
      FROM (SELECT rid, lang, source, unnest([
              {'measure': 'symbol_share', 'least_spread': 40, 'v': CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END},
              {'measure': 'dup_line_share', 'least_spread': 50, 'v': CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END},
              {'measure': 'repeat_share', 'least_spread': 50, 'v': CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END},
              {'measure': 'word_length', 'least_spread': 500, 'v': CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END}
            ], recursive := true) FROM b WHERE NOT base_failed)),
g AS (SELECT lvl, lang, source, measure, least_spread, bucket, count(*) AS n FROM (
        SELECT 1 AS lvl, lang, source, measure, least_spread, bucket FROM s
        UNION ALL SELECT 2, lang, NULL, measure, least_spread, bucket FROM s
        UNION ALL SELECT 3, NULL, NULL, measure, least_spread, bucket FROM s) GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, measure ORDER BY bucket) AS upto,
             sum(n) OVER (PARTITION BY lvl, lang, source, measure) AS rows_ FROM g),
q AS (SELECT lvl, lang, source, measure, any_value(least_spread) AS least_spread, max(rows_) AS rows_,
             min(bucket) FILTER (100 * upto >= 25 * rows_) AS q25, min(bucket) FILTER (100 * upto >= 75 * rows_) AS q75
      FROM u GROUP BY ALL),
f AS (SELECT *, q75 + 8 * greatest(q75 - q25, least_spread) AS fence FROM q),
verdict AS (SELECT s.rid, bool_and(s.v <= CASE WHEN a.rows_ >= 200 THEN a.fence WHEN l.rows_ >= 200 THEN l.fence ELSE c.fence END) AS inside
  FROM s JOIN f a ON a.lvl = 1 AND a.measure = s.measure AND a.lang IS NOT DISTINCT FROM s.lang AND a.source IS NOT DISTINCT FROM s.source
         JOIN f l ON l.lvl = 2 AND l.measure = s.measure AND l.lang IS NOT DISTINCT FROM s.lang
         JOIN f c ON c.lvl = 3 AND c.measure = s.measure GROUP BY s.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       base_failed, NOT base_failed AND coalesce(inside, false) AS kept
FROM b LEFT JOIN verdict USING (rid)
"""


@query("op9_quality_rules", QUALITY_SQL)
def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality_verdicts(table(spark, sf, "documents"))


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix takes from every document, with its source's target."""
    docs, size = table(spark, sf, "documents"), word_count(F.col("text"))
    copies, targets = mix(docs, "doc_id", "source", size)
    sources = targets.select(F.col("stratum").alias("_t"), "source_size", "target")
    shared = copies.join(sources, F.col("stratum").eqNullSafe(F.col("_t")))
    rows = with_copies(docs.select("doc_id", "source", "text"), stored(shared, "mix-copies"), "doc_id", "source", size)
    return rows.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies",
    )


@query("op3_warc")
def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    """One WARC record per page, written and read back."""
    return round_trip(table(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of all documents written to files and read back."""
    path = public_tokenizers.path(BYTE_BPE)
    folder = new_run_dir(spark, "ids")
    encode = byte_bpe_encoder(path, public_tokenizers.PATTERN)
    files = write_ids(table(spark, sf, "documents"), "doc_id", "text", folder, encode, 16)
    return read_documents(files, folder)


@query("op4_minhash_neardup")
def op4_minhash_neardup(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents with similar sets of two-word shingles."""
    return near_duplicates(table(spark, sf, "documents"), k=2, percent=80)


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document less the passages that stand in earlier ones."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dedup_lines(docs)


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", "n_chars")


PIECE_BPE = "piece_bpe_32k.model"


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every whole text with merge-dropout, and whether they decode to the text."""
    path = public_tokenizers.path(PIECE_BPE)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ids = docs.withColumn("ids", encoded(F.col("text"), F.col("doc_id"), path))
    back = ids.withColumn("back", decoded(F.col("ids"), path))
    return back.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"),
        F.col("back").eqNullSafe(F.col("text")).alias("lossless"),
    )


VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(x, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.x, r.c FROM r JOIN l ON l.y = r.x)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = v.vec_id) AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) ON x = vec_id
"""


@query("op6_embedding_neardup", VECTOR_SQL)
def op6_embedding_neardup(spark: SparkSession, sf: str) -> DataFrame:
    """Links and components of vectors of one label with a cosine of at least 0.98."""
    return linked_vectors(table(spark, sf, "embeddings"))


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    rows = table(spark, sf, "conversations")
    kind = rows.schema["conv_id"].dataType
    out = repair_audit(damaged(rows))
    return out.withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", "conv_id")


SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
             lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ts FROM documents),
q AS (SELECT item_id, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
             lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS t FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t, n_docs),
i AS (SELECT rid, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * len(ts) * n_docs) // n_terms)))) AS impact
      FROM p JOIN w USING (t) JOIN d USING (rid), s),
f AS (SELECT item_id, rid, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (t) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank,
             doc_id, score FROM f JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


@query("op12_lexical_search", SEARCH_SQL)
def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 20)


@query("op13_packing")
def op13_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 2048 tokens."""
    encode = byte_bpe_encoder(public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)
    rows = pieces(pack(table(spark, sf, "documents"), "doc_id", "text", encode, 2048))
    return rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
