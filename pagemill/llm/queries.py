"""The operators of this folder over the test tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import bisectors, bottomk, grid_codes, language, mixing, neighbours, pieces, pii, quality, secret_scan, toxicity, warc, wrappers
from pagemill.llm.common import read, sample_bucket
from pagemill.llm.vector_checks import clustering_sql, coding_sql
from pagemill.llm.whole_vectors import digest

PIECES = corpus_pipeline.PIECES


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and whether they decode to it (a space mark in a text decodes to a space)."""
    vocabulary = pieces.Vocabulary.load(PIECES)
    docs = pieces.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    same = F.col("decoded") == F.translate("text", pieces.SPACE, " ")
    return pieces.decode(docs, vocabulary).select(
        "doc_id", F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"), "token_ids", F.coalesce(same, F.lit(True)).alias("round_trip")
    )


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read(spark, sf_dir, "documents"), ["doc_id"])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no capture times: pages count as captured a second apart, in the order of their ids."""
    pages = read(spark, sf_dir, "pages").withColumn("captured", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")))
    return warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", sample_bucket(F.col("doc_id"), 5) == 0)
    model = language.fit(docs.where("not held_out"))
    return language.predict(docs, model, ["doc_id", "held_out"])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", sample_bucket(F.col("doc_id"), 3) == 1)
    labels = read(spark, sf_dir, "labels").where(sample_bucket(F.col("doc_id"), 3) != 1)
    return toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id", "held_out"])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents"), ["doc_id"])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix; targets follow the sources' supply, up to a quarter each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    params = mixing.Mix()
    return mixing.mix(docs, "source", "doc_id", mixing.supply_weights(docs, "source", params), params)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.references(docs), ["doc_id"])


def op10_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(read(spark, sf_dir, "documents"))


def op11_grid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = grid_codes.compress(read(spark, sf_dir, "embeddings"))
    return coded.select(
        "vec_id", grid_codes.code_text().alias("code"), "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256")
    )


def op12_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(read(spark, sf_dir, "pages"))


def op13_bisectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisectors.cluster(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_pieces": op1_pieces,
    "op2_neighbours": op2_neighbours,
    "op3_pii": op3_pii,
    "op4_warc": op4_warc,
    "op5_language": op5_language,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_bottomk": op10_bottomk,
    "op11_grid_codes": op11_grid_codes,
    "op12_wrappers": op12_wrappers,
    "op13_bisectors": op13_bisectors,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op4_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest,
                   octet_length(encode(coalesce(html, ''))) AS n
            FROM pages
        ), f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
        FROM f
    """,
    "op11_grid_codes": coding_sql(),
    # The articles of the test pages stand in one element each and hold headings, paragraphs, breaks and bold text.
    "op12_wrappers": r"""
        WITH article AS (
            SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS inner_html FROM pages
        ), bare AS (
            SELECT page_id, url, regexp_replace(regexp_replace(inner_html, '<br>|</?(?:p|h1)>', ' ', 'g'), '<[^>]*>', '', 'g') AS marked
            FROM article
        ), plain AS (
            SELECT page_id, url, trim(regexp_replace(
                regexp_replace(regexp_replace(marked, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text
            FROM bare
        )
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM plain
    """,
    "op13_bisectors": clustering_sql(),
}
