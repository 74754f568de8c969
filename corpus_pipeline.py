"""Cleaning a corpus of documents in five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns documents (doc_id, text, lang, source, n_chars), from the
mixing on with their place in the mix (mix_slot, mixed), the last one tokens. Other columns of the input are not
carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bottomk, language, mixing, pieces, secret_scan
from pagemill.llm.common import batch_rows, sample_bucket, written

#: The vocabulary of the last stage, read by the driver.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Rows of a batch that goes to a Python worker for near-duplicates: whole texts and their shingles are held at once.
BATCH_ROWS = 2000
#: The same for the last stage, whose workers hold the vocabulary's tables beside one block of texts.
TEXT_ROWS = 500
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document's place in the order of the mix, and whether its source's target holds it or it is surplus.
PLACE = {"mix_slot": "long", "mixed": "boolean"}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that the model rejects go. ``lang`` becomes the predicted one."""
    model = language.fit(docs.where(sample_bucket(F.col("doc_id"), 5) != 0))
    told = language.predict(docs, model, ["doc_id", "source", "n_chars", "text"])
    return told.where("not rejected").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id; five words a shingle, 0.8 or more.

    Rows that share a doc_id are documents of their own where their texts differ: each gets a number beyond all
    doc_ids, so one of a group with a doc_id to itself stays first. Repeated rows are one document. Rows without a
    doc_id stay, as do texts without words. An empty table gives no rows.
    """
    plain = docs.select(COLUMNS)
    ids = plain.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    # Written, so that its size is known when it meets the texts: mostly there are few or none.
    shared = written(ids.where("rows > 1").select("doc_id", F.lit(True).alias("is_shared")), "shared")
    met = plain.where("doc_id is not null").join(shared, "doc_id", "left")
    own = F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    numbered = met.where("is_shared is null").select(*COLUMNS, F.col("doc_id").alias("number")).union(
        met.where("is_shared").dropDuplicates(["doc_id", "text"]).select(*COLUMNS, own.alias("number"))
    )
    with batch_rows(spark, BATCH_ROWS):
        found = bottomk.near_duplicates(numbered.select(F.col("number").alias("doc_id"), "text"), bottomk.Sketching(width=5))
        gone = written(found.where("not kept").select(F.col("doc_id").alias("number")).distinct(), "gone")
    return numbered.join(gone, "number", "left_anti").select(COLUMNS).union(plain.where("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by their kind; ``n_chars`` follows."""
    scanned = secret_scan.scan_secrets(docs, COLUMNS[:1] + COLUMNS[2:], redact=True)
    changed = F.length("spans") > 0
    return scanned.select(
        "doc_id",
        F.col("text_masked").alias("text"),
        "lang",
        "source",
        F.when(changed, F.length("text_masked").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; what a source has beyond its target follows after it.

    Files keep no order, so each document's place goes with it, as ``mix_slot``; ``mixed`` is false for what follows.
    """
    params = mixing.Mix()
    weights = mixing.supply_weights(docs, "source", params)
    mixed = mixing.mix(docs.select(COLUMNS), "source", "doc_id", weights, params)
    return mixed.orderBy(F.col("mix_slot").asc_nulls_last()).select(*COLUMNS, *PLACE)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, its place in the mix, and whether they decode to it.

    Whoever reads the tokens in the order of ``mix_slot`` reads the mix; documents that were not mixed have no place.
    """
    vocabulary = pieces.Vocabulary.load(PIECES)
    # Written between the two, so that a task has one Python worker with the vocabulary's tables and not two. Texts end
    # there: their digests tell whether the ids decode to them.
    place = [F.col(c) if c in docs.columns else F.lit(None).cast(kind).alias(c) for c, kind in PLACE.items()]
    with batch_rows(spark, TEXT_ROWS):
        encoded = pieces.encode(docs.select("doc_id", "lang", "source", *place, "text"), vocabulary)
        ids = written(encoded.select("doc_id", "lang", "source", *PLACE, "token_ids", _digest(F.translate("text", pieces.SPACE, " "))), "encoded")
        return written(_checked(pieces.decode(ids, vocabulary)), "tokens")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256).alias("digest")


def _checked(decoded: DataFrame) -> DataFrame:
    """The tokens, and whether they decode to the text they come from."""
    same = _digest(F.col("decoded")) == F.col("digest")
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        *PLACE,
        F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"),
        "token_ids",
        F.coalesce(same, F.lit(True)).alias("round_trip"),
    )


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: No stage but the mixing can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
