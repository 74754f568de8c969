"""Ordered outbox and Markdown files.

An outbox lies in folders ``root/batch_id=B/outbox``, one per run or micro-batch. A batch counts once its marker
``root/commits/batch_id=B`` is there, which is written last: readers take committed batches only, a run that broke off
leaves nothing to be read, and a batch that is done is not done again. What earlier batches delivered is left out of
later ones by its key, so no chunk goes out twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cap_bytes

OUTBOX_KEY = ["message_id", "seq"]


def write_outbox(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Write chunks so that each message's rows lie together and in order."""
    chunks.repartition("message_id").sortWithinPartitions(*OUTBOX_KEY).write.mode(mode).parquet(path)


def unsent(chunks: DataFrame, outbox: DataFrame) -> DataFrame:
    """Chunks whose key is not in the outbox yet."""
    return chunks.join(outbox.select(*OUTBOX_KEY), OUTBOX_KEY, "left_anti")


def batch_folder(root: str, batch: int | str) -> str:
    return f"{root}/batch_id={batch}"


def committed(spark: SparkSession, root: str) -> list[str]:
    """Batches that are done: one small row each."""
    # The empty folder makes the path exist; an existing one is left as it is.
    spark.createDataFrame([], "done string").write.mode("ignore").parquet(f"{root}/commits/batch_id=none")
    marks = spark.read.schema("done string, batch_id string").parquet(f"{root}/commits")
    return sorted(row["done"] for row in marks.select("done").distinct().collect())


def commit(spark: SparkSession, root: str, batch: int | str) -> None:
    spark.createDataFrame([(str(batch),)], "done string").coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/batch_id={batch}")


def deliver(chunks: DataFrame, root: str, batch: int | str) -> None:
    """Write the chunks that no committed batch has delivered; the caller commits the batch."""
    spark = chunks.sparkSession
    before = [f"{batch_folder(root, done)}/outbox" for done in committed(spark, root) if done != str(batch)]
    new = unsent(chunks, spark.read.schema(chunks.schema).parquet(*before)) if before else chunks
    write_outbox(new, f"{batch_folder(root, batch)}/outbox", mode="overwrite")


def delivered(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All chunks of committed batches."""
    paths = [f"{batch_folder(root, done)}/outbox" for done in committed(spark, root)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_markdown(bundles: DataFrame, path: str, mode: str = "append") -> None:
    """Export bundles as ``(filename, body)`` with bodies under the byte cap."""
    bundles.select("filename", cap_bytes(F.col("body")).alias("body")).write.mode(mode).parquet(path)
