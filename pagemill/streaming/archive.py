"""Link reactions drive the archive job, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.archive import run_archive
from .reactions import start_routing


def start_archiving(
    spark: SparkSession,
    events: DataFrame,
    load_settings: Callable[[], DataFrame],
    messages: DataFrame,
    pages: DataFrame,
    archived_at: Column,
    out: str,
    checkpoint: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Route reactions and archive the messages whose link action fired in the batch, under ``out/archive``.

    Each micro-batch is a batch of the archive: a replay of a committed one does nothing, and a message that is asked
    for again, long after its reactions were forgotten, is not delivered again.
    """

    def archive(routed: DataFrame, batch_id: int) -> None:
        asked = routed.where(F.col("action") == "link").select("message_id")
        wanted = messages.join(asked, "message_id", "left_semi")
        run_archive(spark, wanted, pages, archived_at, f"{out}/archive", batch_id)

    return start_routing(spark, events, load_settings, out, checkpoint, after_batch=archive, trigger=trigger)
