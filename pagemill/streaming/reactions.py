"""Reaction events as streams: counting, routing, effects that happen once, and pins, all on Spark's keyed state.

Three queries follow one another over folders: ``start_routing`` numbers the events and routes them, ``start_effects``
lets each effect through once, ``start_pins`` keeps the newest pins of a channel. Each has its own checkpoint, so each
goes on where it stopped. What a state keeps ends: counts and effects of a message are forgotten when nothing has
happened to it for ``keep_ms``; a channel keeps as many pins as the limit says.

The events that one micro-batch holds of one message are numbered together, in order of time, by one task: they are
bounded by the files of a micro-batch (``max_files`` of the source), not by the message.
"""

from __future__ import annotations

import bisect
import sys
from collections.abc import Callable, Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..operators.reactions import PIN_LIMIT, Route, route_counted
from ..session import shared_dir

# The state handlers run in Python workers and travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EVENT_FIELDS = [
    ("event_id", "bigint"),
    ("ts", "timestamp"),
    ("user_id", "bigint"),
    ("user_is_bot", "boolean"),
    ("message_id", "bigint"),
    ("channel_id", "string"),
    ("guild_id", "string"),
    ("emoji_name", "string"),
    ("emoji_id", "string"),
]
COUNTED = ", ".join(f"{name} {kind}" for name, kind in EVENT_FIELDS) + ", n bigint"
ROUTED_FIELDS = [
    ("event_id", "bigint"),
    ("ts", "timestamp"),
    ("guild_id", "string"),
    ("channel_id", "string"),
    ("message_id", "bigint"),
    ("user_id", "bigint"),
    ("emoji_name", "string"),
    ("n", "bigint"),
    ("action", "string"),
]
ROUTED = ", ".join(f"{name} {kind}" for name, kind in ROUTED_FIELDS)
PIN_LOG = "channel_id string, message_id bigint, at bigint, op string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
KEEP_MS = 30 * 24 * 3600 * 1000
ALL_NOW = {"availableNow": True}


def event_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """File source for the event feed; a queue source with the same columns can take its place.

    The path may be a folder or a single file. Given as a pattern it serves for both, while a plain
    path must be a folder.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(pattern)


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state on local disk with remote snapshots; the heap store holds all keys in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _start(spark: SparkSession, writer: DataStreamWriter, trigger: dict | None, path: str | None = None) -> StreamingQuery:
    """Start a query. One that runs until its input is used up has no empty batches: with them, state that ends by
    the clock would keep it going."""
    use_rocksdb(spark)
    trigger = trigger or ALL_NOW
    before = spark.conf.get(NO_DATA_BATCHES)
    spark.conf.set(NO_DATA_BATCHES, str("availableNow" not in trigger).lower())
    try:
        return writer.trigger(**trigger).start(path)
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)


# --- counts -------------------------------------------------------------------------------------


class MessageCounts(StatefulProcessor):
    """Numbers the reactions of one message by emoji. The state is one number per emoji."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "emoji array<string>, n array<bigint>", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timer_values: Any) -> Iterator[Row]:
        known = self.counts.get()
        counts = dict(zip(known[0], known[1], strict=True)) if known else {}
        for row in sorted(rows, key=in_order):
            emoji = row["emoji_key"]
            counts[emoji] = counts.get(emoji, 0) + 1
            yield Row(**{name: row[name] for name, _ in EVENT_FIELDS}, n=counts[emoji])
        self.counts.update((list(counts), list(counts.values())))

    def close(self) -> None:
        pass


def in_order(row: Row) -> tuple:
    """Time, then id; rows without one come first."""
    return (row["ts"] is not None, row["ts"] or 0, row["event_id"] is not None, row["event_id"] or 0)


def counted_stream(events: DataFrame, keep_ms: int = KEEP_MS) -> DataFrame:
    """Events with ``n``, the count of their (message, emoji) at arrival; bots are included."""
    typed = events.select(*[F.col(name).cast(kind).alias(name) for name, kind in EVENT_FIELDS])
    keyed = typed.withColumn("emoji_key", F.coalesce("emoji_id", "emoji_name", F.lit("")))
    return keyed.groupBy("message_id").transformWithState(MessageCounts(keep_ms), COUNTED, "Append", "ProcessingTime")


def start_counting(
    spark: SparkSession,
    events: DataFrame,
    out: str,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    keep_ms: int = KEEP_MS,
) -> StreamingQuery:
    """Write every event with its count."""
    use_rocksdb(spark)
    writer = counted_stream(events, keep_ms).writeStream.format("parquet").outputMode("append")
    return _start(spark, writer.option("checkpointLocation", checkpoint or shared_dir(spark, "counting-state")), trigger, out)


# --- routing ------------------------------------------------------------------------------------


def start_routing(
    spark: SparkSession,
    events: DataFrame,
    load_settings: Callable[[], DataFrame],
    out: str,
    checkpoint: str | None = None,
    routes: list[Route] | None = None,
    after_batch: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
    keep_ms: int = KEEP_MS,
) -> StreamingQuery:
    """Number a stream of reactions and route it into ``out/routed/batch_id=N``.

    Settings are read again for every micro-batch, so changes need no flush. A micro-batch is computed once; a
    replayed one overwrites its own folder. ``after_batch`` gets the routed rows as read back from there.
    ``trigger`` is that of the stream writer; by default all there is is read and the query ends.
    """
    use_rocksdb(spark)

    def route(batch: DataFrame, batch_id: int) -> None:
        folder = f"{out}/routed/batch_id={batch_id}"
        route_counted(batch, load_settings(), routes).write.mode("overwrite").parquet(folder)
        if after_batch:
            after_batch(batch.sparkSession.read.schema(ROUTED).parquet(folder), batch_id)

    writer = counted_stream(events, keep_ms).writeStream.foreachBatch(route)
    return _start(spark, writer.option("checkpointLocation", checkpoint or shared_dir(spark, "routing-state")), trigger)


def folder_stream(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    """The folders ``path/batch_id=N`` of an earlier query as a stream; there may be none yet."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{path}/batch_id=*")


# --- effects ------------------------------------------------------------------------------------


class FirstActions(StatefulProcessor):
    """Lets the first event of each action of a message through. The state is the actions that have happened."""

    def __init__(self, once: tuple[str, ...], keep_ms: int) -> None:
        self.once = once
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "actions array<string>", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timer_values: Any) -> Iterator[Row]:
        known = self.done.get()
        done = set(known[0]) if known else set()
        for row in sorted(rows, key=in_order):
            if row["action"] not in done:
                yield Row(**{name: row[name] for name, _ in ROUTED_FIELDS})
            if row["action"] in self.once:
                done.add(row["action"])
        self.done.update((sorted(done),))

    def close(self) -> None:
        pass


def effect_stream(routed: DataFrame, once: tuple[str, ...] = ("pin", "link"), keep_ms: int = KEEP_MS) -> DataFrame:
    """Routed events without repeats: a message is pinned and scraped once, bookmarks go to everybody who asks."""
    typed = routed.select(*[F.col(name).cast(kind).alias(name) for name, kind in ROUTED_FIELDS])
    return typed.groupBy("message_id").transformWithState(FirstActions(once, keep_ms), ROUTED, "Append", "ProcessingTime")


def start_effects(
    spark: SparkSession,
    out: str,
    checkpoint: str | None = None,
    once: tuple[str, ...] = ("pin", "link"),
    run: Callable[[DataFrame, int], None] | None = None,
    trigger: dict | None = None,
    keep_ms: int = KEEP_MS,
) -> StreamingQuery:
    """Write the effects of ``out/routed`` into ``out/effects/batch_id=N`` and hand them to ``run``.

    ``run`` gets the rows as read back; a replayed batch hands it the same ones again under the same number.
    """
    use_rocksdb(spark)

    def act(batch: DataFrame, batch_id: int) -> None:
        folder = f"{out}/effects/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(folder)
        if run:
            run(batch.sparkSession.read.schema(ROUTED).parquet(folder), batch_id)

    writer = effect_stream(folder_stream(spark, f"{out}/routed", ROUTED), once, keep_ms).writeStream.foreachBatch(act)
    return _start(spark, writer.option("checkpointLocation", checkpoint or shared_dir(spark, "effects-state")), trigger)


# --- pins ---------------------------------------------------------------------------------------


class NewestPins(StatefulProcessor):
    """The newest pins of one channel. A pin beyond the limit unpins the oldest one. The state is the pins kept."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pins = handle.getValueState("pins", "at array<bigint>, message_id array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timer_values: Any) -> Iterator[Row]:
        known = self.pins.get()
        kept = sorted(zip(known[0], known[1], strict=True)) if known else []
        for pin in sorted((row["at"], row["message_id"]) for row in rows):
            bisect.insort(kept, pin)
            yield Row(channel_id=key[0], message_id=pin[1], at=pin[0], op="pin")
            if len(kept) > self.limit:
                oldest = kept.pop(0)
                yield Row(channel_id=key[0], message_id=oldest[1], at=oldest[0], op="unpin")
        self.pins.update(([pin[0] for pin in kept], [pin[1] for pin in kept]))

    def close(self) -> None:
        pass


def pin_stream(effects: DataFrame, channels: DataFrame, limit: int = PIN_LIMIT) -> DataFrame:
    """Pins and unpins of text channels, in the order in which they happen. ``channels`` has (channel_id, type)."""
    text = channels.where("type = 'text'").select("channel_id")
    pins = effects.where("action = 'pin' and ts is not null").join(text, "channel_id", "left_semi")
    timed = pins.select("channel_id", "message_id", F.unix_micros("ts").alias("at"))
    log = timed.groupBy("channel_id").transformWithState(NewestPins(limit), PIN_LOG, "Append", "None")
    return log.select("channel_id", "message_id", F.timestamp_micros("at").alias("pinned_at"), "op")


def start_pins(
    spark: SparkSession,
    channels: DataFrame,
    out: str,
    checkpoint: str | None = None,
    limit: int = PIN_LIMIT,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the pins and unpins that the effects of ``out/effects`` ask for into ``out/pins``."""
    use_rocksdb(spark)
    writer = pin_stream(folder_stream(spark, f"{out}/effects", ROUTED), channels, limit).writeStream.format("parquet").outputMode("append")
    return _start(spark, writer.option("checkpointLocation", checkpoint or shared_dir(spark, "pins-state")), trigger, f"{out}/pins")


def pinned_now(log: DataFrame) -> DataFrame:
    """Messages pinned at the end of a log of pins and unpins."""
    balance = F.sum(F.when(F.col("op") == "pin", 1).otherwise(-1))
    kept = log.groupBy("channel_id", "message_id").agg(balance.alias("balance"), F.max("pinned_at").alias("pinned_at"))
    return kept.where("balance > 0").drop("balance")


# --- batch forms --------------------------------------------------------------------------------


def first_actions(routed: DataFrame, done: DataFrame | None = None, keys: tuple[str, ...] = ("message_id", "action")) -> DataFrame:
    """The first event per message and action, without those done in earlier batches.

    Events above the threshold keep coming; the effect happens once.
    """
    names = [name for name in routed.columns if name not in keys]
    first = routed.groupBy(*keys).agg(F.min(F.struct("ts", "event_id", *[n for n in names if n not in ("ts", "event_id")])).alias("e"))
    rows = first.select(*keys, "e.*")
    return rows if done is None else rows.join(done.select(*keys), list(keys), "left_anti")


def once_stream(routed: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Streaming form of ``first_actions``: repeats within the watermark are dropped."""
    return routed.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["message_id", "action"])
