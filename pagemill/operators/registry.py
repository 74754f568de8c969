"""Commands, buttons and channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import channel_slug

# Commands with whether they complete their argument, and the one button.
COMMANDS = [("join", True), ("flush", False), ("ping", False)]
DELETE_BUTTON = "deleteMessage"


def command_registry(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{name}', {str(flag).lower()})" for name, flag in COMMANDS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, has_autocomplete)")


def dispatch_commands(interactions: DataFrame, registry: DataFrame) -> DataFrame:
    """Command interactions whose command is registered."""
    return interactions.where(F.col("kind") == "command").join(registry, "name")


def unknown_commands(interactions: DataFrame, registry: DataFrame) -> DataFrame:
    """Command interactions that name no registered command, with a warning text."""
    missed = interactions.where(F.col("kind") == "command").join(registry, "name", "left_anti")
    warning = F.concat(F.lit("Trying to execute nonexistent command "), F.col("name"))
    return missed.select("event_id", "name", warning.alias("warning"))


def valid_deletes(interactions: DataFrame, messages: DataFrame) -> DataFrame:
    """Presses of the delete button on messages that exist and were written by the system itself."""
    presses = interactions.where((F.col("kind") == "button") & (F.col("name") == DELETE_BUTTON))
    own = messages.where(F.col("author_is_self")).select("message_id")
    return presses.where(F.col("message_id").isNotNull()).join(own, "message_id", "left_semi")


def delete_own_messages(interactions: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages that remain."""
    gone = valid_deletes(interactions, messages).select("message_id").distinct()
    return messages.join(gone, "message_id", "left_anti")


def join_requests(interactions: DataFrame, settings: DataFrame) -> DataFrame:
    """Join commands of guilds with channels switched on, with the slug of the wanted channel."""
    asked = interactions.where((F.col("kind") == "command") & (F.col("name") == "join") & (F.col("arg") != ""))
    enabled = settings.where(F.col("channels_enabled")).select("guild_id", F.col("channel_category_id").alias("category_id"))
    return asked.join(enabled, "guild_id").select(
        "event_id", "guild_id", "category_id", "user_id", channel_slug(F.col("arg")).alias("channel")
    )


def get_or_create_channels(requests: DataFrame, channels: DataFrame) -> DataFrame:
    """All text channels after the requests: the existing ones and one new row per missing name."""
    existing = channels.where(F.col("type") == "text").select("guild_id", "category_id", F.col("name").alias("channel"))
    wanted = requests.select("guild_id", "category_id", "channel").distinct()
    # Category may be NULL on both sides: NULL equals NULL here, as in the lookup it stands for.
    match = (
        (wanted["guild_id"] == existing["guild_id"])
        & (wanted["channel"] == existing["channel"])
        & wanted["category_id"].eqNullSafe(existing["category_id"])
    )
    created = wanted.join(existing, match, "left_anti")
    return existing.withColumn("created", F.lit(False)).unionByName(created.withColumn("created", F.lit(True)))


def channel_names(requests: DataFrame, channels: DataFrame) -> DataFrame:
    """Set of channel names per guild: known names and requested ones."""
    known = channels.where(F.col("type") == "text").select("guild_id", F.col("name").alias("channel"))
    return known.union(requests.select("guild_id", "channel")).distinct()


def channel_grants(requests: DataFrame) -> DataFrame:
    """Who may see which channel: one row per user and channel."""
    return requests.select("guild_id", "channel", "user_id").distinct()


def channels_with_prefix(channels: DataFrame, prefix: str) -> DataFrame:
    """Text channels inside a category whose name starts with ``prefix`` (case-sensitive)."""
    return channels.where((F.col("type") == "text") & F.col("category_id").isNotNull() & F.startswith("name", F.lit(prefix)))


def complete_channels(asked: DataFrame, settings: DataFrame, channels: DataFrame) -> DataFrame:
    """Choices for the beginnings of names that users have typed: ``(event_id, name)``.

    ``asked`` has (event_id, guild_id, typed). A guild offers the text channels of its own category; a guild without
    settings or category offers none. Beginnings match by case, and the empty one matches every name. Every beginning
    of a name is a key of the index, so the search is an equality join: a beginning that many ask for is looked up
    once, and its answers meet the requests after that.
    """
    offered = settings.where(F.col("channel_category_id").isNotNull()).select("guild_id", F.col("channel_category_id").alias("category_id"))
    names = channels.where(F.col("type") == "text").select("guild_id", "category_id", "name").distinct().join(offered, ["guild_id", "category_id"])
    lengths = F.sequence(F.lit(0), F.length("name"))
    index = names.select("guild_id", "name", F.explode(lengths).alias("n")).select("guild_id", "name", F.substring("name", F.lit(1), F.col("n")).alias("typed"))
    answers = index.join(asked.select("guild_id", "typed").distinct(), ["guild_id", "typed"])
    return asked.select("event_id", "guild_id", "typed").join(answers, ["guild_id", "typed"]).select("event_id", "name")
