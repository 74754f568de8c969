"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The default emoji of each action.
BOOKMARK_EMOJI = "🔖"
PIN_EMOJI = "📌"
LINK_EMOJI = "📝"

#: Session setting: partitions that table rows are dealt into ahead of heavy per-row work. Unset, rows stay as read.
READ_PARTITIONS = "spark.pagemill.readPartitions"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows into ``partitions``, or as many as the session's ``READ_PARTITIONS`` asks for.

    For inputs of few row groups, which would run as few tasks. The plan follows the caller's word only,
    never the size of the input; by default there is no exchange.
    """
    wanted = partitions or int(df.sparkSession.conf.get(READ_PARTITIONS, "0"))
    return df.repartition(wanted) if wanted else df


def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load_table(spark, sf_dir, "documents").select("doc_id", "text"))


def load_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def load_guilds(spark: SparkSession, path: str) -> DataFrame:
    """Settings written by any version: columns added later are filled with their defaults."""
    return complete_guilds(spark.read.option("mergeSchema", "true").parquet(path))


def complete_guilds(df: DataFrame) -> DataFrame:
    """The full settings schema; an added column missing or unset takes its table default."""
    present = set(df.columns)

    def column(name: str, kind: str, default: object = None) -> object:
        value = F.col(name).cast(kind) if name in present else F.lit(None).cast(kind)
        return (value if default is None else F.coalesce(value, F.lit(default).cast(kind))).alias(name)

    def emoji(name: str, default: str, flag: str) -> object:
        # A stored NULL means "use the default emoji" and is kept. A row from before the column is filled: it lacks
        # the flag that was stored with the emoji, which is never NULL.
        stored = F.col(name).cast("string") if name in present else F.lit(default)
        older = F.col(flag).isNull() if flag in present else F.lit(True)
        return F.when(older, F.coalesce(stored, F.lit(default))).otherwise(stored).alias(name)

    return df.select(
        column("guild_id", "string"),
        column("version", "int", 1),
        emoji("bookmark_emoji", BOOKMARK_EMOJI, "bookmark_enabled"),
        column("bookmark_enabled", "boolean", True),
        emoji("pin_emoji", PIN_EMOJI, "pin_enabled"),
        column("pin_enabled", "boolean", False),
        column("pin_threshold", "int", 3),
        column("channel_category_id", "string"),
        column("channels_enabled", "boolean", False),
    )
