"""Reaction events: running counts, settings, routing, pins and message cards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import BOOKMARK_EMOJI, LINK_EMOJI, PIN_EMOJI

# The defaults of the settings.
PIN_THRESHOLD = 3
PIN_LIMIT = 50

NO_CONTENT = (
    "*(no content)*\n\nThis may be an indication that the server has opted not to share message content with the bot."
)


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where nulls are equal, so that a row without key or time is kept."""
    named = right.select(*(F.col(c).alias(f"__right_{c}") if c in keys else F.col(c) for c in right.columns))
    same = [F.col(c).eqNullSafe(F.col(f"__right_{c}")) for c in keys]
    return left.join(named, same, how).drop(*(f"__right_{c}" for c in keys))


#: Rows of one key in one fine time bucket from which on the bucket is cut, and into how many parts at least.
HOT_ROWS = 100_000
CUTS = 64
#: Keys under which rows without a key are spread.
NULL_KEYS = 1024


def _code(column: Column, kind: str) -> Column | None:
    """The order of a column as a whole number, or None for a type that has none."""
    if kind.startswith("timestamp"):
        return F.unix_micros(column.cast("timestamp"))
    return column.cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else None


def _sub_bucket(tagged: DataFrame, keys: list[str], fine: str, order: list[str], hot_rows: int) -> DataFrame:
    """Add ``__sub``, an ordered part of the fine bucket; 0 but in buckets with more than ``hot_rows`` rows of a key.

    Cut points are quantiles of the first two order columns, taken over the rows of hot buckets alone. A row equal to
    a cut of the first column is placed by the second, so rows of one instant are spread like others. Parts keep the
    order, whatever the cuts; only their sizes depend on them.
    """
    kinds = dict(tagged.dtypes)
    codes = [_code(F.col(name), kinds[name]) for name in order[:2]]
    if codes[0] is None:
        return tagged.withColumn("__sub", F.lit(0))
    codes = [code for code in codes if code is not None]
    group = [*keys, fine]
    hot = tagged.groupBy(*group).agg(F.count("*").alias("__rows")).where(F.col("__rows") > hot_rows).drop("__rows")
    shares = [k / CUTS for k in range(1, CUTS)]
    coded = tagged.select(*group, *[code.alias(f"__code{k}") for k, code in enumerate(codes)])
    cuts = _meet(coded, hot, group).groupBy(*group).agg(*[F.percentile_approx(f"__code{k}", shares).alias(f"__cuts{k}") for k in range(len(codes))])

    def below(code: Column, cut: str) -> Column:
        return F.size(F.filter(cut, lambda c: c < code))

    first = codes[0]
    part = below(first, "__cuts0") * 2 + F.array_contains("__cuts0", first).cast("int")
    if len(codes) > 1:
        inner = F.when(F.array_contains("__cuts0", first), F.coalesce(below(codes[1], "__cuts1"), F.lit(0))).otherwise(0)
        part = part * (2 * CUTS) + inner
    placed = _meet(tagged, cuts, group, "left").withColumn("__sub", F.when(F.col("__cuts0").isNull(), 0).otherwise(F.coalesce(part, F.lit(-1))))
    return placed.drop(*[f"__cuts{k}" for k in range(len(codes))])


def running_count(
    events: DataFrame,
    keys: list[str],
    order: list[str],
    delta: str | None = None,
    time_col: str = "ts",
    buckets: tuple[str, str] = ("hour", "second"),
    prior: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``n``: how many events of the key there are up to and including this one.

    One key may hold a third of all events, so no window runs over a whole key. Events are counted
    per key and fine time bucket (combined before the shuffle); these totals are summed up within
    their coarse bucket, and the coarse totals within the key; the rows are ranked inside their fine
    bucket only. A fine bucket with more than ``hot_rows`` rows of a key, all of one second or of one
    instant even, is cut into ordered parts that count like buckets of their own. Null keys are one
    key, and a row without time comes before all others. ``prior`` has one row per key with the count
    ``n`` before these events; it meets the coarse totals and never the events themselves.
    """
    amount = F.col(delta) if delta else F.lit(1)
    coarse, fine, sub = "__coarse", "__fine", "__sub"
    timed = events.withColumns({coarse: F.date_trunc(buckets[0], F.col(time_col)), fine: F.date_trunc(buckets[1], F.col(time_col))})
    tagged = _sub_bucket(timed, keys, fine, order, hot_rows)

    def sum_before(total: str, group: list[str], *by: str) -> Column:
        earlier = Window.partitionBy(*group).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(total).over(earlier), F.lit(0))

    fine_totals = tagged.groupBy(*keys, coarse, fine, sub).agg(F.sum(amount).alias("__n"))
    fine_before = fine_totals.withColumn("__fine_before", sum_before("__n", [*keys, coarse], fine, sub))
    coarse_totals = fine_totals.groupBy(*keys, coarse).agg(F.sum("__n").alias("__n"))
    coarse_before = coarse_totals.select(*keys, coarse, sum_before("__n", keys, coarse).alias("__coarse_before"))
    start = F.col("__coarse_before") + F.col("__fine_before")
    if prior is not None:
        coarse_before = _meet(coarse_before, prior.select(*keys, F.col("n").alias("__prior")), keys, "left")
        start = start + F.coalesce("__prior", F.lit(0))
    offsets = _meet(fine_before, coarse_before, [*keys, coarse]).select(*keys, fine, sub, start.alias("__before"))
    local = Window.partitionBy(*keys, fine, sub).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = _meet(tagged, offsets, [*keys, fine, sub])
    count = (F.col("__before") + F.sum(amount).over(local)).cast("bigint")
    return ranked.withColumn("n", count).drop(coarse, fine, sub, "__before")


def matches_emoji(setting: str, default: str) -> Column:
    """Emoji name or id equals the configured emoji, or the default where none is set."""
    wanted = F.coalesce(F.nullif(F.col(setting), F.lit("")), F.lit(default))
    by_name = F.coalesce(F.col("emoji_name") == wanted, F.lit(False))
    by_id = F.coalesce(F.col("emoji_id") == wanted, F.lit(False))
    return by_name | by_id


def is_bookmark() -> Column:
    return F.coalesce(F.col("bookmark_enabled"), F.lit(False)) & matches_emoji("bookmark_emoji", BOOKMARK_EMOJI)


def is_pin() -> Column:
    return (
        F.coalesce(F.col("pin_enabled"), F.lit(False))
        & matches_emoji("pin_emoji", PIN_EMOJI)
        & F.coalesce(F.col("n") >= F.col("pin_threshold"), F.lit(False))
    )


def is_link() -> Column:
    return F.coalesce(F.col("emoji_name") == LINK_EMOJI, F.lit(False)) & (F.col("n") == 1)


@dataclass(frozen=True)
class Route:
    """An action and the condition, over event and settings columns, under which it runs."""

    action: str
    condition: Column


def default_routes() -> list[Route]:
    """The first route that accepts an event handles it."""
    return [Route("bookmark", is_bookmark()), Route("pin", is_pin()), Route("link", is_link())]


# The settings of a guild that has no row yet. Get-or-create turns pins on, while a
# pin column added to stored rows is filled with off.
NEW_GUILD = {
    "version": ("int", 1),
    "bookmark_emoji": ("string", BOOKMARK_EMOJI),
    "bookmark_enabled": ("boolean", True),
    "pin_emoji": ("string", PIN_EMOJI),
    "pin_enabled": ("boolean", True),
    "pin_threshold": ("int", PIN_THRESHOLD),
    "channel_category_id": ("string", None),
    "channels_enabled": ("boolean", False),
}


def with_settings(events: DataFrame, guilds: DataFrame) -> DataFrame:
    """Events with the settings of their guild, or with those of a new guild where none are stored.

    Direct messages have no guild and get no settings; they meet the settings under many keys that no guild has, so
    that they are not all of one key. The optimizer broadcasts the settings when their size allows it.
    """
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*[n for n, kind in events.dtypes if "map<" not in kind]), F.lit(NULL_KEYS)).cast("string"))
    stored = guilds.withColumnRenamed("guild_id", "__guild").withColumn("__stored", F.lit(True))
    keyed = events.withColumn("__key", F.coalesce(F.col("guild_id").cast("string"), spread))
    known = keyed.join(stored, F.col("__key") == F.col("__guild"), "left").drop("__key", "__guild")
    fresh = F.col("guild_id").isNotNull() & F.col("__stored").isNull()
    filled = {
        name: F.when(fresh, F.lit(value).cast(kind)).otherwise(F.col(name)) for name, (kind, value) in NEW_GUILD.items()
    }
    return known.withColumns(filled).drop("__stored")


def missing_guilds(guilds: DataFrame, guild_ids: DataFrame) -> DataFrame:
    """Default rows for guild ids that have no settings yet."""
    ids = guild_ids.where(F.col("guild_id").isNotNull()).select("guild_id").distinct()
    unseen = ids.join(guilds.select("guild_id"), "guild_id", "left_anti")
    return unseen.select("guild_id", *[F.lit(value).cast(kind).alias(name) for name, (kind, value) in NEW_GUILD.items()])


def upsert_guilds(guilds: DataFrame, guild_ids: DataFrame) -> DataFrame:
    """Settings of all seen guilds: stored rows plus one default row per unseen id."""
    return guilds.select("guild_id", *NEW_GUILD).unionByName(missing_guilds(guilds, guild_ids))


def route_counted(counted: DataFrame, guilds: DataFrame, routes: list[Route] | None = None) -> DataFrame:
    """Route events that carry their count ``n``; events of bots count but trigger nothing."""
    routes = routes or default_routes()
    # The bot filter stays behind the count, which includes bots.
    human = counted.where(~F.col("user_is_bot"))
    known = with_settings(human, guilds)
    action = F.when(routes[0].condition, routes[0].action)
    for route in routes[1:]:
        action = action.when(route.condition, route.action)
    routed = known.withColumn("action", action).where(F.col("action").isNotNull())
    return routed.select("event_id", "ts", "guild_id", "channel_id", "message_id", "user_id", "emoji_name", "n", "action")


COUNT_KEY = ["message_id", "emoji_key"]


def with_emoji_key(reactions: DataFrame) -> DataFrame:
    """The identity of the emoji: its id for a custom one, else its name; never NULL."""
    return reactions.withColumn("emoji_key", F.coalesce("emoji_id", "emoji_name", F.lit("")))


def reaction_counts(reactions: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Reactions with ``n``, the count of their (message, emoji) at each event."""
    return running_count(with_emoji_key(reactions), COUNT_KEY, ["ts", "event_id"], prior=prior).drop("emoji_key")


def route_reactions(reactions: DataFrame, guilds: DataFrame, routes: list[Route] | None = None) -> DataFrame:
    return route_counted(reaction_counts(reactions), guilds, routes)


def pin_retention(routed: DataFrame, limit: int = PIN_LIMIT, channels: DataFrame | None = None) -> DataFrame:
    """Newest ``limit`` pins per channel; of text channels only, where ``channels`` (channel_id, type) tells which they are.

    A message is pinned when it first reaches its threshold. Top-k per channel is cut on the map
    side, so a busy channel sends at most ``limit`` rows per task.
    """
    first = F.min(F.struct("ts", "event_id")).alias("first")
    asked = routed.where(F.col("action") == "pin")
    if channels is not None:
        asked = asked.join(channels.where("type = 'text'").select("channel_id"), "channel_id", "left_semi")
    pins = asked.groupBy("channel_id", "message_id").agg(first)
    pins = pins.select("channel_id", "message_id", F.col("first.ts").alias("pinned_at"))
    newest = Window.partitionBy("channel_id").orderBy(F.desc("pinned_at"), F.desc("message_id"))
    return pins.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def message_cards(messages: DataFrame) -> DataFrame:
    """Bookmark card of a message: title, url, description and author."""
    title = F.when(
        F.col("guild_name").isNotNull(),
        F.when(
            F.col("channel_name").isNotNull() & (F.col("channel_type") == "text"),
            F.concat(F.lit("Message from "), F.col("guild_name"), F.lit(" #"), F.col("channel_name")),
        ).otherwise(F.concat(F.lit("Message from "), F.col("guild_name"))),
    )
    tag = F.when(F.col("discriminator") != "0", F.concat(F.lit("#"), F.col("discriminator"))).otherwise("")
    return messages.select(
        "message_id",
        title.alias("title"),
        F.nullif(F.col("url"), F.lit("")).alias("url"),
        F.coalesce(F.nullif(F.col("content"), F.lit("")), F.lit(NO_CONTENT)).alias("description"),
        F.concat(F.col("username"), tag).alias("author"),
    )


def bookmark_cards(routed: DataFrame, messages: DataFrame) -> DataFrame:
    """Cards to send: one per bookmark event, to the user who reacted."""
    marks = routed.where(F.col("action") == "bookmark").select("event_id", "user_id", "message_id")
    return marks.join(message_cards(messages), "message_id")


# The edge of a portrait on a card, and the bytes of files that one delivery takes.
ICON_SIZE = 64
FILE_LIMIT = 10 * 1024 * 1024


def bookmark_deliveries(cards: DataFrame, media: DataFrame, limit: int = FILE_LIMIT) -> DataFrame:
    """Cards with the author's portrait and the message's files; files that are too much together stay out.

    ``media`` has (message_id, avatar_url, attachments: array of (url, size)), one row per message or none.
    """
    size = F.aggregate(F.col("attachments"), F.lit(0).cast("bigint"), lambda n, a: n + F.coalesce(a["size"], F.lit(0)))
    urls = F.transform("attachments", lambda a: a["url"])
    none = F.array().cast("array<string>")
    told = media.select(
        "message_id",
        F.concat(F.nullif(F.col("avatar_url"), F.lit("")), F.lit(f"?size={ICON_SIZE}")).alias("icon_url"),
        F.when(size <= limit, urls).otherwise(none).alias("files"),
        (size > limit).alias("files_left_out"),
    )
    joined = cards.join(told, "message_id", "left")
    return joined.withColumns({"files": F.coalesce("files", none), "files_left_out": F.coalesce("files_left_out", F.lit(False))})
