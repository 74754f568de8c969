import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagemill.operators import reactions, registry
from pagemill.plans import views
from pagemill.sources.tables import complete_guilds
from pagemill.streaming.reactions import EVENT_FIELDS, event_stream, first_actions, start_counting, start_routing

DDL = ", ".join(f"{name} {kind}" for name, kind in EVENT_FIELDS)
START = datetime(2024, 1, 1)


def random_events(n, seed=0, hot=0.4):
    """Events of which one (message, emoji) takes a large share, several per second."""
    rng = random.Random(seed)
    emoji = [reactions.PIN_EMOJI, reactions.BOOKMARK_EMOJI, reactions.LINK_EMOJI]
    out, now = [], START
    for i in range(n):
        now += timedelta(seconds=rng.choice([0, 1, 45]))
        message = 7 if rng.random() < hot else rng.randrange(40)
        guild = None if message % 10 == 9 else f"g{message % 4}"
        out.append((i, now, rng.randrange(50), rng.random() < 0.2, message, f"c{message % 3}", guild, emoji[0] if message == 7 else rng.choice(emoji), None))
    return out


def plain_counts(events):
    seen, out = {}, {}
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        key = (e[4], e[7])
        seen[key] = seen.get(key, 0) + 1
        out[e[0]] = seen[key]
    return out


def test_running_count_with_a_hot_key(spark):
    events = random_events(2000)
    got = reactions.reaction_counts(spark.createDataFrame(events, DDL)).collect()
    assert {r.event_id: r.n for r in got} == plain_counts(events)


def test_running_count_windows_never_cover_a_whole_key(spark):
    plan = reactions.reaction_counts(spark.createDataFrame(random_events(10), DDL))._jdf.queryExecution().optimizedPlan().toString()
    local = [line for line in plan.split("\n") if "Window" in line and "event_id" in line]
    assert local and all("__fine" in line for line in local)


def routed(spark, rows, guilds=None):
    events = spark.createDataFrame(rows, DDL)
    out = reactions.route_reactions(events, views.guilds(spark) if guilds is None else guilds)
    return {(r.event_id, r.action) for r in out.collect()}


def event(i, message=1, guild="g0", emoji=None, bot=False, emoji_id=None):
    return (i, START + timedelta(seconds=i), i, bot, message, "c", guild, emoji, emoji_id)


def test_pin_needs_threshold_and_counts_bots(spark):
    pin = reactions.PIN_EMOJI
    rows = [event(1, emoji=pin), event(2, emoji=pin), event(3, emoji=pin, bot=True), event(4, emoji=pin), event(5, guild=None, emoji=pin)]
    assert routed(spark, rows) == {(4, "pin")}


def test_custom_emoji_id_and_disabled_bookmark(spark):
    mark = reactions.BOOKMARK_EMOJI
    rows = [event(1, guild="g1", emoji="x", emoji_id="e1"), event(2, message=2, guild="g2", emoji=mark), event(3, message=3, guild="new", emoji=mark)]
    assert routed(spark, rows) == {(1, "bookmark"), (3, "bookmark")}


def test_events_without_emoji_name_are_counted(spark):
    rows = [event(1, emoji=None, emoji_id="e1"), event(2, emoji="n", emoji_id="e1"), event(3, emoji="n", emoji_id="e2"), event(4)]
    got = reactions.reaction_counts(spark.createDataFrame(rows, DDL)).collect()
    assert {r.event_id: r.n for r in got} == {1: 1, 2: 2, 3: 1, 4: 1}


def test_link_only_first_and_never_after_a_bot(spark):
    link = reactions.LINK_EMOJI
    rows = [event(1, guild=None, emoji=link), event(2, guild=None, emoji=link), event(3, message=2, emoji=link, bot=True), event(4, message=2, emoji=link)]
    assert routed(spark, rows) == {(1, "link")}


def test_more_than_fifty_pins(spark):
    rows = [(i, START + timedelta(minutes=m), i, False, m, "c", "g0", reactions.PIN_EMOJI, None) for i, m in enumerate(m for m in range(70) for _ in range(4))]
    kept = reactions.pin_retention(reactions.route_reactions(spark.createDataFrame(rows, DDL), views.guilds(spark))).collect()
    assert sorted(r.message_id for r in kept) == list(range(20, 70))


def test_pin_retention_cuts_before_the_shuffle(spark):
    routed_rows = reactions.route_reactions(spark.createDataFrame(random_events(10), DDL), views.guilds(spark))
    plan = reactions.pin_retention(routed_rows)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_get_or_create_settings(spark):
    ids = spark.createDataFrame([("g0",), ("n",), ("n",), (None,)], "guild_id string")
    rows = {r.guild_id: r for r in reactions.upsert_guilds(views.guilds(spark), ids).collect()}
    assert sorted(rows) == ["g0", "g1", "g2", "n"]
    assert (rows["n"].pin_enabled, rows["n"].pin_threshold, rows["n"].channels_enabled) == (True, 3, False)


def test_columns_added_later(spark):
    old = complete_guilds(spark.createDataFrame([("a",)], "guild_id string")).first()
    assert (old.pin_enabled, old.bookmark_enabled, old.pin_threshold, old.pin_emoji) == (False, True, 3, reactions.PIN_EMOJI)


def test_cards(spark):
    rows = [(1, "G", "room", "text", "u", "c", "ann", "0"), (2, "G", None, "text", "", "", "bob", "12"), (3, None, None, None, None, None, "cy", "0")]
    df = spark.createDataFrame(rows, "message_id int, guild_name string, channel_name string, channel_type string, url string, content string, username string, discriminator string")
    got = {r.message_id: (r.title, r.url, r.description, r.author) for r in reactions.message_cards(df).collect()}
    assert got == {
        1: ("Message from G #room", "u", "c", "ann"),
        2: ("Message from G", None, reactions.NO_CONTENT, "bob#12"),
        3: (None, None, reactions.NO_CONTENT, "cy"),
    }


def test_channels_with_null_category(spark):
    asked = spark.createDataFrame([(1, "g", None, 5, "a"), (2, "g", None, 6, "b"), (3, "g", None, 7, "b")], "event_id int, guild_id string, category_id string, user_id int, channel string")
    known = spark.createDataFrame([("g", None, "a", "text"), ("g", None, "b", "voice")], "guild_id string, category_id string, name string, type string")
    got = {(r.channel, r.created) for r in registry.get_or_create_channels(asked, known).collect()}
    assert got == {("a", False), ("b", True)}
    assert registry.channel_grants(asked).count() == 3


def write_feed(spark, path, events, files):
    size = -(-len(events) // files)
    for k in range(files):
        spark.createDataFrame(events[k * size : (k + 1) * size], DDL).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_over_many_micro_batches(spark, tmp_path):
    events = random_events(600, seed=5)
    write_feed(spark, str(tmp_path / "feed"), events, 6)
    feed = event_stream(spark, str(tmp_path / "feed"), max_files=1)
    out = str(tmp_path / "out")
    query = start_routing(spark, feed, lambda: views.guilds(spark), out, str(tmp_path / "state"))
    query.awaitTermination()
    got = spark.read.parquet(f"{out}/routed")
    assert got.select("batch_id").distinct().count() == 6
    want = reactions.route_reactions(spark.createDataFrame(events, DDL), views.guilds(spark))
    key = ["event_id", "n", "action"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    first = first_actions(got.where("batch_id >= 3").drop("batch_id"), got.where("batch_id < 3").drop("batch_id"))
    done = got.where("batch_id < 3").select("message_id", "action").distinct()
    assert first.join(done, ["message_id", "action"], "left_semi").count() == 0


def test_keyed_state_counts(spark, tmp_path):
    events = random_events(200, seed=6)
    write_feed(spark, str(tmp_path / "feed"), events, 3)
    feed = event_stream(spark, str(tmp_path / "feed"), max_files=1)
    start_counting(spark, feed, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("message_id", "emoji_name").agg(F.max("n").alias("n"))
    want = {}
    for e in events:
        want[(e[4], e[7])] = want.get((e[4], e[7]), 0) + 1
    assert {(r.message_id, r.emoji_name): r.n for r in got.collect()} == want


def test_running_count_keeps_rows_without_key_or_time(spark):
    rows = [("a", "2024-01-01 00:00:00", 1), ("a", None, 2), (None, "2024-01-01 00:00:01", 3), (None, None, 4), ("a", "2024-01-01 00:00:02", 5)]
    events = spark.createDataFrame(rows, "k string, t string, i int").withColumn("ts", F.col("t").cast("timestamp"))
    counted = {r["i"]: r["n"] for r in reactions.running_count(events, ["k"], ["i"]).collect()}
    assert counted == {2: 1, 1: 2, 5: 3, 4: 1, 3: 2}
