"""Counts, effects and pins over several micro-batches and several runs of the same queries."""

import time
from datetime import datetime, timedelta

from pagemill.operators import reactions
from pagemill.plans import views
from pagemill.streaming.reactions import EVENT_FIELDS, event_stream, pinned_now, start_counting, start_effects, start_pins, start_routing

DDL = ", ".join(f"{name} {kind}" for name, kind in EVENT_FIELDS)
START = datetime(2024, 1, 1)


def event(i, message, emoji=reactions.PIN_EMOJI, channel="c", guild="g9", bot=False):
    return (i, START + timedelta(minutes=i), i, bot, message, channel, guild, emoji, None)


def feed(spark, path, *files):
    for rows in files:
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(path)


def route(spark, tmp_path, settings=None):
    query = start_routing(
        spark, event_stream(spark, f"{tmp_path}/feed", 1), settings or (lambda: views.guilds(spark)), f"{tmp_path}/out", f"{tmp_path}/routing"
    )
    query.awaitTermination()
    start_effects(spark, f"{tmp_path}/out", f"{tmp_path}/effects").awaitTermination()


def effects(spark, tmp_path):
    return sorted((r.message_id, r.action, r.event_id) for r in spark.read.parquet(f"{tmp_path}/out/effects").collect())


def test_counts_go_on_over_files_and_runs(spark, tmp_path):
    path, out = f"{tmp_path}/feed", f"{tmp_path}/out"
    feed(spark, path, [event(2, 1), event(1, 1), event(3, 2)], [event(4, 1), event(5, 1, "x")])
    start_counting(spark, event_stream(spark, path, 1), out, f"{tmp_path}/state").awaitTermination()
    feed(spark, path, [event(6, 1), event(7, 2)])
    start_counting(spark, event_stream(spark, path, 1), out, f"{tmp_path}/state").awaitTermination()
    assert sorted((r.event_id, r.n) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 2), (3, 1), (4, 3), (5, 1), (6, 4), (7, 2)]


def test_counts_of_quiet_messages_end(spark, tmp_path):
    path, out = f"{tmp_path}/feed", f"{tmp_path}/out"

    def run():
        query = start_counting(spark, event_stream(spark, path, 1), out, f"{tmp_path}/state", keep_ms=1500)
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    feed(spark, path, [event(i, i) for i in range(20)])
    assert run() == 20
    time.sleep(3)
    feed(spark, path, [event(30, 1)])
    assert run() == 1
    state = spark.read.format("statestore").option("stateVarName", "counts").load(f"{tmp_path}/state")
    assert [r.key.message_id for r in state.collect()] == [1]
    assert [r.n for r in spark.read.parquet(out).where("event_id = 30").collect()] == [1]


def test_an_effect_happens_once_over_files_and_runs(spark, tmp_path):
    feed(spark, f"{tmp_path}/feed", [event(1, 1), event(2, 1)], [event(3, 1), event(4, 1)], [event(5, 1), event(6, 2, reactions.LINK_EMOJI)])
    route(spark, tmp_path)
    assert effects(spark, tmp_path) == [(1, "pin", 3), (2, "link", 6)]
    feed(spark, f"{tmp_path}/feed", [event(7, 1), event(8, 2, reactions.LINK_EMOJI), event(9, 3, reactions.BOOKMARK_EMOJI), event(10, 3, reactions.BOOKMARK_EMOJI)])
    route(spark, tmp_path)
    assert effects(spark, tmp_path) == [(1, "pin", 3), (2, "link", 6), (3, "bookmark", 9), (3, "bookmark", 10)]


def test_a_bot_counts_and_the_next_person_pins(spark, tmp_path):
    feed(spark, f"{tmp_path}/feed", [event(1, 1), event(2, 1), event(3, 1, bot=True), event(4, 1), event(5, 1)])
    route(spark, tmp_path)
    assert effects(spark, tmp_path) == [(1, "pin", 4)]


def test_settings_are_read_for_every_batch(spark, tmp_path):
    asked = []

    def settings():
        asked.append(1)
        return views.guilds(spark).selectExpr("'g9' AS guild_id", "* except (guild_id)").limit(1).withColumn("pin_threshold", reactions.F.lit(len(asked)))

    feed(spark, f"{tmp_path}/feed", [event(1, 1)], [event(2, 2)], [event(3, 2), event(4, 2)])
    route(spark, tmp_path, settings)
    assert len(asked) == 3 and effects(spark, tmp_path) == [(1, "pin", 1), (2, "pin", 4)]


def test_newest_pins_stay_and_the_oldest_go(spark, tmp_path):
    """Three files: a busy text channel beyond its limit, and a voice channel that is left alone."""
    channels = spark.createDataFrame([("c", "text"), ("v", "voice")], "channel_id string, type string")
    for first in (0, 4, 8):
        rows = [event(3 * (first + m) + k, first + m) for m in range(4) for k in range(3)]
        rows += [event(500 + 3 * first + k, 100 + first, channel="v") for k in range(3)]
        feed(spark, f"{tmp_path}/feed", rows)
        route(spark, tmp_path)
        start_pins(spark, channels, f"{tmp_path}/out", f"{tmp_path}/pins-state", limit=5).awaitTermination()
        log = spark.read.parquet(f"{tmp_path}/out/pins")
        seen = first + 4
        assert sorted(r.message_id for r in pinned_now(log).collect()) == list(range(max(0, seen - 5), seen))
    unpinned = [r.message_id for r in log.where("op = 'unpin'").orderBy("message_id").collect()]
    assert unpinned == list(range(7)) and log.where("channel_id = 'v'").count() == 0


def test_batch_retention_of_text_channels(spark):
    channels = spark.createDataFrame([("c", "text"), ("v", "voice"), (None, "text")], "channel_id string, type string")
    rows = [(1, START, None, "c", 1, 1, "p", 3, "pin"), (2, START, None, "v", 2, 1, "p", 3, "pin"), (3, START, None, None, 3, 1, "p", 3, "pin")]
    routed = spark.createDataFrame(rows, "event_id int, ts timestamp, guild_id string, channel_id string, message_id int, user_id int, emoji_name string, n int, action string")
    assert [r.message_id for r in reactions.pin_retention(routed, channels=channels).collect()] == [1]
    assert reactions.pin_retention(routed).count() == 3
