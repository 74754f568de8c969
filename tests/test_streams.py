from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagemill.operators import reactions
from pagemill.plans import views
from pagemill.sources.sinks import write_outbox
from pagemill.streaming.archive import start_archiving
from pagemill.streaming.reactions import EVENT_FIELDS, event_stream, once_stream

DDL = ", ".join(f"{name} {kind}" for name, kind in EVENT_FIELDS)
START = datetime(2024, 1, 1)


def write_batch(spark, path, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(path)


def link(i, message, bot=False):
    return (i, START + timedelta(minutes=i), i, bot, message, "c", None, reactions.LINK_EMOJI, None)


def test_link_reactions_archive_each_message_once(spark, tmp_path):
    feed = str(tmp_path / "feed")
    write_batch(spark, feed, [link(1, 1), link(2, 1)])
    write_batch(spark, feed, [link(3, 1), link(4, 2, bot=True), link(5, 2), link(6, 3)])
    pages = spark.createDataFrame([(1, "https://a.org/1", "<title>One</title><article><p>first</p></article>")], "page_id int, url string, html string")
    messages = spark.createDataFrame([(i, "https://a.org/1") for i in (1, 2, 3)], "message_id bigint, content string")
    out = str(tmp_path / "out")
    query = start_archiving(
        spark, event_stream(spark, feed, 1), lambda: views.guilds(spark), messages, pages, F.timestamp_millis(F.lit(0)), out, str(tmp_path / "state")
    )
    query.awaitTermination()
    sent = spark.read.option("recursiveFileLookup", "true").parquet(*[f"{out}/archive/batch_id={b}/outbox" for b in (0, 1)])
    assert sorted(r.message_id for r in sent.collect()) == [1, 3]


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    path = str(tmp_path / "routed")
    schema = "message_id bigint, action string, ts timestamp, event_id bigint"
    for k, rows in enumerate([[(1, "pin", START, 1), (1, "pin", START + timedelta(hours=1), 2)], [(1, "pin", START + timedelta(hours=2), 3), (2, "pin", START, 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = once_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    got = [r.message_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [1, 2]


def test_outbox_keeps_a_message_together_and_in_order(spark, tmp_path):
    rows = [(m, s, f"{m}-{s}") for s in reversed(range(5)) for m in range(20)]
    write_outbox(spark.createDataFrame(rows, "message_id int, seq int, content string"), str(tmp_path / "outbox"))
    got = spark.read.parquet(str(tmp_path / "outbox")).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    per_message = got.groupBy("message_id").agg(F.countDistinct("file").alias("files"), F.array_sort(F.collect_list(F.struct("at", "seq"))).alias("rows"))
    for r in per_message.collect():
        assert r.files == 1 and [x.seq for x in r.rows] == list(range(5))
