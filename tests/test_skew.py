"""One key that holds all events of one second, and rows without a key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagemill.operators import reactions

START = datetime(2024, 1, 1)


def plain_counts(rows):
    seen, out = {}, {}
    for key, ts, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or START, r[2])):
        seen[key] = seen.get(key, 0) + 1
        out[i] = seen[key]
    return out


@pytest.mark.parametrize("steps", [[0], [0, 1, 1, 1], list(range(0, 900_000, 1000)), [0, 0, 0, 2_500_000, 7_200_000_000, None]])
def test_hot_seconds_count_like_others(spark, steps):
    rng = random.Random(len(steps))
    ids = rng.sample(range(-5_000, 1_000_000), 3000)
    rows = []
    for i in ids:
        step = rng.choice(steps)
        rows.append((rng.choice(["hot"] * 8 + ["a", None]), None if step is None else START + timedelta(microseconds=step), i))
    events = spark.createDataFrame(rows, "k string, ts timestamp, i bigint").repartition(6)
    got = {r.i: r.n for r in reactions.running_count(events, ["k"], ["ts", "i"], hot_rows=100).collect()}
    assert got == plain_counts(rows)


def test_a_hot_instant_is_spread_over_tasks(spark):
    events = spark.range(0, 40_000, 1, 8).select(F.lit("hot").alias("k"), F.lit(START).alias("ts"), (F.col("id") * 7 % 40_000).alias("i"))
    tagged = events.withColumn("__fine", F.date_trunc("second", "ts"))
    parts = reactions._sub_bucket(tagged, ["k"], "__fine", ["ts", "i"], 1000).groupBy("__sub").count().collect()
    assert len(parts) >= 50 and max(r["count"] for r in parts) < 2000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        counted = reactions.running_count(events, ["k"], ["ts", "i"], hot_rows=1000)
        sizes = counted.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) >= 12 and max(r["count"] for r in sizes) < 12_000
        assert counted.where("n = i + 1").count() == 40_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rows_without_a_guild_are_spread_and_get_no_settings(spark):
    events = spark.range(20_000).selectExpr("id AS event_id", "CASE WHEN id % 4 = 0 THEN 'g0' WHEN id = 1 THEN 'new' END AS guild_id")
    guilds = spark.createDataFrame([("g0", 4)], "guild_id string, version int")
    for name, (kind, _) in reactions.NEW_GUILD.items():
        if name != "version":
            guilds = guilds.withColumn(name, F.lit(None).cast(kind))
    before = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        known = reactions.with_settings(events, guilds)
        sizes = [r["count"] for r in known.where("guild_id IS NULL").groupBy(F.spark_partition_id()).count().collect()]
        assert known.columns == ["event_id", "guild_id", *reactions.NEW_GUILD]
        assert {(r.guild_id, r.version, r["count"]) for r in known.groupBy("guild_id", "version").count().collect()} == {("g0", 4, 5000), ("new", 1, 1), (None, None, 14999)}
        assert len(sizes) == 16 and max(sizes) < 2000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
