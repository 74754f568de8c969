from pagemill.operators import keybits, links, registry
from pagemill.sources.tables import load_guilds

CHANNELS = "guild_id string, category_id string, name string, type string"


def test_completion(spark):
    channels = spark.createDataFrame(
        [("g", "c", "news", "text"), ("g", "c", "new-cars", "text"), ("g", "c", "newsroom", "voice"), ("g", "x", "new", "text"), ("h", None, "news", "text"), ("g", "c", "Ärger😀", "text")],
        CHANNELS,
    )
    settings = spark.createDataFrame([("g", "c"), ("h", None)], "guild_id string, channel_category_id string")
    asked = spark.createDataFrame([(1, "g", "new"), (2, "g", "News"), (3, "g", ""), (4, "h", "n"), (5, None, "n"), (6, "g", None), (7, "g", "Ä"), (8, "g", "news-"), (1, "g", "new")], "event_id int, guild_id string, typed string")
    got = registry.complete_channels(asked, settings, channels)
    rows = sorted(map(tuple, got.collect()))
    assert rows == [(1, "new-cars"), (1, "new-cars"), (1, "news"), (1, "news"), (3, "new-cars"), (3, "news"), (3, "Ärger😀"), (7, "Ärger😀")]
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_key_filter_passes_every_key_and_few_others(spark):
    ids = spark.range(0, 100_000, 37).selectExpr("id AS page_id")
    df = spark.range(100_000).selectExpr("CASE WHEN id % 1000 = 1 THEN NULL ELSE id END AS page_id", "repeat('x', 10) AS html")
    passed = {r.page_id for r in keybits.may_hold(df, "page_id", keybits.key_bits(ids, "page_id")).collect()}
    wanted = {i for i in range(0, 100_000, 37) if i % 1000 != 1}
    assert wanted <= passed and len(passed) < len(wanted) + 60 and None not in passed
    assert keybits.may_hold(df, "page_id", keybits.key_bits(ids.limit(0), "page_id")).count() == 0


def test_pages_that_nobody_asks_for_are_not_moved(spark, tmp_path):
    """The exchange of the HTML lies above the filter in the plan."""
    stored = spark.range(2000).selectExpr("id AS page_id", "concat('https://a.org/', id) AS url", "concat('<p>', id) AS html")
    stored.write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    found = links.extract_links(spark.createDataFrame([(1, "https://a.org/7 https://a.org/8"), (2, "https://a.org/7")], "message_id int, content string"))
    before = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        wanted = links.wanted_pages(found, pages)
        plan = wanted._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.page_id for r in wanted.collect()) == [7, 8]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    indent = {line: len(line) - len(line.lstrip(" :|+-*")) for line in plan.split("\n")}
    lines = list(indent)
    html = next(at for at, line in enumerate(lines) if "FileScan" in line and "html#" in line)
    above = []  # from the HTML up to the root
    for line in reversed(lines[:html]):
        if indent[line] < indent[above[-1] if above else lines[html]]:
            above.append(line)
    exchange = next(at for at, line in enumerate(above) if "Exchange hashpartitioning(page_id" in line)
    assert any("BroadcastHashJoin" in line for line in above[:exchange])


def test_settings_of_two_versions(spark, tmp_path):
    spark.createDataFrame([("a", None, False)], "guild_id string, bookmark_emoji string, bookmark_enabled boolean").write.parquet(f"{tmp_path}/s")
    spark.createDataFrame([("b", 2, "e", "p", True, 7)], "guild_id string, version int, bookmark_emoji string, pin_emoji string, pin_enabled boolean, pin_threshold int").write.mode("append").parquet(f"{tmp_path}/s")
    rows = {r.guild_id: r for r in load_guilds(spark, f"{tmp_path}/s").collect()}
    assert tuple(rows["a"])[1:] == (1, None, False, "📌", False, 3, None, False)
    assert tuple(rows["b"])[1:] == (2, "e", True, "p", True, 7, None, False)
