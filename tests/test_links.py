from pyspark.sql import functions as F

from pagemill.functions import text
from pagemill.functions.core import let
from pagemill.functions.urls import base_parts, content_urls, is_content_url, resolve_url, site_of
from pagemill.operators import bundles, links
from pagemill.plans.archive import OUTBOX, run_archive
from pagemill.sources import sinks
from pagemill.sources.sinks import unsent


def values(spark, data, *build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, t string")
    rows = df.select("i", *[b(F.col("t")).alias(f"x{k}") for k, b in enumerate(build)]).orderBy("i").collect()
    return [r.x0 for r in rows] if len(build) == 1 else [tuple(r)[1:] for r in rows]


def test_links_are_kept_as_written(spark):
    got = values(spark, ["see http://a.org/x, and HTTP://b.org https://c.org/p.PNG https://c.org/p.png?x http://a.org/x,"], content_urls)[0]
    assert got == ["http://a.org/x,", "https://c.org/p.png?x", "http://a.org/x,"]


def test_page_links_in_any_form(spark):
    html = "<a href=\"a\">1</a><a class='k' href='b c'>2</a><A\nHREF = d>3</A><a name=x>4</a><a data-href='e'>5</a><abbr href='f'>"
    df = spark.createDataFrame([(1, "u", html), (2, "u", ""), (3, "u", None)], "page_id int, url string, html string")
    assert [(r.page_id, r.pos, r.href) for r in links.page_links(df).orderBy("pos").collect()] == [(1, 0, "a"), (1, 1, "b c"), (1, 2, "d")]


def test_page_links_beside_quoted_marks(spark):
    html = "<a title='1 > 0' href=\"a>b\">x</a><a data-x=\"href='no'\" href=yes><a title=\"an href=no\">y</a><a title=k href = 'z' class='c'><a " + "x='>' " * 3000 + "href=far>"
    df = spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
    assert [r.href for r in links.page_links(df).orderBy("pos").collect()] == ["a>b", "yes", "z", "far"]


def test_denied_places_by_substring_or_host(spark):
    urls = ["https://netflix.com/a", "https://x.com/a", "https://m.youtube.com/watch?v=1", "https://youtube.com/c"]
    assert values(spark, urls, is_content_url) == [False, False, False, True]
    assert values(spark, urls, lambda c: is_content_url(c, "host")) == [True, False, False, True]


def test_site(spark):
    got = values(spark, ["https://www.A.org:8080/x", "http://u:p@b.www.org", "nonsense"], site_of)
    assert got == ["a.org", "b.org", None]


def test_resolution(spark):
    base = "https://u@Ex.com:443/docs/cur/page.md?q=1#f"
    cases = {
        "./a.md": "https://ex.com/docs/cur/a.md",
        "../p/f.md": "https://ex.com/docs/p/f.md",
        "../../../../z/": "https://ex.com/z",
        "/r?x": "https://ex.com/r?x",
        "//h/x": "https://h/x",
        "#s": "https://ex.com/docs/cur/page.md?q=1#f#s",
        "mailto:a@b": "mailto:a@b",
        "http://k/": "http://k/",
    }
    got = values(spark, list(cases), lambda c: let(lambda b: resolve_url(c, b["base"]), base=base_parts(F.lit(base))))
    assert got == list(cases.values())


def test_names(spark):
    got = values(spark, ["A  b/c: éè?", "???", "-a - b-"], text.thread_name, text.file_stem)
    assert got == [("A bc", "A-bc-éè"), ("Scraped Content", "content"), ("-a - b-", "a-b")]


def test_byte_cap_never_splits_a_character(spark):
    got = values(spark, ["é" * 100, "a" * 100, "a"], lambda c: text.cap_bytes(c, 60))
    assert got == ["é" * 30, "a" * 54, "a"]


def test_truncate(spark):
    got = values(spark, ["a" * 90 + ". " + "b" * 50, "." + "c" * 200, "d"], lambda c: text.truncate_text(c, 100))
    assert got == ["a" * 90 + ".\n\n*[Content truncated]*", "." + "c" * 99 + "\n\n*[Content truncated]*", "d"]


def test_dates(spark):
    got = values(spark, ["2024-01-02", "2024-01-02T03:04:05.678Z", "Tue, 02 Jan 2024 03:04:05 GMT", "January 2, 2024", "soon", ""], lambda c: text.iso_millis(text.parse_date(c)))
    assert got == ["2024-01-02T00:00:00.000Z", "2024-01-02T03:04:05.678Z", "2024-01-02T03:04:05.000Z", "2024-01-02T00:00:00.000Z", None, None]


def test_front_matter_blocks_and_quotes(spark):
    rows = [("a\nb", 'x "q"', "u", None, "", None, None)]
    df = spark.createDataFrame(rows, "title string, content string, url string, author string, description string, published_at timestamp, site_name string")
    df = df.withColumn("archived_at", F.timestamp_millis(F.lit(0)))
    head = df.select(bundles.front_matter(F.struct(*bundles.RECORD))).first()[0]
    assert head == '---\ntitle: |\n  a\n  b\nsource: "u"\narchived: "1970-01-01T00:00:00.000Z"\n---'


PAGES = [
    (1, "https://a.org/1", "<title>One</title><article><p>first <a href='/k'>k</a></p></article>"),
    (2, "https://a.org/2#top", "<title>Two</title><article><p>second</p></article>"),
    (3, "https://a.org/2", "<title>Copy</title><article><p>copy</p></article>"),
    (4, "https://a.org/empty", "<body></body>"),
]
MESSAGES = [(1, "see https://a.org/2 and https://a.org/1 https://a.org/none"), (2, "https://a.org/1"), (3, "https://a.org/empty"), (4, None)]


def test_archive_job(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id int, url string, html string")
    messages = spark.createDataFrame(MESSAGES, "message_id int, content string")
    paths = run_archive(spark, messages, pages, F.timestamp_millis(F.lit(0)), str(tmp_path))
    files = {r.filename: r.body for r in spark.read.parquet(paths.files).collect()}
    assert sorted(files) == ["One-2.md", "scraped-content-0-1.md"]
    body = files["scraped-content-0-1.md"]
    assert body.index("## 1. Two") < body.index("## 2. One") and "# Scraped Content (2 links)" in body
    outbox = spark.read.parquet(paths.outbox)
    assert {r.message_id for r in outbox.collect()} == {1, 2}
    assert outbox.where(F.contains("content", F.lit("https://a.org/k"))).count() == 2
    failed = {(r.message_id, r.url) for r in spark.read.parquet(paths.failed).collect()}
    assert failed == {(1, "https://a.org/none"), (3, "https://a.org/empty")}
    summary = {r.message_id: r.summary for r in spark.read.parquet(paths.summary).collect()}
    assert summary == {1: "Successfully scraped 2 out of 3 links", 2: "Successfully scraped 1 out of 1 links"}
    assert unsent(outbox, outbox).count() == 0


def test_popular_address_is_scraped_once(spark):
    pages = spark.createDataFrame(PAGES, "page_id int, url string, html string")
    found = links.extract_links(spark.createDataFrame([(i, "https://a.org/2") for i in range(300)], "message_id int, content string"))
    assert [r.page_id for r in links.wanted_pages(found, pages).collect()] == [2]


def test_archive_job_run_again_delivers_nothing_twice(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id int, url string, html string")
    messages = spark.createDataFrame(MESSAGES, "message_id bigint, content string")
    root, at = str(tmp_path), F.timestamp_millis(F.lit(0))

    def sent():
        return sorted((r.message_id, r.seq, r.content) for r in sinks.delivered(spark, root, OUTBOX).collect())

    assert sent() == []
    run_archive(spark, messages, pages, at, root, 0)
    first = sent()
    assert [(m, s) for m, s, _ in first] == [(1, 0), (2, 0)]
    run_archive(spark, messages, pages, at, root, 0)  # a replay
    run_archive(spark, messages, pages, at, root)  # the job once more
    assert sent() == first
    run_archive(spark, messages.union(spark.createDataFrame([(9, "https://a.org/1")], messages.schema)), pages, at, root)
    assert [(m, s) for m, s, _ in sent()] == [(1, 0), (2, 0), (9, 0)]


def test_a_batch_that_broke_off_is_not_read_and_is_done_again(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, 1, "paragraph", "a", None)], OUTBOX)
    root = str(tmp_path)
    sinks.deliver(chunks, root, 5)  # no commit follows
    assert sinks.delivered(spark, root, OUTBOX).count() == 0
    sinks.deliver(chunks, root, 6)
    sinks.commit(spark, root, 6)
    sinks.deliver(chunks, root, 5)
    sinks.commit(spark, root, 5)
    assert sinks.delivered(spark, root, OUTBOX).count() == 1 and sinks.committed(spark, root) == ["5", "6"]
