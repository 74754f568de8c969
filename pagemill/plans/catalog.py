"""Registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codelang import language_of_content
from ..functions.core import derive, let
from ..functions.text import (
    cap_bytes,
    clean_for_display,
    clean_markdown,
    decode_entities,
    ends_with_heading,
    file_stem,
    iso_millis,
    line_class,
    parse_date,
    split_sentences,
    strip_tags,
    thread_name,
    trim_ws,
    truncate_text,
)
from ..functions.urls import absolutize_markdown, base_parts, fetch_key, resolve_url
from ..operators import bundles, chunking, codeblocks, links, pages, reactions, registry, render
from ..session import shared_dir
from ..sources.html import page_tokens
from ..sources.sinks import delivered
from ..sources.tables import load_documents, load_guilds, load_pages, load_table
from ..streaming.archive import start_archiving
from ..streaming.reactions import event_stream, pinned_now, start_counting, start_effects, start_pins, start_routing
from . import archive, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ARCHIVED_AT_MS = 1717243200500


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def archived_at() -> Column:
    """A fixed instant in UTC, so that results can be compared."""
    return F.timestamp_millis(F.lit(ARCHIVED_AT_MS))


# --- links --------------------------------------------------------------------------------------


@query
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.extract_links(views.messages(spark, sf_dir))


@query
def link_host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.link_host_counts(views.messages(spark, sf_dir))


# A link of the page in every relative form there is.
LINK_FORMS = (
    "CASE pos % 8 WHEN 0 THEN href WHEN 1 THEN substring(href, 2) WHEN 2 THEN concat('.', href) WHEN 3 THEN concat('..', href, '/../x/')"
    " WHEN 4 THEN concat('../../..', href) WHEN 5 THEN concat('#', substring(href, 2)) WHEN 6 THEN concat('?q=', substring(href, 2))"
    " ELSE concat('//cdn.example.org', href) END"
)


@query
def resolve_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.page_links(load_pages(spark, sf_dir)).withColumn("link", F.expr(LINK_FORMS))
    resolved = let(lambda b: resolve_url(F.col("link"), b["base"]), base=base_parts(F.col("url")))
    return found.select("page_id", "pos", "link", resolved.alias("resolved"))


@query
def absolutize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.markdown(spark, sf_dir)
    return docs.select("doc_id", absolutize_markdown(F.col("text"), F.col("url")).alias("text"))


def page_records(spark: SparkSession, sf_dir: str, message_links: DataFrame) -> DataFrame:
    """Metadata of the wanted pages with the bare text of the article as content."""
    wanted = links.wanted_pages(message_links, load_pages(spark, sf_dir))
    html = F.col("html")
    text = trim_ws(decode_entities(strip_tags(F.regexp_extract(html, r"(?s)<article>(.*)</article>", 1))))
    tokens = page_tokens(wanted.select("page_id", "url", "html", text.alias("content")))
    flagged = pages.flagged(tokens)
    records = derive(flagged, F.array(pages.metadata_expression()), "page_id", "url", "content")
    return records.withColumns({"key": fetch_key(F.col("url")), "archived_at": archived_at()})


@query
def scrape_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.extract_links(views.messages(spark, sf_dir))
    joined = links.scrape_join(found, page_records(spark, sf_dir, found))
    return joined.select("message_id", "pos", "url", "page_id", "title", "site_name")


@query
def failed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.extract_links(views.messages(spark, sf_dir))
    known = links.wanted_pages(found, load_table(spark, sf_dir, "pages")).select(fetch_key(F.col("url")).alias("key"))
    return links.failed_links(found, known)


@query
def scrape_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.extract_links(views.messages(spark, sf_dir))
    known = links.wanted_pages(found, load_table(spark, sf_dir, "pages")).select(
        fetch_key(F.col("url")).alias("key"), "page_id", "url"
    )
    return links.scrape_summary(links.scrape_join(found, known))


# --- text ---------------------------------------------------------------------------------------


@query
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.markdown(spark, sf_dir).select("doc_id", clean_for_display(F.col("text")).alias("text"))


@query
def clean_page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.markdown(spark, sf_dir).select("doc_id", clean_markdown(F.col("text")).alias("text"))


@query
def split_document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.explode_array(load_documents(spark, sf_dir), split_sentences(F.col("text")), "sentence", "doc_id")


@query
def classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.explode_array(views.markdown(spark, sf_dir), F.split("text", "\n", -1), "line", "doc_id")
    return rows.select("doc_id", "seq", line_class(F.col("line")).alias("kind")).where(F.col("kind").isNotNull())


@query
def heading_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the documents between blank lines that end in a heading."""
    rows = chunking.explode_array(views.markdown(spark, sf_dir), F.split("text", "\n\n", -1), "part", "doc_id")
    return rows.where(ends_with_heading(F.col("part"))).select("doc_id", "seq", "part")


@query
def strip_page_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_pages(spark, sf_dir).select("page_id", decode_entities(strip_tags(F.col("html"))).alias("text"))


@query
def truncate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_documents(spark, sf_dir).select("doc_id", truncate_text(F.col("text")).alias("text"))


@query
def cap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte cap with a limit that the test documents reach."""
    return load_documents(spark, sf_dir).select("doc_id", cap_bytes(F.col("text"), 4096).alias("text"))


@query
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written as text, parsed back and written again."""
    # Wall-clock times of the table are UTC whatever the session time zone.
    instant = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    events = load_table(spark, sf_dir, "events").select("event_id", iso_millis(instant).alias("iso"))
    return events.select("event_id", "iso", iso_millis(parse_date(F.col("iso"))).alias("again"))


# The shapes in which dates are written, after Spark's date patterns; the last one is no date.
DATE_SHAPES = [
    "EEE, d MMM yyyy HH:mm:ss 'GMT'", "d MMM yyyy HH:mm:ss '+0200'", "MMMM d, yyyy HH:mm:ss", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy",
    "d MMM yyyy", "M/d/yyyy", "yyyy-MM-dd", "yyyy-MM", "yyyy", "yyyy-MM-dd HH:mm:ss", "'soon'",
]


@query
def event_time_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written in every shape, parsed back."""
    at = F.col("ts").cast("timestamp_ntz")
    text = F.lit(None).cast("string")
    for k, shape in enumerate(DATE_SHAPES):
        text = F.when(F.col("event_id") % len(DATE_SHAPES) == k, F.date_format(at, shape)).otherwise(text)
    return load_table(spark, sf_dir, "events").select("event_id", iso_millis(parse_date(text)).alias("parsed"))


@query
def detect_code_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.snippets(spark, sf_dir).select("doc_id", language_of_content(F.col("code")).alias("language"))


# --- chunks -------------------------------------------------------------------------------------


def cleaned_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.markdown(spark, sf_dir)
    text = clean_for_display(absolutize_markdown(F.col("text"), F.col("url")))
    return derive(docs, F.array(F.struct(text.alias("text"))), "doc_id")


@query
def split_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.explode_array(cleaned_markdown(spark, sf_dir), chunking.split_images(F.col("text")), "p", "doc_id")
    return rows.select("doc_id", "seq", "p.is_image", "p.content")


@query
def image_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image address, and the caption where it says something."""
    rows = split_images(spark, sf_dir).where("is_image")
    parts = rf"\A{chunking.IMAGE_PATTERN}\z"
    alt = F.regexp_extract("content", parts, 1)
    caption = F.when(trim_ws(alt) != "", alt)
    return rows.select("doc_id", "seq", F.regexp_extract("content", parts, 2).alias("image_url"), caption.alias("caption"))


@query
def code_fence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = split_images(spark, sf_dir).where("not is_image").withColumnRenamed("seq", "part")
    rows = chunking.explode_array(parts, chunking.split_blocks(F.col("content")), "b", "doc_id", "part")
    return rows.select("doc_id", "part", "seq", "b.type", "b.content", "b.language")


@query
def pack_code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = code_fence_blocks(spark, sf_dir).where("type = 'code'").withColumnRenamed("seq", "block")
    rows = chunking.explode_array(blocks, chunking.pack_code(F.col("content"), F.col("language")), "c", "doc_id", "part", "block")
    return rows.select("doc_id", "part", "block", "seq", "c.content", "c.language")


@query
def pack_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_documents(spark, sf_dir)
    return chunking.explode_array(docs, chunking.pack_sentences(trim_ws(F.col("text"))), "content", "doc_id")


@query
def split_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.explode_array(load_documents(spark, sf_dir), chunking.split_chars(trim_ws(F.col("text"))), "content", "doc_id")


@query
def atomic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.explode_array(cleaned_markdown(spark, sf_dir), chunking.atoms(F.col("text")), "a", "doc_id")
    return rows.select("doc_id", "seq", "a.type", "a.content", "a.language")


@query
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: links, clean-up, units, size gate, re-pack."""
    return chunking.chunk_documents(views.markdown(spark, sf_dir), "doc_id", "text", "url")


@query
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(load_documents(spark, sf_dir), "doc_id", "text")


@query
def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_quality(chunk_markdown(spark, sf_dir))


@query
def delivery_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(views.markdown(spark, sf_dir), "doc_id", "text", "url", delivery=True)


@query
def chunk_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(views.markdown(spark, sf_dir), "doc_id", "text", "url", strategy="cascade")


@query
def split_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.explode_array(views.markdown(spark, sf_dir), chunking.split_rules(F.col("text")), "content", "doc_id")


@query
def markdown_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.markdown(spark, sf_dir)
    return chunking.explode_array(docs, chunking.markdown_paragraphs(F.col("text")), "content", "doc_id")


# --- pages --------------------------------------------------------------------------------------


def tokens_of(df: DataFrame) -> DataFrame:
    return page_tokens(df.select("page_id", "url", "html"))


@query
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.page_metadata(tokens_of(views.meta_pages(spark, sf_dir)))
    published = iso_millis(F.col("published_at")).alias("published")
    return rows.select("page_id", "title", "author", published, "description", "site_name")


@query
def main_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.main_regions(tokens_of(views.meta_pages(spark, sf_dir)))
    n, total = F.col("n_chars").cast("bigint"), F.col("total_chars").cast("bigint")
    return rows.select("page_id", "selector", n.alias("n_chars"), total.alias("total_chars"), F.round("score", 6).alias("score"))


@query
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.page_markdown(tokens_of(load_pages(spark, sf_dir)))


@query
def scrape_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.scrape_pages(tokens_of(load_pages(spark, sf_dir)))


@query
def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = pages.page_nodes(tokens_of(load_pages(spark, sf_dir)))
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n_nodes"))


@query
def dom_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.descendant_counts(tokens_of(load_pages(spark, sf_dir))).where("tag = 'nav'").select("page_id", "n_descendants")


@query
def dom_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.containment(tokens_of(load_pages(spark, sf_dir)))


@query
def code_markups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code blocks of pages that hold every markup."""
    return codeblocks.code_block_table(tokens_of(views.code_markups(spark, sf_dir)))


@query
def code_markup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as Markdown, with inline code."""
    return render.page_markdown(tokens_of(views.code_markups(spark, sf_dir)))


@query
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codeblocks.code_block_table(tokens_of(views.code_pages(spark, sf_dir)))


@query
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to records to chunks."""
    return archive.page_chunks(load_pages(spark, sf_dir))


# --- bundles ------------------------------------------------------------------------------------


def joined_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.extract_links(views.messages(spark, sf_dir))
    return links.scrape_join(found, page_records(spark, sf_dir, found))


@query
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tokens_of(views.meta_pages(spark, sf_dir))
    records = pages.page_metadata(tokens).withColumns({"archived_at": archived_at(), "content": F.lit("")})
    record = F.struct(*bundles.RECORD)
    return records.select("page_id", bundles.front_matter(record).alias("head"))


@query
def bundle_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.bundle_markdown(joined_records(spark, sf_dir), archived_at())


@query
def bundle_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return load_pages(spark, sf_dir).select("page_id", thread_name(title).alias("thread"), file_stem(title).alias("stem"))


@query
def archive_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages to delivery chunks, with real page content."""
    found = links.extract_links(views.messages(spark, sf_dir))
    scraped = archive.scrape_wanted(found, load_pages(spark, sf_dir), archived_at())
    return archive.archived_chunks(found, scraped, archived_at())


@query
def archive_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies in the outbox when the archive job has run twice over the same messages."""
    root = shared_dir(spark, "archive")
    messages, wanted = views.messages(spark, sf_dir), load_pages(spark, sf_dir)
    for _ in range(2):
        archive.run_archive(spark, messages, wanted, archived_at(), root)
    return delivered(spark, root, archive.OUTBOX)


@query
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown files of the archive job, read back."""
    paths = archive.run_archive(spark, views.messages(spark, sf_dir), load_pages(spark, sf_dir), archived_at())
    return spark.read.parquet(paths.files)


def archive_with_empty_pages(spark: SparkSession, sf_dir: str) -> archive.ArchivePaths:
    emptied = load_pages(spark, sf_dir).withColumn("html", F.when(F.col("page_id") % 9 == 0, "<html><body></body></html>").otherwise(F.col("html")))
    return archive.run_archive(spark, views.messages(spark, sf_dir), emptied, archived_at())


@query
def archive_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures that the archive job writes: links without a page and links to pages without content."""
    return spark.read.parquet(archive_with_empty_pages(spark, sf_dir).failed)


@query
def archive_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(archive_with_empty_pages(spark, sf_dir).summary)


@query
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thread and file names by the titles that the extraction finds."""
    rows = pages.page_metadata(tokens_of(load_pages(spark, sf_dir)))
    return rows.select("page_id", thread_name(F.col("title")).alias("thread"), file_stem(F.col("title")).alias("stem"))


# --- events -------------------------------------------------------------------------------------


@query
def reaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reactions.reaction_counts(views.reactions(spark, sf_dir)).select("event_id", "message_id", "emoji_name", "n")


ROUTED = ["event_id", "guild_id", "channel_id", "message_id", "user_id", "emoji_name", "n", "action"]


@query
def route_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reactions.route_reactions(views.reactions(spark, sf_dir), views.guilds(spark)).select(*ROUTED)


@query
def pin_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = reactions.route_reactions(views.reactions(spark, sf_dir), views.guilds(spark))
    return reactions.pin_retention(routed).select("channel_id", "message_id", F.col("rank").cast("bigint").alias("rank"))


@query
def guild_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reactions.upsert_guilds(views.guilds(spark), views.reactions(spark, sf_dir))


@query
def message_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reactions.message_cards(views.messages(spark, sf_dir))


@query
def bookmark_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = reactions.route_reactions(views.reactions(spark, sf_dir), views.guilds(spark))
    return reactions.bookmark_cards(routed, views.messages(spark, sf_dir))


@query
def bookmark_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards as they are sent, with portrait and files."""
    cards = bookmark_cards(spark, sf_dir).select("event_id", "user_id", "message_id", "author")
    sent = reactions.bookmark_deliveries(cards, views.media(spark, sf_dir))
    return sent.select("event_id", "user_id", "message_id", "author", "icon_url", F.array_join("files", " ").alias("files"), "files_left_out")


# --- registry -----------------------------------------------------------------------------------


@query
def command_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registry.dispatch_commands(views.interactions(spark, sf_dir), registry.command_registry(spark))
    return found.select("event_id", "name", "user_id", "has_autocomplete")


@query
def unknown_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.unknown_commands(views.interactions(spark, sf_dir), registry.command_registry(spark))


@query
def valid_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registry.valid_deletes(views.interactions(spark, sf_dir), views.messages(spark, sf_dir))
    return found.select("event_id", "message_id", "user_id")


@query
def delete_own_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = registry.delete_own_messages(views.interactions(spark, sf_dir), views.messages(spark, sf_dir))
    return kept.select("message_id", "username")


def channel_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.interactions(spark, sf_dir)
    return registry.join_requests(asked, reactions.upsert_guilds(views.guilds(spark), asked))


@query
def channel_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.get_or_create_channels(channel_requests(spark, sf_dir), views.channels(spark, sf_dir))


@query
def channel_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.channel_names(channel_requests(spark, sf_dir), views.channels(spark, sf_dir))


@query
def channel_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.channel_grants(channel_requests(spark, sf_dir))


@query
def channel_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.channels_with_prefix(views.channels(spark, sf_dir), "st").select("guild_id", "category_id", "name")


@query
def channel_autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request for completion with the channels that it may mean."""
    return registry.complete_channels(views.typed(spark, sf_dir), views.guilds(spark), views.channels(spark, sf_dir))


@query
def stored_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings stored by two versions with different columns, read together."""
    folder = shared_dir(spark, "settings")
    for stored in (views.OLD_SETTINGS, views.NEW_SETTINGS):
        views.spark_view(spark, sf_dir, stored).write.mode("append").parquet(folder)
    return load_guilds(spark, folder)


# --- streams ------------------------------------------------------------------------------------

FEED_PARTS = 3


def reaction_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a feed of several files that follow one another in time, one file a micro-batch."""
    events = load_table(spark, sf_dir, "events")
    feed = shared_dir(spark, "feed")
    cuts = events.select(F.percentile_approx("ts", [k / FEED_PARTS for k in range(1, FEED_PARTS)])).first()[0] or []
    # Rows without a time come first.
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        late = F.lit(True) if low is None else F.col("ts") >= F.lit(low)
        early = F.lit(True) if high is None else (F.col("ts") < F.lit(high)) | (F.col("ts").isNull() if low is None else F.lit(False))
        events.where(late & early).coalesce(1).write.mode("append").parquet(feed)
    return spark.sql(views.REACTIONS, events=event_stream(spark, feed, max_files=1))


def routed_feed(spark: SparkSession, sf_dir: str) -> str:
    """The folder in which the feed was routed."""
    out = shared_dir(spark, "reactions")
    start_routing(spark, reaction_feed(spark, sf_dir), lambda: views.guilds(spark), out).awaitTermination()
    return out


@query
def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{routed_feed(spark, sf_dir)}/routed").select(*ROUTED)


@query
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "counted")
    start_counting(spark, reaction_feed(spark, sf_dir), out).awaitTermination()
    return spark.read.parquet(out).groupBy("message_id", "emoji_name").agg(F.max("n").alias("n"))


@query
def stream_first_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects with every action held to once a message, in the running job."""
    out = routed_feed(spark, sf_dir)
    start_effects(spark, out, once=("bookmark", "pin", "link")).awaitTermination()
    return spark.read.parquet(f"{out}/effects").select("message_id", "action", "event_id")


@query
def stream_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects as they are carried out: one pin and one archive a message, one card a bookmark."""
    out = routed_feed(spark, sf_dir)
    start_effects(spark, out).awaitTermination()
    return spark.read.parquet(f"{out}/effects").select(*ROUTED)


@query
def stream_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pin and unpin of the text channels, and which of the pins last."""
    out = routed_feed(spark, sf_dir)
    start_effects(spark, out).awaitTermination()
    start_pins(spark, views.reaction_channels(spark, sf_dir), out, limit=PINS_KEPT).awaitTermination()
    log = spark.read.parquet(f"{out}/pins")
    lasting = pinned_now(log).select("channel_id", "message_id", F.lit(True).alias("lasts"))
    told = log.groupBy("channel_id", "message_id").agg(
        F.count_if(F.col("op") == "pin").alias("n_pins"), F.count_if(F.col("op") == "unpin").alias("n_unpins")
    )
    kept = told.join(lasting, ["channel_id", "message_id"], "left")
    return kept.select("channel_id", "message_id", "n_pins", "n_unpins", F.coalesce("lasts", F.lit(False)).alias("lasts"))


#: The limit of the query, which the small test tables reach too.
PINS_KEPT = 10


@query
def stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox of messages whose link reactions came in by the feed."""
    out = shared_dir(spark, "archived")
    start_archiving(
        spark, reaction_feed(spark, sf_dir), lambda: views.guilds(spark), views.messages(spark, sf_dir), load_pages(spark, sf_dir), archived_at(), out
    ).awaitTermination()
    return delivered(spark, f"{out}/archive", archive.OUTBOX)


@query
def pin_text_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest pins of text channels."""
    routed = reactions.route_reactions(views.reactions(spark, sf_dir), views.guilds(spark))
    kept = reactions.pin_retention(routed, channels=views.reaction_channels(spark, sf_dir))
    return kept.select("channel_id", "message_id", F.col("rank").cast("bigint").alias("rank"))
