"""Links of messages and their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import content_urls, extract_urls, fetch_key, site_of
from .chunking import explode_array
from .keybits import key_bits, may_hold


def extract_links(messages: DataFrame, match: str = "substring") -> DataFrame:
    """One row per content link of a message with content, in order: ``(message_id, pos, url)``."""
    withlinks = messages.where(F.contains("content", F.lit("://")))
    return explode_array(withlinks, content_urls(F.col("content"), match), "url", "message_id").select(
        "message_id", F.col("seq").alias("pos"), "url"
    )


def link_host_counts(messages: DataFrame) -> DataFrame:
    """All links, filtered or not, per site."""
    urls = explode_array(messages, extract_urls(F.col("content")), "url", "message_id")
    return urls.groupBy(site_of(F.col("url")).alias("site")).agg(F.count("*").alias("n_links"))


def wanted_pages(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that some link asks for, each address once.

    Links shrink to their distinct addresses before the join, so a link that everybody posts costs
    one row here, and its page is scraped once. Where an address has several pages the first one
    answers; the pick is made on ids alone, the HTML is read afterwards. A filter of the picked ids,
    of bounded size, meets the pages in their scan, so that pages nobody asks for are never moved.
    """
    keyed = pages.select("page_id", fetch_key(F.col("url")).alias("key"))
    keys = links.select(fetch_key(F.col("url")).alias("key")).distinct()
    chosen = keyed.join(keys, "key", "left_semi").groupBy("key").agg(F.min("page_id").alias("page_id"))
    return may_hold(pages, "page_id", key_bits(chosen, "page_id")).join(chosen, "page_id")


def scrape_join(links: DataFrame, scraped: DataFrame) -> DataFrame:
    """Links with the record of their page; the record columns are NULL for a failed link.

    ``scraped`` has one row per ``key``. The link side may hold one address in a third of its rows;
    adaptive execution splits such a partition, and no operator above needs the key's partitioning.
    """
    keyed = links.withColumn("key", fetch_key(F.col("url")))
    return keyed.join(scraped.drop("url"), "key", "left")


def failed_links(links: DataFrame, scraped: DataFrame) -> DataFrame:
    """Links without a page or with an empty one, each with its message."""
    keyed = links.withColumn("key", fetch_key(F.col("url")))
    missed = keyed.join(scraped.select("key"), "key", "left_anti")
    return missed.select("message_id", "pos", "url", F.concat(F.lit("Failed to scrape: "), F.col("url")).alias("error"))


def scrape_summary(joined: DataFrame) -> DataFrame:
    """Per message: how many of its links gave a page."""
    counts = joined.groupBy("message_id").agg(
        F.count("*").alias("n_links"), F.count_if(F.col("page_id").isNotNull()).alias("n_scraped")
    )
    text = F.concat(F.lit("Successfully scraped "), F.col("n_scraped"), F.lit(" out of "), F.col("n_links"), F.lit(" links"))
    return counts.where("n_scraped > 0").select("message_id", "n_links", "n_scraped", text.alias("summary"))


# Fixed patterns: an anchor's start tag, whose quoted values may hold any character, and its target in either quotes or in none.
ANCHOR_PATTERN = r"""(?i)<a\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
HREF_PATTERN = r"""(?i)\A<a(?:[^"'=]++(?<!\shref)(?<!\shref\s{1,9})=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))*+[^"'=]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def page_links(pages: DataFrame) -> DataFrame:
    """Raw link targets of a page's HTML, in order; ``href`` may stand anywhere in the tag."""
    anchors = F.filter(F.regexp_extract_all(F.col("html"), F.lit(ANCHOR_PATTERN), F.lit(0)), lambda tag: tag.rlike(HREF_PATTERN))
    hrefs = F.transform(anchors, lambda tag: F.concat(*[F.regexp_extract(tag, HREF_PATTERN, i) for i in (1, 2, 3)]))
    return explode_array(pages, hrefs, "href", "page_id", "url").withColumnRenamed("seq", "pos")
