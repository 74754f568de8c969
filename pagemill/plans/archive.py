"""Whole jobs: pages to records, and messages to archived bundles and chunks."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import absolutize_markdown, fetch_key
from ..operators.bundles import bundle_chunks, bundle_markdown
from ..operators.chunking import chunk_documents
from ..operators.links import extract_links, failed_links, scrape_join, scrape_summary, wanted_pages
from ..operators.render import scrape_pages
from ..session import shared_dir
from ..sources.html import page_tokens
from ..sources.sinks import batch_folder, commit, committed, deliver, write_markdown


def page_chunks(pages: DataFrame) -> DataFrame:
    """Pages to Markdown to chunks, with links resolved against the page; one stage, no shuffle."""
    records = scrape_pages(page_tokens(pages))
    return chunk_documents(records, "page_id", "content", "url")


def scrape_wanted(links: DataFrame, pages: DataFrame, archived_at: Column) -> DataFrame:
    """One record per wanted address, pages without content left out."""
    records = scrape_pages(page_tokens(wanted_pages(links, pages)))
    return records.withColumns({"key": fetch_key(F.col("url")), "archived_at": archived_at})


def archived_bundles(links: DataFrame, scraped: DataFrame, archived_at: Column, resolve: bool = False) -> DataFrame:
    """Bundles per message. ``resolve`` makes links absolute, each page against its own address."""
    joined = scrape_join(links, _resolved(scraped) if resolve else scraped)
    return bundle_markdown(joined, archived_at)


def _resolved(scraped: DataFrame) -> DataFrame:
    return scraped.withColumn("content", absolutize_markdown(F.col("content"), F.col("url")))


def archived_chunks(links: DataFrame, scraped: DataFrame, archived_at: Column) -> DataFrame:
    """Delivery chunks of every message's bundle, page by page."""
    return bundle_chunks(scrape_join(links, _resolved(scraped)), archived_at)


@dataclass(frozen=True)
class ArchivePaths:
    scraped: str
    files: str
    outbox: str
    failed: str
    summary: str


OUTBOX = "message_id bigint, seq int, n_chunks int, type string, content string, language string"


def archive_paths(root: str, batch: int | str) -> ArchivePaths:
    return ArchivePaths(*[f"{batch_folder(root, batch)}/{name}" for name in ["scraped", "files", "outbox", "failed", "summary"]])


def run_archive(
    spark: SparkSession, messages: DataFrame, pages: DataFrame, archived_at: Column, root: str | None = None, batch: int | str | None = None
) -> ArchivePaths:
    """Archive all messages and write every result table into the batch's folder under ``root``.

    Without a number the run is a batch of its own. A batch that is committed is not run again, and one that broke off
    overwrites what it left. Chunks that an earlier batch delivered are not written again.

    Links and records are read by several results, so both are written once to the shared folder
    first: a lost executor then costs a re-read and not a re-parse.
    """
    root = root or shared_dir(spark, "archive")
    batch = uuid.uuid4().hex if batch is None else batch
    paths = archive_paths(root, batch)
    if str(batch) in committed(spark, root):
        return paths
    kept_links = f"{batch_folder(root, batch)}/links"
    extract_links(messages).write.mode("overwrite").parquet(kept_links)
    links = spark.read.parquet(kept_links)
    scrape_wanted(links, pages, archived_at).write.mode("overwrite").parquet(paths.scraped)
    scraped = spark.read.parquet(paths.scraped)
    write_markdown(archived_bundles(links, scraped, archived_at), paths.files, "overwrite")
    deliver(archived_chunks(links, scraped, archived_at), root, batch)
    failed_links(links, scraped).write.mode("overwrite").parquet(paths.failed)
    scrape_summary(scrape_join(links, scraped.drop("content"))).write.mode("overwrite").parquet(paths.summary)
    commit(spark, root, batch)
    return paths
