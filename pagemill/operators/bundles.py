"""Scraped pages of a message as one Markdown document, with names and front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import built_once, derive, extend, let
from ..functions.text import clean_lines, file_stem, iso_millis, json_quote, pad_utf16, thread_name, trim_ws, unpad_utf16
from .chunking import MAX_CHARS, atoms, chunk, delivered, explode_array, measure, packed_groups

RECORD = ["title", "content", "url", "archived_at", "author", "published_at", "description", "site_name"]


def _given(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _yaml_line(name: str, value: Column) -> Column:
    """``name: "value"``; a text of several lines becomes a block; NULL gives NULL."""
    block = F.concat(F.lit(f"{name}: |\n  "), F.replace(value, F.lit("\n"), F.lit("\n  ")))
    return F.when(F.contains(value, F.lit("\n")), block).otherwise(F.concat(F.lit(f"{name}: "), json_quote(value)))


def front_matter(r: Column) -> Column:
    """YAML head of one page."""
    return F.concat_ws(
        "\n",
        F.lit("---"),
        _yaml_line("title", r["title"]),
        _yaml_line("source", r["url"]),
        _yaml_line("archived", iso_millis(r["archived_at"])),
        _yaml_line("author", _given(r["author"])),
        _yaml_line("published", iso_millis(r["published_at"])),
        _yaml_line("description", _given(r["description"])),
        _yaml_line("site", _given(r["site_name"])),
        F.lit("---"),
    )


def single_markdown(r: Column) -> Column:
    return F.concat(front_matter(r), F.lit("\n\n"), r["content"])


SOURCES_HEAD = '---\ntitle: "Scraped Content"\nsources:\n'


def source_lines(p: Column) -> Column:
    """A page in the list of sources."""
    return F.concat_ws(
        "\n",
        F.lit("  -"),
        F.concat(F.lit("    title: "), json_quote(p["title"])),
        F.concat(F.lit("    url: "), json_quote(p["url"])),
        F.concat(F.lit("    author: "), json_quote(p["author"])),
        F.concat(F.lit("    published: "), json_quote(iso_millis(p["published_at"]))),
    )


def sources_tail(archived_at: Column) -> Column:
    return F.concat(F.lit("\narchived: "), json_quote(iso_millis(archived_at)), F.lit("\n---"))


def combined_front_matter(pages: Column, archived_at: Column) -> Column:
    """YAML head of a bundle: a fixed title, the list of sources and the time."""
    return F.concat(F.lit(SOURCES_HEAD), F.array_join(F.transform(pages, source_lines), "\n"), sources_tail(archived_at))


def bundle_heading(n_pages: Column) -> Column:
    return F.concat(F.lit("# Scraped Content ("), n_pages.cast("string"), F.lit(" links)"))


def section_heading(number: Column, title: Column) -> Column:
    return F.concat(F.lit("## "), number.cast("string"), F.lit(". "), title)


def section_body(p: Column) -> Column:
    """Source, time and content of a page, closed by a rule."""
    return F.concat(
        F.lit("**Source:** ["),
        p["url"],
        F.lit("]("),
        p["url"],
        F.lit(")  \n**Scraped:** "),
        iso_millis(p["archived_at"]),
        F.lit("\n\n"),
        p["content"],
        F.lit("\n\n---"),
    )


def sections(pages: Column) -> Column:
    """Numbered sections with source and time, each closed by a rule."""

    def section(p: Column, i: Column) -> Column:
        return F.concat(section_heading(i + 1, p["title"]), F.lit("\n\n"), section_body(p), F.lit("\n\n"))

    return F.array_join(F.transform(pages, section), "")


def combined_markdown(pages: Column, archived_at: Column) -> Column:
    """Markdown of any number of pages: a notice for none, the plain form for one."""
    many = F.concat(
        combined_front_matter(pages, archived_at),
        F.lit("\n\n"),
        bundle_heading(F.size(pages)),
        F.lit("\n\n"),
        sections(pages),
    )
    one = let(lambda b: single_markdown(b["p"]), p=F.get(pages, F.lit(0)))
    return F.when(F.size(pages) == 0, "# No content scraped").when(F.size(pages) == 1, one).otherwise(many)


def bundle_title(pages: Column) -> Column:
    first = F.coalesce(_given(F.get(pages, F.lit(0))["title"]), F.lit("Scraped Content"))
    return F.when(F.size(pages) == 1, first).otherwise(F.concat(F.lit("Scraped Content ("), F.size(pages).cast("string"), F.lit(" links)")))


def bundle_file(pages: Column, archived_at: Column, message_id: Column) -> Column:
    """File name: from the title of a single page, else from the time; the id makes it unique."""
    stem = F.when(F.size(pages) == 1, file_stem(F.get(pages, F.lit(0))["title"])).otherwise(
        F.concat(F.lit("scraped-content-"), F.unix_millis(archived_at).cast("string"))
    )
    return F.concat(stem, F.lit("-"), message_id.cast("string"), F.lit(".md"))


def collect_pages(joined: DataFrame) -> DataFrame:
    """Scraped pages of each message as an array in link order.

    A group holds the links of one message, so its size is bounded by that message's own text.
    """
    hits = joined.where(F.col("page_id").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("pos", *RECORD)))
    return hits.groupBy("message_id").agg(ordered.alias("pages"))


def bundle_markdown(joined: DataFrame, archived_at: Column) -> DataFrame:
    """One Markdown file per message: ``(message_id, n_pages, thread, filename, body)``."""
    pages = F.col("pages")
    return collect_pages(joined).select(
        "message_id",
        F.size(pages).alias("n_pages"),
        thread_name(bundle_title(pages)).alias("thread"),
        bundle_file(pages, archived_at, F.col("message_id")).alias("filename"),
        combined_markdown(pages, archived_at).alias("body"),  # whole; only the file sink has a limit
    )


def _units16(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(pad_utf16(text))


@built_once
def _piece_units(limit: int) -> Column:
    """Units of a piece: a page of a bundle with the headings that belong to it, or the one page there is."""
    page = F.struct(*RECORD)
    alone, first, last = F.col("n_pages") == 1, F.col("number") == 1, F.col("number") == F.col("n_pages")
    opening = F.concat(bundle_heading(F.col("n_pages")), F.lit("\n\n"), section_heading(F.lit(1), F.col("title")), F.lit("\n\n"))
    following = F.concat(F.lit("\n\n"), section_heading(F.col("number") + 1, F.col("next_title")))
    body = F.concat(F.when(first, opening).otherwise(""), section_body(page), F.when(last, "").otherwise(following))
    text = let(lambda b: pad_utf16(b["c"]), c=clean_lines(F.when(alone, F.col("content")).otherwise(body)))
    return let(lambda b: F.when(F.col("is_whole"), F.array(chunk("paragraph", b["t"]))).otherwise(atoms(b["t"], limit)), t=text)


@built_once
def _part_bounds(limit: int) -> Column:
    whole = F.array(F.struct(F.lit(1).alias("s"), F.size("all_sizes").alias("e")))
    return F.when(F.col("is_whole"), whole).otherwise(packed_groups(F.col("all_sizes"), limit))


@built_once
def _part_chunks(limit: int) -> Column:
    """A packed part as it is delivered."""
    single = F.col("n_units") == 1
    built = chunk(
        F.when(single, F.col("type")).otherwise("paragraph"),
        unpad_utf16(F.when(single, F.col("content")).otherwise(trim_ws(F.col("content")))),
        F.when(single, F.col("language")),
    )
    return let(lambda b: F.when(F.col("is_whole"), F.array(b["c"])).otherwise(delivered(b["c"], limit)), c=built)


def bundle_chunks(joined: DataFrame, archived_at: Column, limit: int = MAX_CHARS) -> DataFrame:
    """Delivery chunks of every message's bundle: ``(message_id, seq, n_chunks, type, content, language)``.

    The chunks are those of the bundle's text as a whole, and no row ever holds that text. A bundle is cut where
    packing cuts it in any case, behind the heading of each section; a piece is a page with the heading of the next
    one. Each piece is split into units in its own row. Only their measures, three numbers a unit, come together per
    message; the packing tells the group of every unit, and the text of a group is joined, which is one chunk. A bundle
    within the limit goes out whole. Code that a page never closes ends with its piece.
    """
    page = F.struct(*RECORD)
    order = Window.partitionBy("message_id").orderBy("pos")
    whole = Window.partitionBy("message_id")
    hits = joined.where(F.col("page_id").isNotNull()).select("message_id", "pos", *RECORD)
    placed = hits.withColumns(
        {
            "number": F.row_number().over(order),
            "next_title": F.lead("title").over(order),
            "n_pages": F.count(F.lit(1)).over(whole),
            "source_size": _units16(source_lines(page)) + 1,
            "section_size": _units16(section_heading(F.lit(1), F.col("title"))) + _units16(section_body(page)) + 4,
            "single_size": _units16(front_matter(page)) + 2 + _units16(F.col("content")),
        }
    )
    # The text of a bundle of several pages, without building it; numbers of more than one digit count in the headings.
    heads = F.length(F.lit(SOURCES_HEAD)) - 1 + _units16(sources_tail(archived_at)) + 4 + _units16(bundle_heading(F.col("n_pages")))
    several = heads + F.sum(F.col("source_size") + F.col("section_size") + F.length(F.col("number").cast("string")) - 1).over(whole)
    sized = placed.withColumn("is_whole", F.when(F.col("n_pages") == 1, F.col("single_size")).otherwise(several) <= limit)

    pieces = derive(sized, F.array(F.struct(_piece_units(limit).alias("units"))), "message_id", "number", "is_whole")
    measured = pieces.withColumn("sizes", F.transform("units", measure))
    ranked = F.array_sort(F.collect_list(F.struct("number", "sizes")).over(whole))
    gathered = measured.withColumns({"all_sizes": F.flatten(F.transform(ranked, lambda r: r["sizes"])), "ranked": ranked})
    before = F.aggregate(
        F.filter("ranked", lambda r: r["number"] < F.col("number")), F.lit(0), lambda n, r: n + F.size(r["sizes"])
    )
    grouped = extend(
        gathered.select("message_id", "number", "is_whole", "units", before.alias("before"), "all_sizes"),
        groups=_part_bounds(limit),
    )
    exploded = grouped.select("message_id", "number", "is_whole", "before", "groups", F.posexplode("units").alias("at", "unit"))
    place = F.col("before") + F.col("at") + 1
    group = F.size(F.filter("groups", lambda g: g["s"] <= place))
    rows = exploded.select("message_id", "is_whole", group.alias("part"), place.alias("place"), "unit.*")
    joined_text = F.expr("listagg(content, '\n\n') WITHIN GROUP (ORDER BY place)")
    parts = rows.groupBy("message_id", "part").agg(
        F.count(F.lit(1)).alias("n_units"),
        F.bool_or("is_whole").alias("is_whole"),
        joined_text.alias("content"),
        F.min("type").alias("type"),
        F.min("language").alias("language"),
    )
    out = explode_array(parts, _part_chunks(limit), "c", "message_id", "part")
    sequence = Window.partitionBy("message_id").orderBy("part", "seq")
    return out.select(
        "message_id",
        (F.row_number().over(sequence) - 1).alias("seq"),
        F.count(F.lit(1)).over(whole).cast("int").alias("n_chunks"),
        "c.type",
        "c.content",
        "c.language",
    )
