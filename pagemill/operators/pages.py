"""Boilerplate, content region and metadata of tokenised pages.

Each expression works on one page's token arrays, so the whole extraction runs in the stage that
tokenises: nothing is exploded and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import built_once, derive, extend, let, pick
from ..functions.text import collapse_ws, parse_date, trim_ws, utf16_length
from ..functions.urls import site_of
from ..sources.html import TEXT


@dataclass(frozen=True)
class Selector:
    """A simple element test: tag, class, id or attribute (any value when ``value`` is None)."""

    text: str
    tag: str | None = None
    cls: str | None = None
    attr: str | None = None
    value: str | None = None

    def matches(self, e: Column) -> Column:
        tests = []
        if self.tag:
            tests.append(e["tag"] == self.tag)
        if self.cls:
            tests.append(F.array_contains(e["cls"], self.cls))
        if self.attr:
            found = F.element_at(e["attrs"], self.attr)
            tests.append(found.isNotNull() if self.value is None else F.coalesce(found == self.value, F.lit(False)))
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out


def _meta(attr: str, value: str) -> Selector:
    return Selector(f'meta[{attr}="{value}"]', tag="meta", attr=attr, value=value)


# What is removed everywhere, and what is removed inside the chosen region too.
BOILERPLATE_TAGS = ["script", "style", "nav", "header", "footer", "aside"]
BOILERPLATE_CLASSES = ["advertisement", "ads"]
REGION_CLASSES = ["social-share", "share-buttons", "comments", "comment-section"]

# Selectors in order of preference.
CONTENT_SELECTORS = [
    Selector("article", tag="article"),
    Selector("main", tag="main"),
    Selector(".content", cls="content"),
    Selector(".post", cls="post"),
    Selector(".entry", cls="entry"),
    Selector("#content", attr="id", value="content"),
    Selector(".main-content", cls="main-content"),
    Selector(".article-content", cls="article-content"),
    Selector(".post-content", cls="post-content"),
    Selector(".entry-content", cls="entry-content"),
    Selector('[role="main"]', attr="role", value="main"),
    Selector(".page-content", cls="page-content"),
    Selector(".story-content", cls="story-content"),
]
AUTHOR_SELECTORS = [
    _meta("name", "author"),
    _meta("property", "article:author"),
    _meta("property", "og:article:author"),
    Selector('[rel="author"]', attr="rel", value="author"),
    Selector(".author", cls="author"),
    Selector(".byline", cls="byline"),
    Selector("[data-author]", attr="data-author"),
]
DATE_SELECTORS = [
    _meta("name", "article:published_time"),
    _meta("property", "article:published_time"),
    _meta("name", "date"),
    _meta("property", "og:article:published_time"),
    Selector("time[datetime]", tag="time", attr="datetime"),
    Selector("[data-published]", attr="data-published"),
]
DESCRIPTION_SELECTORS = [
    _meta("name", "description"),
    _meta("property", "og:description"),
    _meta("name", "twitter:description"),
]
SITE_SELECTORS = [
    _meta("property", "og:site_name"),
    _meta("name", "application-name"),
    _meta("property", "og:title"),
]

# Weights of the region score.
ARTICLE_WEIGHT = 3.0
MAIN_WEIGHT = 1.1
SHORT_WEIGHT = 0.1
SHORT_LENGTH = 100
MIN_SHARE = 10
UNTITLED = "Untitled"


def is_boilerplate(e: Column, classes: list[str]) -> Column:
    return e["tag"].isin(BOILERPLATE_TAGS) | F.arrays_overlap(e["cls"], F.array(*[F.lit(c) for c in classes]))


def topmost(items: Column) -> Column:
    """Items (id, last and other fields, in the order of ids) that lie in no other item."""

    def fold(b: Column) -> Column:
        def step(acc: Column, e: Column) -> Column:
            taken = F.struct(F.array_append(acc["done"], e).alias("done"), e["last"].alias("until"))
            return F.when(e["id"] > acc["until"], taken).otherwise(acc)

        none = F.struct(F.slice(b["items"], 1, 0).alias("done"), F.lit(-1).alias("until"))
        return F.aggregate(b["items"], none, step, lambda acc: acc["done"])

    return let(fold, items=items)


def covered(size: Column, tops: Column) -> Column:
    """Per element of ``size``: does it lie in one of ``tops`` (id, last), which are apart and in order."""

    def fill(b: Column) -> Column:
        def part(t: Column, i: Column) -> Column:
            before = F.when(i == 0, 0).otherwise(pick(b["tops"], i - 1)["last"] + 1)
            return F.concat(F.array_repeat(F.lit(False), t["id"] - before), F.array_repeat(F.lit(True), t["last"] - t["id"] + 1))

        end = F.coalesce(pick(b["tops"], F.size(b["tops"]) - 1)["last"] + 1, F.lit(0))
        return F.concat(F.flatten(F.transform(b["tops"], part)), F.array_repeat(F.lit(False), b["size"] - end))

    return let(fill, tops=tops, size=size)


def removed_flags(elements: Column, classes: list[str] | None = None) -> Column:
    """Per element: is it boilerplate or inside boilerplate."""
    names = classes or BOILERPLATE_CLASSES
    hits = F.filter(elements, lambda e: is_boilerplate(e, names))
    spans = F.transform(hits, lambda e: F.struct(e["id"].alias("id"), e["last"].alias("last")))
    return covered(F.size(elements), topmost(spans))


def live_elements(elements: Column, removed: Column) -> Column:
    return F.filter(elements, lambda e: ~pick(removed, e["id"]))


def text_between(tokens: Column, removed: Column, start: Column, stop: Column) -> Column:
    """Text inside an element without its removed parts, in document order."""
    inside = F.slice(tokens, start + 1, stop - start + 1)
    kept = F.filter(inside, lambda t: (t["kind"] == TEXT) & ~pick(removed, t["el"]))
    return F.array_join(F.transform(kept, lambda t: t["text"]), "")


def element_text(page: Page, e: Column) -> Column:
    return text_between(page["tokens"], page["removed"], e["open"], e["close"])


def all_text(page: Page, elements: Column) -> Column:
    return F.array_join(F.transform(elements, lambda e: element_text(page, e)), "")


Page = dict[str, Column]


def page_columns() -> Page:
    """Columns of a flagged page, by the short names the expressions use."""
    return {"els": F.col("elements"), "tokens": F.col("tokens"), "removed": F.col("removed")}


def flagged(tokens: DataFrame) -> DataFrame:
    """Tokenised pages with ``removed``: per element, is it part of boilerplate."""
    return extend(tokens, removed=removed_flags(F.col("elements")))


REGION = ["selector", "id", "open", "close", "n_chars", "total_chars", "score"]


def with_region(pages: DataFrame) -> DataFrame:
    """Flagged pages with the position of their content region: region_id, region_open, region_close."""
    found = derive(pages, F.array(region_expression()), *pages.columns)
    return found.withColumnsRenamed({name: f"region_{name}" for name in ("id", "open", "close")}).drop(
        *[name for name in REGION if name not in ("id", "open", "close")]
    )


@built_once
def region_expression() -> Column:
    return best_region(page_columns())


@built_once
def metadata_expression() -> Column:
    return metadata_of(page_columns(), F.col("url"))


def candidates(page: Page) -> Column:
    """Live elements per content selector: (pos, id, open, close, n) with the text length."""
    def found(marked: Column, pos: int, selector: Selector) -> Column:
        return F.transform(
            F.filter(marked, selector.matches),
            lambda e: F.struct(
                F.lit(pos).alias("pos"),
                e["id"].alias("id"),
                e["open"].alias("open"),
                e["close"].alias("close"),
                utf16_length(collapse_ws(element_text(page, e))).alias("n"),
            ),
        )

    # Only elements that can match are tested against every selector.
    marked = F.filter(
        page["els"],
        lambda e: ~pick(page["removed"], e["id"]) & (e["tag"].isin("article", "main") | (F.size(F.map_keys(e["attrs"])) > 0)),
    )
    return let(
        lambda b: F.flatten(F.array(*[found(b["marked"], pos, s) for pos, s in enumerate(CONTENT_SELECTORS)])),
        marked=marked,
    )


def region_score(n: Column, total: Column, pos: Column) -> Column:
    """Share of the body text in percent, weighted by element type and cut for short texts."""
    share = n / total * F.lit(100)
    weighted = F.when(pos == 0, share * F.lit(ARTICLE_WEIGHT)).when(pos == 1, share * F.lit(MAIN_WEIGHT)).otherwise(share)
    return F.when(n < SHORT_LENGTH, weighted * F.lit(SHORT_WEIGHT)).otherwise(weighted)


def best_region(page: Page) -> Column:
    """The content region: (selector, id, open, close, n_chars, total_chars, score).

    The highest score wins, the earlier selector and then the earlier element on ties. Where no
    candidate qualifies, the first element of the first matching selector is taken, else the body.
    """
    body = pick(F.filter(page["els"], lambda e: e["tag"] == "body"), 0)
    names = F.array(*[F.lit(s.text) for s in CONTENT_SELECTORS])

    def region(selector: Column, c: Column, n: Column, total: Column, score: Column) -> Column:
        return F.struct(
            selector.alias("selector"),
            c["id"].alias("id"),
            c["open"].alias("open"),
            c["close"].alias("close"),
            n.alias("n_chars"),
            total.alias("total_chars"),
            score.alias("score"),
        )

    def choose(b: Column) -> Column:
        scored = F.transform(
            F.filter(b["found"], lambda c: (c["n"] > 0) & (c["n"] / b["total"] * 100 >= MIN_SHARE)),
            lambda c: F.struct(region_score(c["n"], b["total"], c["pos"]).alias("score"), (-c["pos"]).alias("p"), (-c["open"]).alias("o"), c.alias("c")),
        )
        first = pick(F.array_sort(b["found"]), 0)
        no_score = F.lit(None).cast("double")
        return let(
            lambda r: F.when(
                r["best"].isNotNull(),
                region(pick(names, r["best"]["c"]["pos"]), r["best"]["c"], r["best"]["c"]["n"], b["total"], r["best"]["score"]),
            )
            .when((b["total"] > 0) & r["first"].isNotNull(), region(pick(names, r["first"]["pos"]), r["first"], r["first"]["n"], b["total"], no_score))
            .otherwise(region(F.lit("body"), b["body"], b["total"], b["total"], no_score)),
            best=F.array_max(scored),
            first=first,
        )

    return let(
        lambda a: let(
            choose,
            body=a["body"],
            found=candidates(page),
            total=utf16_length(collapse_ws(element_text(page, a["body"]))),
        ),
        body=body,
    )


def first_value(values: list[Column]) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def title_of(page: Page) -> Column:
    live = live_elements(page["els"], page["removed"])
    titles = F.filter(live, lambda e: e["tag"] == "title")
    headings = F.filter(live, lambda e: e["tag"] == "h1")
    head_text = let(lambda b: element_text(page, b["e"]), e=pick(headings, 0))
    return F.coalesce(first_value([trim_ws(all_text(page, titles)), trim_ws(head_text)]), F.lit(UNTITLED))


def _attribute_then_text(page: Page, selector: Selector, names: list[str], marked: Column) -> Column:
    found = F.filter(marked, selector.matches)
    return let(
        lambda b: first_value([F.element_at(pick(b["found"], 0)["attrs"], name) for name in names] + [trim_ws(all_text(page, b["found"]))]),
        found=found,
    )


def _date(page: Page, selector: Selector, marked: Column) -> Column:
    return let(lambda b: parse_date(b["text"]), text=_attribute_then_text(page, selector, ["content", "datetime"], marked))


def _meta_value(selector: Selector, marked: Column) -> Column:
    return F.nullif(trim_ws(F.element_at(pick(F.filter(marked, selector.matches), 0)["attrs"], "content")), F.lit(""))


def metadata_of(page: Page, url: Column) -> Column:
    """title, author, published_at, description, site_name: the first non-empty value per list."""
    marked = F.filter(page["els"], lambda e: ~pick(page["removed"], e["id"]) & (F.size(F.map_keys(e["attrs"])) > 0))

    def fields(b: Column) -> Column:
        m = b["marked"]
        author = F.coalesce(*[_attribute_then_text(page, s, ["content"], m) for s in AUTHOR_SELECTORS])
        published = F.coalesce(*[_date(page, s, m) for s in DATE_SELECTORS])
        description = F.coalesce(*[_meta_value(s, m) for s in DESCRIPTION_SELECTORS])
        site = F.coalesce(*[_meta_value(s, m) for s in SITE_SELECTORS], site_of(url))
        return F.struct(
            title_of(page).alias("title"),
            author.alias("author"),
            published.alias("published_at"),
            description.alias("description"),
            site.alias("site_name"),
        )

    return let(fields, marked=marked)


def page_metadata(tokens: DataFrame) -> DataFrame:
    return derive(flagged(tokens), F.array(metadata_expression()), "page_id", "url")


def main_regions(tokens: DataFrame) -> DataFrame:
    return derive(flagged(tokens), F.array(region_expression()), "page_id")


def page_nodes(tokens: DataFrame) -> DataFrame:
    """Relational view: one row per element, with its interval in the token order."""
    from .chunking import explode_array

    rows = explode_array(tokens, F.col("elements"), "e", "page_id")
    return rows.select("page_id", "e.*")


def descendant_counts(tokens: DataFrame) -> DataFrame:
    """Descendants of every node: ids grow in document order, so they are those up to the last one."""
    return page_nodes(tokens).select("page_id", "id", "tag", (F.col("last") - F.col("id")).cast("long").alias("n_descendants"))


def containment(tokens: DataFrame) -> DataFrame:
    """Per page and tag: how many elements there are and how many elements they contain in all."""
    return descendant_counts(tokens).groupBy("page_id", "tag").agg(F.count("*").alias("n_nodes"), F.sum("n_descendants").alias("n_descendants"))
