"""Content region to Markdown.

Every token of the region maps to a short piece of marked-up text; the pieces are joined once, and
a fixed chain of replacements settles line breaks, blanks and empty marks. Marks are
noncharacters, which the tokenizer keeps out of page text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import built_once, derive, extend, let, pick
from ..functions.text import FENCE, clean_markdown, is_blank
from ..sources.html import CLOSE, OPEN, PREFIXED
from .codeblocks import code_blocks_expression, inside
from .pages import (
    BOILERPLATE_CLASSES,
    REGION_CLASSES,
    Page,
    covered,
    flagged,
    metadata_expression,
    page_columns,
    removed_flags,
    with_region,
)

# Marks. A break is PARA or LINE, then the line prefix of the place, then END; a forced line break
# is SOFT, the prefix, SOFT_END.
PARA, LINE, SOFT, END = (chr(0xFDD0 + i) for i in range(4))
SOFT_END = chr(0xFDD8)
HEAD_ON, HEAD_OFF = chr(0xFDD4), chr(0xFDD5)
ITEM_ON, ITEM_OFF = chr(0xFDD6), chr(0xFDD7)
STRONG_ON, STRONG_OFF = chr(0xFDE0), chr(0xFDE1)
EM_ON, EM_OFF = chr(0xFDE2), chr(0xFDE3)
CODE_ON, CODE_OFF = chr(0xFDE4), chr(0xFDE5)
LINK_ON, LINK_OFF, LINK_END = chr(0xFDE6), chr(0xFDE7), chr(0xFDE8)
BLOCK_MARK = chr(0xFDEA)

# Elements that stand on lines of their own.
BLOCK_TAGS = (
    "address article aside audio blockquote body canvas center dd dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html isindex li main menu nav noframes noscript ol output p pre section "
    "table tbody td tfoot th thead tr ul video"
).split()


def _break(kind: Column | str, prefix: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, prefix, F.lit(END))


def _attr(e: Column, name: str) -> Column:
    return F.coalesce(F.element_at(e["attrs"], name), F.lit(""))


def _title(e: Column) -> Column:
    title = F.regexp_replace(_attr(e, "title"), r"(\n+\s*)+", "\n")
    return F.when(title != "", F.concat(F.lit(' "'), title, F.lit('"'))).otherwise("")


def _marks(page: Page, e: Column) -> Column:
    """Opening and closing text of one element inside the region."""
    region = pick(page["els"], F.col("region_id"))
    outside = F.length(region["path"]) + F.when(region["tag"].isin(*PREFIXED), 1).otherwise(0)
    prefix = F.replace(F.replace(F.substring(e["path"], outside + 1, F.length(e["path"])), F.lit("l"), F.lit("    ")), F.lit("q"), F.lit("> "))

    def pair(b: Column) -> Column:
        para = _break(PARA, b["prefix"])
        line = _break(LINE, b["prefix"])
        level = F.substring(e["tag"], 2, 1).cast("int")
        parent = b["parent"]
        nested = (parent["tag"] == "li") & (e["nth"] == parent["kids"] - 1)
        given = _attr(parent, "start")
        start = F.coalesce(F.when(given.rlike("^[0-9]+$"), given.try_cast("bigint")), F.lit(1))
        marker = F.when(parent["tag"] == "ol", F.concat((start + e["nth"]).cast("string"), F.lit(".  "))).otherwise("-   ")
        href = _attr(e, "href")
        image = F.concat(
            F.lit("!["), F.regexp_replace(_attr(e, "alt"), r"(\n+\s*)+", "\n"), F.lit("]("), _attr(e, "src"), _title(e), F.lit(")")
        )

        def both(opening: Column, closing: Column) -> Column:
            return F.struct(b["prefix"].alias("prefix"), opening.alias("on"), closing.alias("off"))

        return (
            F.when(e["tag"].rlike(r"\Ah[1-6]\z"), both(F.concat(para, F.lit(HEAD_ON), F.repeat(F.lit("#"), level), F.lit(HEAD_OFF)), para))
            .when(e["tag"] == "br", both(F.concat(F.lit(SOFT), b["prefix"], F.lit(SOFT_END)), F.lit("")))
            .when(e["tag"] == "hr", both(F.concat(para, F.lit("* * *"), para), F.lit("")))
            .when(e["tag"] == "li", both(F.concat(line, F.lit(ITEM_ON), marker, F.lit(ITEM_OFF)), line))
            .when(e["tag"].isin("ul", "ol"), F.when(nested, both(line, line)).otherwise(both(para, para)))
            .when(e["tag"].isin(BLOCK_TAGS), both(para, para))
            .when(e["tag"].isin("strong", "b"), both(F.lit(STRONG_ON), F.lit(STRONG_OFF)))
            .when(e["tag"].isin("em", "i"), both(F.lit(EM_ON), F.lit(EM_OFF)))
            .when(e["tag"] == "code", both(F.lit(CODE_ON), F.lit(CODE_OFF)))
            .when(
                (e["tag"] == "a") & (href != ""),
                both(F.lit(LINK_ON), F.concat(F.lit(LINK_OFF), F.regexp_replace(href, r"([()])", r"\\$1"), _title(e), F.lit(LINK_END))),
            )
            .when((e["tag"] == "img") & (_attr(e, "src") != ""), both(image, F.lit("")))
            .otherwise(both(F.lit(""), F.lit("")))
        )

    return let(pair, prefix=prefix, parent=pick(page["els"], e["parent"]))


# What is escaped anywhere in a text, and what at its start.
ESCAPED_ANYWHERE = r"([\\*`\[\]_])"
ESCAPED_AT_START = r"(-|\+ |=+|#{1,6} |~~~|>)"


def _escaped(text: Column) -> Column:
    out = F.regexp_replace(text, ESCAPED_ANYWHERE, r"\\$1")
    out = F.regexp_replace(out, rf"\A{ESCAPED_AT_START}", r"\\$1")
    return F.regexp_replace(out, r"\A([0-9]+)\. ", r"$1\\. ")


def _piece(page: Page, b: Page, t: Column) -> Column:
    """Text of one token: element marks, escaped page text, or the mark of a code block."""
    e = pick(page["els"], t["el"])
    marks = pick(b["marks"], t["el"] - F.col("region_id") - 1)
    text = F.regexp_replace(t["text"], r"[ \t\r\n]+", " ")
    in_code = (e["tag"] == "code") | (pick(page["els"], e["parent"])["tag"] == "code")
    block = F.concat(F.lit(LINE), marks["prefix"], F.lit(END + BLOCK_MARK + LINE), marks["prefix"], F.lit(END))
    return (
        F.when(pick(b["hidden"], t["el"]) == 2, F.when((t["kind"] == OPEN) & F.array_contains(b["tops"], t["el"]), block).otherwise(""))
        .when(pick(b["hidden"], t["el"]) == 1, "")
        .when(t["kind"] == OPEN, marks["on"])
        .when(t["kind"] == CLOSE, marks["off"])
        .when(in_code, text)
        .otherwise(_escaped(text))
    )


BREAK = f"[{PARA}{LINE}]([^{END}]*){END}"
BREAK_ANY = f"[{PARA}{LINE}][^{END}]*{END}"
OPENERS = f"[{STRONG_ON}{EM_ON}{CODE_ON}{LINK_ON}]"
CLOSERS = f"(?:[{STRONG_OFF}{EM_OFF}{CODE_OFF}]|{LINK_OFF}[^{LINK_END}]*{LINK_END})"
MARKS_RANGE = f"{STRONG_ON}-{LINK_END}"
INLINE = f"(?:{OPENERS}|{CLOSERS})"


# What a mark becomes once breaks and blanks are settled.
PLAIN_MARKS = [
    (ITEM_ON, ""),
    (ITEM_OFF, ""),
    (STRONG_ON, "**"),
    (STRONG_OFF, "**"),
    (EM_ON, "*"),
    (EM_OFF, "*"),
    (CODE_ON, "`"),
    (CODE_OFF, "`"),
    (LINK_ON, "["),
    (LINK_OFF, "]("),
    (LINK_END, ")"),
]


def without_empty_marks(text: Column) -> Column:
    """Inline marks with nothing inside go, at any depth: each run of marks is folded, an end taking its start away."""
    empty = [STRONG_ON + STRONG_OFF, EM_ON + EM_OFF, CODE_ON + CODE_OFF]
    marks = "".join(empty)

    def closed(held: Column, mark: Column) -> Column:
        takes = F.concat(F.right(held, F.lit(1)), mark).isin(empty)
        return F.when(takes, F.left(held, F.length(held) - 1)).otherwise(F.concat(held, mark))

    pieces = F.regexp_extract_all(text, F.lit(f"[{marks}]++|[^{marks}]++"), F.lit(0))
    folded = F.transform(
        pieces,
        lambda piece: F.when(piece.rlike(f"^[{marks}]"), F.aggregate(F.split(piece, ""), F.lit(""), closed)).otherwise(piece),
    )
    return F.when(text.rlike("|".join(empty)), F.array_join(folded, "")).otherwise(text)


def settle(marked: Column) -> Column:
    """Resolve the marks of joined pieces into Markdown."""
    out = marked
    # Blanks move out of inline marks, collapse across them and vanish at line breaks.
    out = F.regexp_replace(out, f"({OPENERS}+) +", " $1")
    out = F.regexp_replace(out, f" +(?=[{STRONG_OFF}{EM_OFF}{CODE_OFF}{LINK_OFF}])({CLOSERS}+)", "$1 ")
    out = F.regexp_replace(out, f" (?=[ {MARKS_RANGE}])({INLINE}*+) +", " $1")
    out = let(lambda b: without_empty_marks(b["text"]), text=out)
    out = F.regexp_replace(out, f" +(?=[{PARA}{LINE}{SOFT}])", "")
    out = F.regexp_replace(out, f"([{END}{SOFT_END}{HEAD_OFF}{ITEM_OFF}]{OPENERS}*+) +", "$1")
    # A heading without text leaves nothing; the first break inside a list item goes.
    out = F.regexp_replace(out, f"{HEAD_ON}#+{HEAD_OFF}(?=[{PARA}{LINE}])", "")
    out = F.regexp_replace(out, f"{ITEM_OFF}(?:{BREAK_ANY})++", ITEM_OFF)
    out = F.regexp_replace(out, f"(?<={END}){ESCAPED_AT_START}", r"\\$1")
    # A run of breaks is one break: a blank line when any of them asks for it. Quote marks stay on
    # the blank line only where both sides are quoted.
    # A one-character test comes first, because the patterns are tried at every character.
    at_break = f"(?=[{PARA}{LINE}])"
    asks = f"{at_break}(?<!{END})(?=(?:{LINE}[^{END}]*{END})*+{PARA})"
    middle = f"(?:{BREAK_ANY}(?=[{PARA}{LINE}]))*+"
    out = F.regexp_replace(out, f"{asks}{BREAK}{middle}[{PARA}{LINE}](\\1[^{END}]*){END}", "\n$1\n$2")
    out = F.regexp_replace(out, f"{asks}{middle}{BREAK}", "\n$1\n$1")
    out = F.regexp_replace(out, f"{at_break}{middle}{BREAK}", "\n$1")
    out = F.regexp_replace(out, f"{SOFT}([^{SOFT_END}]*){SOFT_END}", "  \n$1")
    out = F.regexp_replace(out, f"{HEAD_ON}(#+){HEAD_OFF}", "$1 ")
    for mark, text in PLAIN_MARKS:
        out = F.replace(out, F.lit(mark), F.lit(text))
    return out


def fenced(block: Column) -> Column:
    return F.concat(F.lit(FENCE), block["language"], F.lit("\n"), block["code"], F.lit("\n" + FENCE))


@built_once
def _region_blocks() -> Column:
    return F.filter(
        F.col("found"),
        lambda c: (c["open"] > F.col("region_open")) & (c["close"] < F.col("region_close")) & ~pick(F.col("gone"), c["id"]),
    )


def with_blocks(pages: DataFrame) -> DataFrame:
    """Pages with region, plus the code blocks inside it and the boilerplate of the region."""
    gone = removed_flags(F.col("elements"), BOILERPLATE_CLASSES + REGION_CLASSES)
    found = extend(pages, gone=gone, found=code_blocks_expression())
    mine = extend(found, blocks=_region_blocks()).drop("found")
    return extend(mine, tops=F.transform(F.col("blocks"), lambda c: c["id"]))


@built_once
def _element_marks() -> Column:
    els = F.col("elements")
    return F.transform(inside(els, pick(els, F.col("region_id"))), lambda e: _marks(page_columns(), e))


@built_once
def _hidden_elements() -> Column:
    """Per element: 1 when removed, 2 when part of a code block."""
    els = F.col("elements")
    spans = F.transform(F.col("tops"), lambda t: F.struct(t.alias("id"), pick(els, t)["last"].alias("last")))
    in_code = covered(F.size(els), spans)
    return F.zip_with(F.col("gone"), in_code, lambda gone, code: F.when(gone, 1).when(code, 2).otherwise(0))


@built_once
def _marked_text() -> Column:
    names = {name: F.col(name) for name in ["marks", "hidden", "tops"]}
    size = F.greatest(F.col("region_close") - F.col("region_open") - 1, F.lit(0))
    inside = F.slice(F.col("tokens"), F.col("region_open") + 2, size)
    return F.array_join(F.transform(inside, lambda t: _piece(page_columns(), names, t)), "")


def with_marked_text(pages: DataFrame) -> DataFrame:
    """The region's tokens as one marked-up text, ``marked``; tokens and elements go."""
    staged = extend(pages, marks=_element_marks(), hidden=_hidden_elements())
    done = {"elements", "tokens", "removed", "gone", "tops", "marks", "hidden", "region_id", "region_open", "region_close"}
    return derive(staged, F.array(F.struct(_marked_text().alias("marked"))), *[c for c in staged.columns if c not in done])


@built_once
def _settled_parts() -> Column:
    return F.split(settle(F.col("marked")), BLOCK_MARK, -1)


@built_once
def _with_code() -> Column:
    def whole(part: Column, i: Column) -> Column:
        return F.concat(part, F.coalesce(fenced(pick(F.col("blocks"), i)), F.lit("")))

    return F.array_join(F.transform(F.col("parts"), whole), "")


@built_once
def _cleaned() -> Column:
    return clean_markdown(F.col("raw"))


def with_markdown(pages: DataFrame) -> DataFrame:
    """Settle the marks, put the code blocks back in and clean up: ``content``."""
    settled = extend(pages, parts=_settled_parts()).drop("marked")
    joined = extend(settled, raw=_with_code()).drop("parts", "blocks")
    return extend(joined, content=_cleaned()).drop("raw")


def page_markdown(tokens: DataFrame) -> DataFrame:
    pages = with_markdown(with_marked_text(with_blocks(with_region(flagged(tokens)))))
    return pages.select("page_id", F.col("content").alias("markdown"))


def scrape_pages(tokens: DataFrame) -> DataFrame:
    """Tokenised pages to records of title, content and metadata; pages without content drop out.

    All steps are narrow: the job has one stage from the scan to the records.
    """
    keys = [c for c in tokens.columns if c not in ("elements", "tokens")]
    pages = flagged(tokens)
    described = derive(pages, F.array(metadata_expression()), *pages.columns)
    records = with_markdown(with_marked_text(with_blocks(with_region(described))))
    names = ["title", "content", "author", "published_at", "description", "site_name"]
    return records.where(~is_blank(F.col("content"))).select(*keys, *names)
