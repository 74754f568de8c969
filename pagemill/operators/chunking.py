"""Split documents into ordered chunks of bounded size.

Every step maps one row's text to an array inside the row, so a corpus of any size is chunked in
the scan stage without a shuffle. Lengths count UTF-16 units as in the delivery limit: texts are
padded once (``pad_utf16``), and the filler is taken out of the finished chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import built_once, indices, let, pick, spans, take_span
from ..functions.text import (
    FENCE,
    HEADING_LINE,
    LINE_END,
    LINE_START,
    STRUCK_RULE,
    WS,
    WS_LINE,
    clean_for_display,
    fence_count,
    fences_balanced,
    is_blank,
    line_class,
    pad_utf16,
    split_sentences,
    trim_ws,
    unpad_utf16,
)
from ..functions.urls import absolutize_markdown

# The delivery limit, and the limit of one piece of code.
MAX_CHARS = 2000
MAX_CODE = 1900

IMAGE_PATTERN = r"!\[([^\]]*)\]\(([^)]+)\)"
FENCE_LINE = rf"(?<![^\n])[{WS_LINE}]*+```[^\n]*"
# Text up to and including a heading that a blank line follows, or all the rest.
HEADING_BREAK = rf"(?s).*?(?<![^\n]){HEADING_LINE}\n[{WS_LINE}]*+(?=\n|\z)|.+"
RULE_LINE = rf"{LINE_START}[-*_][{WS}]*+[-*_][-*_{WS}]*[-*_]{LINE_END}"

CHUNK = "struct<type:string,content:string,language:string>"


def chunk(kind: str | Column, content: Column, language: Column | None = None) -> Column:
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        content.alias("content"),
        (F.lit(None).cast("string") if language is None else language).alias("language"),
    )


def split_chars(text: Column, limit: int = MAX_CHARS) -> Column:
    """Cut a trimmed text into pieces of at most ``limit`` characters.

    A piece ends before the last blank, line feed, full stop or exclamation mark in the final
    three tenths of the window, else at the limit. One regex pass does the whole text, so cost
    stays linear in its length.
    """
    floor = limit * 7 // 10 + 1
    piece = rf"(?s)[{WS}]*+(.{{1,{limit}}}+\z|.{{{floor},{limit}}}(?=[ \n.!])|.{{{limit}}})"
    pieces = F.regexp_extract_all(text, F.lit(piece), F.lit(1))
    return F.filter(F.transform(pieces, trim_ws), lambda p: p != "")


def split_images(text: Column) -> Column:
    """Alternate text and image parts, each image on its own; blank text parts are dropped."""
    part = "struct<is_image:boolean,content:string>"

    def pair(b: Column, i: Column) -> Column:
        before = F.struct(F.lit(False).alias("is_image"), trim_ws(pick(b["parts"], i)).alias("content"))
        image = F.struct(F.lit(True).alias("is_image"), pick(b["images"], i).alias("content"))
        return F.array(before, image).cast(f"array<{part}>")

    both = let(
        lambda b: F.flatten(F.transform(indices(b["parts"]), lambda i: pair(b, i))),
        parts=F.split(text, IMAGE_PATTERN, -1),
        images=F.regexp_extract_all(text, F.lit(IMAGE_PATTERN), F.lit(0)),
    )
    whole = F.array(F.struct(F.lit(False).alias("is_image"), trim_ws(text).alias("content")))
    # The plain test spares texts without images the regex passes.
    return F.filter(F.when(F.contains(text, F.lit("![")), both).otherwise(whole), lambda p: p["content"] != "")


def split_blocks(text: Column) -> Column:
    """Code blocks and paragraphs of an image-free text.

    Fence lines cut the text into alternating outside and inside parts; code that is never
    closed runs to the end. Outside, a heading followed by a blank line ends its paragraph.
    """

    def paragraphs(part: Column) -> Column:
        broken = F.regexp_extract_all(part, F.lit(HEADING_BREAK), F.lit(0))
        pieces = F.transform(F.when(F.contains(part, F.lit("#")), broken).otherwise(F.array(part)), trim_ws)
        return F.transform(F.filter(pieces, lambda p: p != ""), lambda p: chunk("paragraph", p))

    def code(b: Column, i: Column) -> Column:
        opening = pick(b["fences"], i - 1)
        body = F.concat(opening, pick(b["parts"], i), F.coalesce(pick(b["fences"], i), F.lit("")))
        trimmed = trim_ws(opening)
        return chunk("code", trim_ws(body), F.substring(trimmed, F.lit(4), F.length(trimmed)))

    fenced = let(
        lambda b: F.flatten(
            F.transform(
                indices(b["parts"]),
                lambda i: F.when(i % 2 == 0, paragraphs(pick(b["parts"], i))).otherwise(F.array(code(b, i))),
            )
        ),
        parts=F.split(text, FENCE_LINE, -1),
        fences=F.regexp_extract_all(text, F.lit(FENCE_LINE), F.lit(0)),
    )
    return F.when(F.contains(text, F.lit(FENCE)), fenced).otherwise(paragraphs(text))


def pack_code(content: Column, language: Column, limit: int = MAX_CODE, refence: bool = False) -> Column:
    """Whole lines packed up to ``limit``; a longer single line stays whole.

    The pieces carry no fences of their own unless ``refence`` asks for them.
    """
    lines = F.split(content, "\n", -1)

    def pieces(b: Column) -> Column:
        packed = F.transform(
            spans(F.transform(b["lines"], F.length), limit, 1, skip_leading_empty=True),
            lambda g: F.array_join(take_span(b["lines"], g), "\n"),
        )
        if refence:
            packed = F.transform(packed, lambda p, i: _refenced(p, i, F.size(packed), language))
        return F.transform(packed, lambda p: chunk("code", p, F.coalesce(language, F.lit(""))))

    return let(pieces, lines=lines)


def _refenced(piece: Column, i: Column, n: Column, language: Column) -> Column:
    head = F.when(i > 0, F.concat(F.lit(FENCE), F.coalesce(language, F.lit("")), F.lit("\n"))).otherwise("")
    tail = F.when(i < n - 1, F.lit("\n" + FENCE)).otherwise("")
    return F.concat(head, piece, tail)


def pack_sentences(text: Column, limit: int = MAX_CHARS) -> Column:
    """Sentences packed up to ``limit`` with one blank; NULL where that is no valid split.

    A sentence over the limit falls back to ``split_chars``. The split is void when there is only
    one sentence or when it leaves a piece with an odd number of fences.
    """

    def pieces(b: Column) -> Column:
        groups = spans(F.transform(b["sentences"], F.length), limit, 1, solo_over_limit=True)
        joined = F.transform(groups, lambda g: F.array_join(take_span(b["sentences"], g), " "))
        return F.flatten(F.transform(joined, lambda p: F.when(F.length(p) > limit, split_chars(p, limit)).otherwise(F.array(trim_ws(p)))))

    def checked(b: Column) -> Column:
        return let(
            lambda r: F.when((F.size(r["pieces"]) > 1) & F.forall(r["pieces"], fences_balanced), r["pieces"]),
            pieces=F.when(F.size(b["sentences"]) > 1, pieces(b)),
        )

    return let(checked, sentences=split_sentences(text))


def fit(piece: Column, limit: int = MAX_CHARS, max_code: int = MAX_CODE, refence: bool = False) -> Column:
    """One chunk as an array of chunks within the limit (a lone long code line excepted)."""
    content = piece["content"]
    prose = F.transform(F.coalesce(pack_sentences(content, limit), split_chars(content, limit)), lambda p: chunk("paragraph", p))
    return (
        F.when(F.length(content) <= limit, F.array(piece))
        .when(piece["type"] == "code", pack_code(content, piece["language"], max_code, refence))
        .otherwise(prose)
    )


def atoms(text: Column, limit: int = MAX_CHARS, max_code: int = MAX_CODE, refence: bool = False) -> Column:
    """Smallest units of a cleaned text: images, code and paragraphs, each within the limit."""

    def units(part: Column) -> Column:
        blocks = F.flatten(F.transform(split_blocks(part["content"]), lambda p: fit(p, limit, max_code, refence)))
        return F.when(part["is_image"], F.array(chunk("image", part["content"]))).otherwise(blocks)

    return F.flatten(F.transform(split_images(text), units))


def measure(unit: Column) -> Column:
    """What of a unit matters for packing: whether it is an image, its length, and whether its fences are odd."""
    return F.struct(
        (unit["type"] == "image").alias("image"),
        F.length(unit["content"]).alias("n"),
        (fence_count(unit["content"]) % 2).alias("odd"),
    )


def packed_groups(measured: Column, limit: int = MAX_CHARS) -> Column:
    """Bounds of the groups of measured units, ``array<struct<s,e>>``; the fold carries lengths and fence parity."""
    span = "struct<s:int,e:int>"
    zero = F.struct(
        F.array().cast(f"array<{span}>").alias("done"),
        F.lit(0).alias("s"),
        F.lit(0).alias("e"),
        F.lit(0).alias("n"),
        F.lit(0).alias("odd"),
        F.lit(True).alias("image"),
    )

    def current(acc: Column) -> Column:
        return F.struct(acc["s"].alias("s"), acc["e"].alias("e"))

    def step(acc: Column, u: Column) -> Column:
        i = acc["e"] + 1
        n = acc["n"] + 2 + u["n"]
        odd = (acc["odd"] + u["odd"]) % 2
        joins = ~acc["image"] & ~u["image"] & (n <= limit) & (odd == 0)
        grown = F.struct(acc["done"].alias("done"), acc["s"].alias("s"), i.alias("e"), n.alias("n"), odd.alias("odd"), F.lit(False).alias("image"))
        closed = F.when(acc["s"] > 0, F.array_append(acc["done"], current(acc))).otherwise(acc["done"])
        fresh = F.struct(closed.alias("done"), i.alias("s"), i.alias("e"), u["n"].alias("n"), u["odd"].alias("odd"), u["image"].alias("image"))
        return F.when(joins, grown).otherwise(fresh)

    def finish(acc: Column) -> Column:
        return F.when(acc["s"] > 0, F.array_append(acc["done"], current(acc))).otherwise(acc["done"])

    return F.aggregate(measured, zero, step, finish)


def repack(units: Column, limit: int = MAX_CHARS) -> Column:
    """Extend each chunk with its successors while the whole fits and its fences pair up.

    Images stay alone. A merged group is a paragraph; a single unit keeps its type. The fold
    carries lengths and fence parity, the text is joined once per group.
    """
    def assemble(b: Column, g: Column) -> Column:
        joined = F.array_join(F.transform(take_span(b["units"], g), lambda u: u["content"]), "\n\n")
        return F.when(g["s"] == g["e"], pick(b["units"], g["s"] - 1)).otherwise(chunk("paragraph", trim_ws(joined)))

    return let(
        lambda b: F.transform(b["groups"], lambda g: assemble(b, g)),
        units=units,
        groups=packed_groups(F.transform(units, measure), limit),
    )


def chunks_of(
    text: Column,
    url: Column | None = None,
    limit: int = MAX_CHARS,
    max_code: int = MAX_CODE,
    refence: bool = False,
    front_matter_anywhere: bool = False,
    strategy: str = "greedy",
) -> Column:
    """All chunks of one text in order: resolve links, clean, split into units, re-pack."""
    resolved = text if url is None else absolutize_markdown(text, url)
    padded = let(lambda b: pad_utf16(b["c"]), c=clean_for_display(resolved, front_matter_anywhere))
    if strategy == "cascade":
        split = let(lambda b: cascade(chunk("paragraph", b["t"]), limit, max_code), t=padded)
    else:
        split = let(
            lambda t: let(lambda b: repack(b["units"], limit), units=atoms(t["t"], limit, max_code, refence)),
            t=padded,
        )
    return F.transform(split, lambda c: chunk(c["type"], unpad_utf16(c["content"]), c["language"]))


def delivered(c: Column, limit: int = MAX_CHARS, front_matter_anywhere: bool = False) -> Column:
    """A chunk as it goes out: cleaned once more, and cut again where it is over the limit."""
    cut = let(
        lambda b: F.when(F.length(b["t"]) <= limit, F.array(chunk(c["type"], unpad_utf16(b["t"]), c["language"]))).otherwise(
            F.transform(split_chars(b["t"], limit), lambda p: chunk("paragraph", unpad_utf16(p)))
        ),
        t=let(lambda b: pad_utf16(b["c"]), c=clean_for_display(c["content"], front_matter_anywhere)),
    )
    return F.when(c["type"] == "image", F.array(c)).otherwise(cut)


def delivery_chunks(
    text: Column,
    url: Column | None = None,
    limit: int = MAX_CHARS,
    max_code: int = MAX_CODE,
    front_matter_anywhere: bool = False,
) -> Column:
    """Chunks as delivered: a short text goes out whole and cleaned, an over-long chunk is re-cut."""
    whole = F.array(chunk("paragraph", clean_for_display(text, front_matter_anywhere)))

    def deliver(c: Column) -> Column:
        return delivered(c, limit, front_matter_anywhere)

    long = F.flatten(F.transform(chunks_of(text, url, limit, max_code, front_matter_anywhere=front_matter_anywhere), deliver))
    return F.when(F.length(pad_utf16(text)) <= limit, whole).otherwise(long)


# --- alternative strategy: rules, then paragraphs, then the size gate -------------------------


def split_rules(text: Column) -> Column:
    """Parts between thematic breaks, with a struck-through blank run in place of each break."""
    parts = F.split(text, RULE_LINE, -1)
    both = let(
        lambda b: F.flatten(
            F.transform(
                b["parts"],
                lambda p, i: F.array(trim_ws(p), F.when(i < F.size(b["parts"]) - 1, F.lit(STRUCK_RULE)).otherwise("")),
            )
        ),
        parts=parts,
    )
    return F.when(F.size(parts) > 1, F.filter(both, lambda p: p != ""))


def markdown_paragraphs(text: Column) -> Column:
    """Paragraphs of plain lines; every structural line stands alone; blank lines separate."""
    tagged = F.transform(
        F.split(text, "\n", -1),
        lambda line: F.struct(line.alias("line"), line_class(line).isNotNull().alias("alone"), is_blank(line).alias("blank")),
    )

    def starts(b: Column) -> Column:
        def opens(t: Column, i: Column) -> Column:
            before = pick(b["lines"], i - 1)
            fresh = t["alone"] | (i == 0) | before["alone"] | before["blank"]
            return F.when(~t["blank"] & fresh, i).otherwise(F.lit(-1))

        return F.filter(F.transform(b["lines"], opens), lambda i: i >= 0)

    def group(b: Column, start: Column, k: Column) -> Column:
        stop = F.coalesce(pick(b["starts"], k + 1), F.size(b["lines"]))
        run = F.filter(F.slice(b["lines"], start + 1, stop - start), lambda t: ~t["blank"])
        return F.array_join(F.transform(run, lambda t: t["line"]), "\n")

    return let(
        lambda a: let(
            lambda b: F.transform(b["starts"], lambda s, k: group(b, s, k)),
            lines=a["lines"],
            starts=starts(a),
        ),
        lines=tagged,
    )


def pack_paragraphs(text: Column, limit: int = MAX_CHARS) -> Column:
    """Paragraphs packed up to ``limit`` with a blank line between; NULL where no valid split."""

    def pieces(b: Column) -> Column:
        groups = spans(F.transform(b["paras"], F.length), limit, 2, solo_over_limit=True)
        joined = F.transform(groups, lambda g: F.array_join(take_span(b["paras"], g), "\n\n"))
        return F.flatten(F.transform(joined, lambda p: F.when(F.length(p) > limit, split_chars(p, limit)).otherwise(F.array(p))))

    return let(
        lambda b: let(
            lambda r: F.when((F.size(r["pieces"]) > 1) & F.forall(r["pieces"], fences_balanced), r["pieces"]),
            pieces=F.when(F.size(b["paras"]) > 1, pieces(b)),
        ),
        paras=F.filter(F.transform(markdown_paragraphs(text), trim_ws), lambda p: p != ""),
    )


def cascade(piece: Column, limit: int = MAX_CHARS, max_code: int = MAX_CODE) -> Column:
    """First split that yields more than one part: rules, paragraphs, code lines, sentences, characters."""
    content = piece["content"]

    def as_chunks(parts: Column) -> Column:
        return F.transform(parts, lambda p: chunk("paragraph", p))

    rules = split_rules(content)
    code = F.when((piece["type"] == "code") & (F.length(content) > max_code), pack_code(content, piece["language"], max_code))
    sentences = F.when(F.length(content) > limit, pack_sentences(content, limit))
    return F.coalesce(
        as_chunks(F.when(F.size(rules) > 1, rules)),
        as_chunks(pack_paragraphs(content, limit)),
        code,
        as_chunks(sentences),
        as_chunks(split_chars(content, limit)),
    )


# --- tables -----------------------------------------------------------------------------------


def explode_array(df: DataFrame, array: Column, name: str, *keys: str | Column) -> DataFrame:
    """``keys`` plus one row per array element as ``(seq, name)``.

    The outer form keeps the optimizer from adding a size test on the array, which would evaluate
    the whole expression a second time.
    """
    out = df.select(*keys, F.posexplode_outer(array).alias("seq", name))
    return out.where(F.col("seq").isNotNull())


def chunk_documents(
    df: DataFrame,
    id_col: str,
    text_col: str,
    url_col: str | None = None,
    max_chars: int = MAX_CHARS,
    max_code: int = MAX_CODE,
    refence: bool = False,
    front_matter_anywhere: bool = False,
    strategy: str = "greedy",
    delivery: bool = False,
) -> DataFrame:
    """One row per chunk: ``(id, seq, n_chunks, type, content, language)``."""
    sized = _chunk_rows(text_col, url_col, max_chars, max_code, refence, front_matter_anywhere, strategy, delivery)
    rows = explode_array(df, sized, "x", id_col)
    return rows.select(
        id_col,
        F.col("seq"),
        F.col("x.n").alias("n_chunks"),
        F.col("x.c.type").alias("type"),
        F.col("x.c.content").alias("content"),
        F.col("x.c.language").alias("language"),
    )


@built_once
def _chunk_rows(
    text_col: str,
    url_col: str | None,
    max_chars: int,
    max_code: int,
    refence: bool,
    front_matter_anywhere: bool,
    strategy: str,
    delivery: bool,
) -> Column:
    url = F.col(url_col) if url_col else None
    if delivery:
        parts = delivery_chunks(F.col(text_col), url, max_chars, max_code, front_matter_anywhere)
    else:
        parts = chunks_of(F.col(text_col), url, max_chars, max_code, refence, front_matter_anywhere, strategy)
    # One struct holds the array and its size, so the array is built once per row.
    return let(lambda b: F.transform(b["parts"], lambda c: F.struct(F.size(b["parts"]).alias("n"), c.alias("c"))), parts=parts)


def chunk_quality(chunks: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """Corpus report: sizes, shares and counts per chunk type."""
    n = F.length("content")
    return chunks.groupBy("type").agg(
        F.count("*").alias("n_chunks"),
        F.max(n).alias("max_len"),
        F.sum(n).alias("total_len"),
        F.count_if(n > limit // 2).alias("n_over_half"),
        F.count_if(n > limit).alias("n_over_limit"),
        F.count_if(~fences_balanced(F.col("content"))).alias("n_odd_fences"),
    )
