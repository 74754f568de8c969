"""String expressions shared by the operators. All are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace of ECMAScript. Java's \s and Spark's trim() cover less.
WS_CODES = [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
WS_CHARS = "".join(chr(code) for code in WS_CODES)
# The same as the inside of a regex class, without and with the line feed. Ranges keep it short,
# because a regex engine tests the entries one by one.
_WS_REST = r"\x20\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = r"\x09-\x0D" + _WS_REST
WS_LINE = r"\x09\x0B-\x0D" + _WS_REST
LINE_END = r"(?=[\n\r\x{2028}\x{2029}]|\z)"
LINE_START = r"(?<![^\n\r\x{2028}\x{2029}])"

FENCE = "```"
# Fixed value: what a thematic break becomes on display (49 spaces struck through).
STRUCK_RULE = "~~" + " " * 49 + "~~"

# A noncharacter that pads supplementary characters, so that lengths count UTF-16 units.
UTF16_PAD = chr(0xFDDE)
# A noncharacter that stands for a protected code block during clean-up.
CODE_MARK = chr(0xFDD9)
REPLACEMENT_CHAR = chr(0xFFFD)


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return trim_ws(c) == ""


def collapse_ws(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, f"[{WS}]+", " "))


def pad_utf16(c: Column) -> Column:
    """Put a filler before each supplementary character: length() then equals the UTF-16 length."""
    clean = F.replace(c, F.lit(UTF16_PAD), F.lit(""))
    padded = F.regexp_replace(clean, r"([\x{10000}-\x{10FFFF}])", UTF16_PAD + "$1")
    return F.when(utf16_length(c) == F.length(c), clean).otherwise(padded)


def unpad_utf16(c: Column) -> Column:
    return F.replace(c, F.lit(UTF16_PAD), F.lit(""))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def fence_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(FENCE), F.lit(0)))


def fences_balanced(c: Column) -> Column:
    return fence_count(c) % 2 == 0


HEADING_LINE = rf"[{WS_LINE}]*+#{{1,6}}[{WS_LINE}]++[^\n]+"


def ends_with_heading(c: Column) -> Column:
    """The last line of the trimmed text is an ATX heading."""
    return F.element_at(F.split(trim_ws(c), "\n", -1), -1).rlike(rf"\A{HEADING_LINE}\z")


# Line classes in the order in which they are tested on a trimmed line.
LINE_CLASSES = [
    ("heading", rf"\A#{{1,6}}[{WS}]"),
    ("rule", rf"\A[-*_][{WS}]*+[-*_][-*_{WS}]*[-*_]\z"),  # no repeated group: a long line must not recurse
    ("bullet", rf"\A[-*+][{WS}]"),
    ("ordered", rf"\A[0-9]+\.[{WS}]"),
    ("quote", r"\A>"),
    ("fence", r"\A```"),
    ("table", r"\|.*\|"),
]


def line_class(line: Column) -> Column:
    """Kind of structural line, or NULL for plain text."""
    return let_first([(name, trim_ws(line).rlike(pattern)) for name, pattern in LINE_CLASSES])


def let_first(branches: list[tuple[str, Column]]) -> Column:
    """First name whose condition holds, else NULL."""
    out = F.when(branches[0][1], branches[0][0])
    for name, condition in branches[1:]:
        out = out.when(condition, name)
    return out


def split_sentences(c: Column) -> Column:
    """Pieces after ``. ! ?``, whitespace, before an ASCII capital; blank pieces are dropped."""
    pieces = F.split(c, rf"(?<=[.!?])[{WS}]+(?=[A-Z])", -1)
    return F.filter(pieces, lambda s: ~is_blank(s))


def strip_front_matter(c: Column, anywhere: bool = False) -> Column:
    """Drop the first region between a ``---`` line and the next one.

    By default only at the start of the text: taken anywhere, it would delete the text between
    two rules of a bundle.
    """
    region = rf"---[{WS}]*\n(?:(?s).*?)\n---[{WS}]*\n?"
    if not anywhere:
        return F.regexp_replace(c, rf"\A{region}", "")
    return F.regexp_replace(c, rf"\A((?s).*?){LINE_START}{region}", "$1")


def clean_for_display(c: Column, front_matter_anywhere: bool = False) -> Column:
    return clean_lines(strip_front_matter(c, front_matter_anywhere))


def clean_lines(out: Column) -> Column:
    """Rules struck through, runs of blank lines and blanks at line ends taken out."""
    # The literal comes first: a leading look-behind would run at every character.
    out = F.regexp_replace(out, rf"\* \* \*(?<![^\n\r\x{{2028}}\x{{2029}}]\* \* \*){LINE_END}", STRUCK_RULE)
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, rf"[ \t]++{LINE_END}", "")
    return trim_ws(out)


def clean_markdown(c: Column) -> Column:
    """Normalise converted Markdown outside fenced code, then set blank lines around fences."""
    from .core import indices, let, pick

    source = F.replace(c, F.lit(CODE_MARK), F.lit(REPLACEMENT_CHAR))
    fenced = r"(?s)```.*?```"
    out = F.regexp_replace(source, fenced, CODE_MARK)
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, rf"\n(#{{1,6}})[{WS}]+", "\n$1 ")
    out = F.regexp_replace(out, rf"\n([{WS}]*[-*+])[{WS}]+", "\n$1 ")
    out = F.regexp_replace(out, rf"[ \t]++{LINE_END}", "")
    out = F.regexp_replace(out, r"([^!])\[([^\]]+)\]\(([^)]+)\)", "$1 [$2]($3)")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    out = trim_ws(out)
    restored = let(
        lambda b: F.array_join(
            F.transform(
                indices(b["parts"]),
                lambda i: F.concat(pick(b["parts"], i), F.coalesce(pick(b["code"], i), F.lit(""))),
            ),
            "",
        ),
        parts=F.split(out, CODE_MARK, -1),
        code=F.regexp_extract_all(source, F.lit(fenced), F.lit(0)),
    )
    return F.regexp_replace(restored, r"(?s)\n(```.*?```)\n", "\n\n$1\n\n")


# Entities in the order in which they are decoded.
CODE_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
]


def decode_entities(c: Column) -> Column:
    for name, char in CODE_ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def newline_normalised(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n|\r", "\n")


def json_quote(c: Column) -> Column:
    """A JSON string literal: the value of a one-field object with the wrapper cut off."""
    text = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.substring(text, F.lit(6), F.length(text) - 6))


def iso_millis(ts: Column) -> Column:
    """ISO-8601 in UTC with milliseconds, whatever the session time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# Date shapes tried in order after the ISO forms that a plain cast accepts. A leading
# weekday is dropped before.
DATE_FORMATS = [
    "d MMM yyyy HH:mm:ss zzz",
    "d MMM yyyy HH:mm:ss Z",
    "MMMM d, yyyy HH:mm:ss",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "d MMMM yyyy",
    "d MMM yyyy",
    "M/d/yyyy",
]


def parse_date(c: Column) -> Column:
    """Lenient date parse; NULL when no shape fits."""
    text = trim_ws(c)
    iso = F.when(text.rlike(r"\A[0-9]{4}(-[0-9]{1,2}){0,2}\z|\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"), text)
    named = F.when(text.rlike(r"[A-Za-z]{3}|/"), F.regexp_replace(text, r"\A[A-Za-z]{3,9}, ", ""))
    return F.coalesce(F.try_to_timestamp(iso), *[F.try_to_timestamp(named, F.lit(shape)) for shape in DATE_FORMATS])


def truncate_text(c: Column, max_length: int = 8000, floor: float = 0.8) -> Column:
    """Cut at ``max_length``, back to the last sentence end beyond ``floor``, and add a notice."""
    head = F.substring(c, 1, max_length)
    sentence = F.regexp_extract(head, r"(?s)\A(.*[.!?])", 1)
    # The end mark must lie beyond the floor, as a 0-based position.
    body = F.when(F.length(sentence) - 1 > max_length * floor, sentence).otherwise(head)
    return F.when(F.length(c) <= max_length, c).otherwise(F.concat(body, F.lit("\n\n*[Content truncated]*")))


def cap_bytes(c: Column, max_bytes: int = 8 * 1024 * 1024) -> Column:
    """At most ``max_bytes`` of UTF-8.

    A text over the cap keeps 0.9 of that number as characters, and fewer where those still take
    more bytes than the cap; a character is never split.
    """
    kept = F.substring(c, 1, int(max_bytes * 0.9))
    cut = F.make_valid_utf8(F.substring(F.encode(kept, "UTF-8"), 1, max_bytes).cast("string"))
    whole = F.regexp_replace(cut, REPLACEMENT_CHAR + r"{1,3}\z", "")
    capped = F.when(F.octet_length(kept) <= max_bytes, kept).otherwise(whole)
    return F.when(F.octet_length(c) <= max_bytes, c).otherwise(capped)


def thread_name(title: Column) -> Column:
    kept = F.regexp_replace(title, rf"[^\w{WS}\-.()]", "")
    name = F.left(collapse_ws(kept), F.lit(100))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("Scraped Content"))


def file_stem(title: Column) -> Column:
    out = F.regexp_replace(title, r'[<>:"/\\|?*]', "")
    out = F.regexp_replace(out, f"[{WS}]+", "-")
    out = F.regexp_replace(out, "-+", "-")
    out = F.btrim(out, F.lit("-"))
    return F.coalesce(F.nullif(F.left(out, F.lit(100)), F.lit("")), F.lit("content"))


def channel_slug(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^\w]", "-"))
