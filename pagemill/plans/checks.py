"""Checking SQL for the registered queries, in the dialect of DuckDB.

Written apart from the Spark expressions: folds are recursive queries, line states are windows,
look-around is replaced by markers.
"""

from __future__ import annotations

from ..functions.text import WS, WS_CHARS
from . import views
from .catalog import ARCHIVED_AT_MS, LINK_FORMS

# Fixed values, written out here so that a wrong one in the library shows: emoji, limits, notice, denied places, entities, patterns.
BOOKMARK_EMOJI = "🔖"
PIN_EMOJI = "📌"
LINK_EMOJI = "📝"
MAX_CHARS = 2000
MAX_CODE = 1900
STRUCK_RULE = "~~                                                 ~~"
NO_CONTENT = (
    "*(no content)*\n\nThis may be an indication that the server has opted not to share message content with the bot."
)
DENIED_PLACES = [
    "discord.com",
    "discordapp.com",
    "youtube.com/watch",
    "youtu.be",
    "twitter.com",
    "x.com",
    "instagram.com",
    "tiktok.com",
    "facebook.com",
    "reddit.com",
]
DENIED_SUFFIXES = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".mp4", ".webm"]
CODE_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
]
CONTENT_PATTERNS = [
    (r"#!/bin/(bash|sh)", "bash"),
    (r"#!/usr/bin/env\s+(python|python3)", "python"),
    (r"#!/usr/bin/env\s+node", "javascript"),
    (r"import\s+.*from\s+['\"]", "javascript"),
    (r"const\s+\w+\s*=\s*\(", "javascript"),
    (r"function\s+\w+\s*\(", "javascript"),
    (r"class\s+\w+", "javascript"),
    (r"def\s+\w+\s*\(", "python"),
    (r"import\s+\w+", "python"),
    (r"from\s+\w+\s+import", "python"),
    (r"#include\s*<.*>", "cpp"),
    (r'#include\s*".*"', "cpp"),
    (r"using\s+namespace\s+std;", "cpp"),
    (r"public\s+class\s+\w+", "java"),
    (r"package\s+\w+;", "java"),
    (r"import\s+java\.", "java"),
    (r"<\?php", "php"),
    (r"<\?=", "php"),
    (r"<!DOCTYPE\s+html", "html"),
    (r"<html[^>]*>", "html"),
    (r"<div[^>]*>", "html"),
    (r"body\s*\{", "css"),
    (r"\.\w+\s*\{", "css"),
    (r"(?i)SELECT\s+.*FROM", "sql"),
    (r"(?i)INSERT\s+INTO", "sql"),
    (r"(?i)UPDATE\s+.*SET", "sql"),
    (r"(?i)DELETE\s+FROM", "sql"),
    (r"(?i)CREATE\s+TABLE", "sql"),
    (r"fn\s+\w+\s*\(", "rust"),
    (r"use\s+\w+::", "rust"),
    (r"go\s+func", "go"),
    (r"package\s+main", "go"),
    (r"import\s+\(", "go"),
]


LF = "chr(10)"
IMAGE = r"!\[[^\]]*\]\([^)]+\)"
LINK = r"\[[^\]]+\]\([^)]+\)"
ISO_ARCHIVED = "2024-06-01T12:00:00.500Z"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(c: str) -> str:
    return f"trim({c}, {quote(WS_CHARS)})"


def collapse(c: str) -> str:
    return trim(f"regexp_replace({c}, '[{WS}]+', ' ', 'g')")


def with_view(name: str, sql: str) -> str:
    return f"{name} AS ({views.checker_sql(sql)})"


MESSAGES = with_view("msg", views.MESSAGES)
MARKDOWN = with_view("md", views.MARKDOWN)
REACTIONS = with_view("rx", views.REACTIONS)
GUILDS = with_view("guilds", views.GUILDS)
INTERACTIONS = with_view("ia", views.INTERACTIONS)
CHANNELS = with_view("ch", views.CHANNELS)
META_PAGES = with_view("mp", views.META_PAGES)

# --- links --------------------------------------------------------------------------------------

_DENIED = " AND ".join(
    [f"NOT contains(lower(u), {quote(p)})" for p in DENIED_PLACES] + [f"NOT ends_with(lower(u), {quote(s)})" for s in DENIED_SUFFIXES]
)
LINKS = f"""
lk0 AS (SELECT message_id, list_filter(regexp_extract_all(content, 'https?://[^{WS}]+'), lambda u: {_DENIED}) AS urls FROM msg),
links AS (SELECT message_id, unnest(generate_series(0, len(urls) - 1)) AS pos, unnest(urls) AS url FROM lk0 WHERE len(urls) > 0)"""
KEY = "regexp_replace(url, '#.*$', '')"


def host(c: str) -> str:
    authority = rf"regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    return f"lower(regexp_replace({authority}, ':[0-9]*$', ''))"


def site(c: str) -> str:
    return rf"regexp_replace({host(c)}, 'www\.', '')"


def resolve_link(link: str, url: str) -> str:
    scheme = f"lower(regexp_extract({url}, '^([A-Za-z]+)://', 1))"
    path = f"CASE WHEN regexp_extract({url}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({url}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END"
    origin = f"{scheme} || '://' || {host(url)}"
    href = f"{origin} || ({path}) || regexp_extract({url}, '^[^?#]*([?#].*)$', 1)"
    steps = f"list_filter(string_split(regexp_extract(({path}), '^(.*/)', 1) || '/' || {link}, '/'), lambda s: s <> '' AND s <> '.')"
    walk = f"list_reduce({steps}, lambda a, s: CASE WHEN s = '..' THEN list_slice(a, 1, greatest(len(a) - 1, 0)) ELSE list_append(a, s) END, []::VARCHAR[])"
    return f"""CASE WHEN regexp_matches({link}, '^https?://') THEN {link}
      WHEN starts_with({link}, '//') THEN {scheme} || ':' || {link}
      WHEN starts_with({link}, '/') THEN {origin} || {link}
      WHEN starts_with({link}, '#') OR starts_with({link}, '?') THEN {href} || {link}
      WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {link}
      ELSE {origin} || '/' || array_to_string({walk}, '/') END"""


PAGE_LINKS = f"""
pl0 AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
pl1 AS (SELECT page_id, url, unnest(generate_series(0, len(hrefs) - 1)) AS pos, unnest(hrefs) AS href FROM pl0 WHERE len(hrefs) > 0),
pl AS (SELECT page_id, url, pos, {LINK_FORMS} AS link FROM pl1)"""

ABSOLUTE = f"""
ab0 AS (SELECT doc_id, url, string_split_regex(text, '{LINK}') AS parts, regexp_extract_all(text, '{LINK}') AS found FROM md),
ab1 AS (SELECT doc_id, url, parts, unnest(generate_series(1, len(parts))) AS i FROM ab0),
ab2 AS (SELECT a.doc_id, a.url, a.i, a.parts[a.i] AS part, b.found[a.i] AS link FROM ab1 a JOIN ab0 b ON a.doc_id = b.doc_id),
ab3 AS (SELECT doc_id, url, i, part, regexp_extract(link, '^\\[([^\\]]+)\\]', 1) AS label, regexp_extract(link, '\\]\\(([^)]+)\\)$', 1) AS target, link FROM ab2),
ab4 AS (SELECT doc_id, i, part || coalesce('[' || label || '](' || ({resolve_link("target", "url")}) || ')', '') AS piece FROM ab3),
absolute AS (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS text FROM ab4 GROUP BY doc_id)"""


def display(c: str) -> str:
    out = f"regexp_replace({c}, '\\A---[{WS}]*\\n(?s:.*?)\\n---[{WS}]*\\n?', '')"
    out = f"regexp_replace({out}, '(?m)^\\* \\* \\*$', {quote(STRUCK_RULE)}, 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', {LF} || {LF}, 'g')"
    out = f"regexp_replace({out}, '(?m)[ \\t]+$', '', 'g')"
    return trim(out)


# --- chunk chain over the Markdown view -----------------------------------------------------------

HEADING = f"^#{{1,6}}[{WS}]"


def fold(name: str, items: str, key: str, limit: int, joiner: int) -> str:
    """Greedy groups over ``items(key, n, len)`` with n from 1: adds the group number ``g``.

    An item over the limit stays alone (its running length counts as 0).
    """
    fits = f"r.run > 0 AND r.run + {joiner} + i.len <= {limit}"
    return f"""
{name} AS (
  SELECT {key}, n, 1 AS g, CASE WHEN len > {limit} THEN 0 ELSE len END AS run FROM {items} WHERE n = 1
  UNION ALL
  SELECT i.{key}, i.n, CASE WHEN {fits} THEN r.g ELSE r.g + 1 END,
         CASE WHEN {fits} THEN r.run + {joiner} + i.len WHEN i.len > {limit} THEN 0 ELSE i.len END
  FROM {name} r JOIN {items} i ON i.{key} = r.{key} AND i.n = r.n + 1)"""


def cut_chars(name: str, source: str, key: str) -> str:
    """Character fallback over ``source(key, text)``: ``name(key, j, piece)``."""
    cut = "CASE WHEN length(rest) <= 2000 THEN length(rest) WHEN regexp_matches(rest, '^(?s:.{701}.{700}.{0,599})[ \\n.!]') THEN length(regexp_extract(rest, '^((?s:.{701}.{700}.{0,599}))[ \\n.!]', 1)) ELSE 2000 END"
    return f"""
{name}_walk AS (
  SELECT {key}, 0 AS j, CAST('' AS VARCHAR) AS piece, text AS rest FROM {source}
  UNION ALL
  SELECT {key}, j + 1, {trim(f"left(rest, {cut})")}, {trim(f"substr(rest, {cut} + 1)")} FROM {name}_walk WHERE rest <> ''),
{name} AS (SELECT {key}, j, piece FROM {name}_walk WHERE j > 0 AND piece <> '')"""


def sentences(c: str) -> str:
    marked = f"regexp_replace({c}, '([.!?])[{WS}]+([A-Z])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: {trim('s')} <> '')"


def pack_items(p: str, key: str, joiner: str, width: int) -> str:
    """Greedy packing of ``{p}_items(key, n, s, len)``: ``{p}_pieces(key, seq, piece)`` where valid.

    Groups over the limit are cut by characters. A split is valid when it has several pieces and
    each holds an even number of fences.
    """
    return f"""
{fold(p + "_fold", p + "_items", key, MAX_CHARS, width)},
{p}_groups AS (SELECT i.{key} AS {key}, f.g, string_agg(i.s, {joiner} ORDER BY i.n) AS text FROM {p}_items i JOIN {p}_fold f ON f.{key} = i.{key} AND f.n = i.n GROUP BY i.{key}, f.g),
{p}_long AS (SELECT {key} || '|' || lpad(CAST(g AS VARCHAR), 9, '0') AS kg, text FROM {p}_groups WHERE length(text) > {MAX_CHARS}),
{cut_chars(p + "_cut", p + "_long", "kg")},
{p}_all AS (SELECT {key}, g, 0 AS j, {trim("text")} AS piece FROM {p}_groups WHERE length(text) <= {MAX_CHARS}
  UNION ALL SELECT gr.{key}, gr.g, c.j, c.piece FROM {p}_cut c JOIN {p}_groups gr ON c.kg = gr.{key} || '|' || lpad(CAST(gr.g AS VARCHAR), 9, '0')),
{p}_ok AS (SELECT {key} FROM {p}_all GROUP BY {key} HAVING count(*) > 1 AND bool_and(len(regexp_extract_all(piece, '```')) % 2 = 0)),
{p}_pieces AS (SELECT a.{key} AS {key}, row_number() OVER (PARTITION BY a.{key} ORDER BY a.g, a.j) - 1 AS seq, a.piece
  FROM {p}_all a JOIN {p}_ok o ON o.{key} = a.{key})"""


def sentence_pack(prefix: str, source: str, key: str) -> str:
    """Sentence packing over ``source(key, text)``."""
    p = prefix
    return f"""
{p}_s0 AS (SELECT {key}, {sentences("text")} AS ss FROM {source}),
{p}_s1 AS (SELECT {key}, ss FROM {p}_s0 WHERE len(ss) > 1),
{p}_items AS (SELECT {key}, n, s, length(s) AS len FROM (SELECT {key}, unnest(generate_series(1, len(ss))) AS n, unnest(ss) AS s FROM {p}_s1)),
{pack_items(p, key, "' '", 1)}"""


RULE = f"(?m)^[-*_](?:[{WS}]*[-*_]){{2,}}$"


def rule_parts(source: str) -> str:
    """``ru(doc_id, seq, content)`` for texts of ``source`` with at least one rule."""
    return f"""
ru0 AS (SELECT doc_id, parts FROM (SELECT doc_id, string_split_regex(text, '{RULE}') AS parts FROM {source}) WHERE len(parts) > 1),
ru1 AS (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM ru0),
ru2 AS (SELECT doc_id, 2 * i AS o, {trim("parts[i]")} AS content FROM ru1 UNION ALL SELECT doc_id, 2 * i + 1, {quote(STRUCK_RULE)} FROM ru1 WHERE i < len(parts)),
ru AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS seq, content FROM ru2 WHERE content <> '')"""


IMAGES = f"""
cleaned AS (SELECT doc_id, {display("text")} AS text FROM absolute),
im0 AS (SELECT doc_id, string_split_regex(text, '{IMAGE}') AS parts, regexp_extract_all(text, '{IMAGE}') AS found FROM cleaned),
im1 AS (SELECT doc_id, parts, found, unnest(generate_series(1, len(parts))) AS i FROM im0),
im2 AS (SELECT doc_id, 2 * i AS o, false AS is_image, {trim("parts[i]")} AS content FROM im1
        UNION ALL SELECT doc_id, 2 * i + 1, true, found[i] FROM im1 WHERE i <= len(found)),
im AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS seq, is_image, content FROM im2 WHERE content <> '')"""

# Line states: fences seen before a line say whether it is code and which block it belongs to; a
# blank line after a heading ends a paragraph.
BLOCKS = f"""
ln0 AS (SELECT doc_id, seq AS part, string_split(content, {LF}) AS ls FROM im WHERE NOT is_image),
ln1 AS (SELECT doc_id, part, unnest(generate_series(1, len(ls))) AS n, unnest(ls) AS line FROM ln0),
ln2 AS (SELECT *, CASE WHEN starts_with({trim("line")}, '```') THEN 1 ELSE 0 END AS fence FROM ln1),
ln3 AS (SELECT *, coalesce(sum(fence) OVER (PARTITION BY doc_id, part ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ln2),
ln4 AS (SELECT *, fence = 1 OR before % 2 = 1 AS code, before // 2 AS k FROM ln3),
ln5 AS (SELECT *, CASE WHEN NOT code AND {trim("line")} = '' AND regexp_matches({trim("lag(line) OVER w")}, '{HEADING}') AND NOT coalesce(lag(code) OVER w, true) THEN 1 ELSE 0 END AS flush
        FROM ln4 WINDOW w AS (PARTITION BY doc_id, part ORDER BY n)),
ln6 AS (SELECT *, coalesce(sum(flush) OVER (PARTITION BY doc_id, part ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM ln5),
bl0 AS (SELECT doc_id, part, min(n) AS first, code, {trim(f"string_agg(line, {LF} ORDER BY n)")} AS content, {trim("arg_min(line, n)")} AS opening
        FROM ln6 GROUP BY doc_id, part, code, k, CASE WHEN code THEN 0 ELSE piece END),
bl AS (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id, part ORDER BY first) - 1 AS seq,
              CASE WHEN code THEN 'code' ELSE 'paragraph' END AS type, content,
              CASE WHEN code THEN substr(opening, 4) END AS language
       FROM bl0 WHERE content <> '')"""

# Code packing: leading empty lines of a piece are dropped, so they open no group.
PACK_CODE = f"""
cl0 AS (SELECT doc_id || '/' || part || '/' || seq AS bk, content, language FROM bl WHERE type = 'code'),
cl1 AS (SELECT bk, unnest(generate_series(1, len(ls))) AS n, unnest(ls) AS line FROM (SELECT bk, string_split(content, {LF}) AS ls FROM cl0)),
cl2 AS (
  SELECT bk, n, line, 1 AS g, length(line) AS run, length(line) > 0 AS used FROM cl1 WHERE n = 1
  UNION ALL
  SELECT i.bk, i.n, i.line,
         CASE WHEN r.run > 0 AND r.run + 1 + length(i.line) <= {MAX_CODE} THEN r.g ELSE r.g + 1 END,
         CASE WHEN r.run > 0 AND r.run + 1 + length(i.line) <= {MAX_CODE} THEN r.run + 1 + length(i.line) ELSE length(i.line) END,
         (r.run > 0 AND r.run + 1 + length(i.line) <= {MAX_CODE}) OR length(i.line) > 0
  FROM cl2 r JOIN cl1 i ON i.bk = r.bk AND i.n = r.n + 1),
cl3 AS (SELECT bk, g, string_agg(line, {LF} ORDER BY n) AS content FROM cl2 WHERE used GROUP BY bk, g),
cl AS (SELECT c.bk, row_number() OVER (PARTITION BY c.bk ORDER BY c.g) - 1 AS seq, c.content, coalesce(o.language, '') AS language FROM cl3 c JOIN cl0 o ON o.bk = c.bk)"""

ATOMS = f"""
{PACK_CODE},
lp AS (SELECT doc_id || '/' || part || '/' || seq AS bk, content AS text FROM bl WHERE type = 'paragraph' AND length(content) > {MAX_CHARS}),
{sentence_pack("sp", "lp", "bk")},
lc AS (SELECT bk, text FROM lp WHERE bk NOT IN (SELECT bk FROM sp_ok)),
{cut_chars("fc", "lc", "bk")},
at0 AS (
  SELECT doc_id, seq AS part, 0 AS block, 0 AS sub, 'image' AS type, content, CAST(NULL AS VARCHAR) AS language FROM im WHERE is_image
  UNION ALL SELECT doc_id, part, seq, 0, type, content, language FROM bl WHERE length(content) <= {MAX_CHARS}
  UNION ALL SELECT b.doc_id, b.part, b.seq, c.seq, 'code', c.content, c.language FROM bl b JOIN cl c ON c.bk = b.doc_id || '/' || b.part || '/' || b.seq WHERE length(b.content) > {MAX_CHARS}
  UNION ALL SELECT b.doc_id, b.part, b.seq, c.seq, 'paragraph', c.piece, NULL FROM bl b JOIN sp_pieces c ON c.bk = b.doc_id || '/' || b.part || '/' || b.seq
  UNION ALL SELECT b.doc_id, b.part, b.seq, c.j, 'paragraph', c.piece, NULL FROM bl b JOIN fc c ON c.bk = b.doc_id || '/' || b.part || '/' || b.seq),
atoms AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, block, sub) - 1 AS seq, type, content, language FROM at0)"""

REPACK = f"""
rp0 AS (SELECT doc_id, seq, type, content, language, length(content) AS len, len(regexp_extract_all(content, '```')) % 2 AS odd FROM atoms),
rp1 AS (
  SELECT doc_id, seq, 0 AS g, len AS run, odd, type = 'image' AS image FROM rp0 WHERE seq = 0
  UNION ALL
  SELECT i.doc_id, i.seq,
         CASE WHEN ok THEN r.g ELSE r.g + 1 END, CASE WHEN ok THEN r.run + 2 + i.len ELSE i.len END,
         CASE WHEN ok THEN (r.odd + i.odd) % 2 ELSE i.odd END, CASE WHEN ok THEN false ELSE i.type = 'image' END
  FROM rp1 r JOIN rp0 i ON i.doc_id = r.doc_id AND i.seq = r.seq + 1,
  LATERAL (SELECT NOT r.image AND i.type <> 'image' AND r.run + 2 + i.len <= {MAX_CHARS} AND (r.odd + i.odd) % 2 = 0 AS ok)),
rp2 AS (SELECT i.doc_id AS doc_id, r.g, count(*) AS n, string_agg(i.content, {LF} || {LF} ORDER BY i.seq) AS joined, min(i.type) AS type, min(i.content) AS single, min(i.language) AS language
        FROM rp0 i JOIN rp1 r ON r.doc_id = i.doc_id AND r.seq = i.seq GROUP BY i.doc_id, r.g),
chunks AS (SELECT doc_id, g AS seq, count(*) OVER (PARTITION BY doc_id) AS n_chunks, CASE WHEN n = 1 THEN type ELSE 'paragraph' END AS type,
                  CASE WHEN n = 1 THEN single ELSE {trim("joined")} END AS content, CASE WHEN n = 1 THEN language END AS language FROM rp2)"""

TO_IMAGES = f"WITH RECURSIVE {MARKDOWN}, {ABSOLUTE}, {IMAGES}"
TO_BLOCKS = f"{TO_IMAGES}, {BLOCKS}"
TO_ATOMS = f"{TO_BLOCKS}, {ATOMS}"
TO_CHUNKS = f"{TO_ATOMS}, {REPACK}"
# The same chain over plain documents: nothing to resolve.
DOC_CHUNKS = f"WITH RECURSIVE absolute AS (SELECT doc_id, text FROM documents), {IMAGES}, {BLOCKS}, {ATOMS}, {REPACK}"

DELIVERY = f"""
dv0 AS (SELECT doc_id, text FROM md WHERE length(text) > {MAX_CHARS}),
dv1 AS (SELECT c.doc_id, c.seq, c.type, c.language, CASE WHEN c.type = 'image' THEN c.content ELSE {display("c.content")} END AS content FROM chunks c SEMI JOIN dv0 d ON d.doc_id = c.doc_id),
dv2 AS (SELECT doc_id || '/' || seq AS ck, content AS text FROM dv1 WHERE length(content) > {MAX_CHARS}),
{cut_chars("dvc", "dv2", "ck")},
dv3 AS (
  SELECT doc_id, seq, 0 AS sub, type, content, language FROM dv1 WHERE length(content) <= {MAX_CHARS}
  UNION ALL SELECT d.doc_id, d.seq, c.j, 'paragraph', c.piece, NULL FROM dv1 d JOIN dvc c ON c.ck = d.doc_id || '/' || d.seq
  UNION ALL SELECT doc_id, 0, 0, 'paragraph', {display("text")}, NULL FROM md WHERE length(text) <= {MAX_CHARS})"""

# --- pages --------------------------------------------------------------------------------------


def decode_html(c: str) -> str:
    """Entities that occur in the pages; browsers accept them without the semicolon too."""
    for name, char in [("quot", '"'), ("lt", "<"), ("amp", "&")]:
        c = f"regexp_replace({c}, '&{name};?', {quote(char)}, 'g')"
    return c


TITLE = trim(decode_html("regexp_extract(html, '<title>([^<]*)</title>', 1)"))
RAW_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '<[^>]*>', '', 'g')"


def decode_code(c: str) -> str:
    for name, char in CODE_ENTITIES:
        c = f"replace({c}, {quote(name)}, {quote(char)})"
    return c


META = f"""
meta AS (SELECT page_id, url, {TITLE} AS title,
  CASE WHEN page_id % 5 < 2 THEN 'Writer ' || page_id WHEN page_id % 4 = 0 THEN 'By line' END AS author,
  CASE WHEN page_id % 3 = 0 THEN '2024-03-' || (10 + page_id % 20) || 'T10:00:00.000Z' END AS published,
  CASE WHEN page_id % 4 = 0 THEN 'Short & plain' END AS description,
  CASE WHEN page_id % 7 = 0 THEN 'The Site' WHEN page_id % 7 = 1 THEN 'The Title' ELSE {site("url")} END AS site_name
 FROM mp)"""


def visible(c: str) -> str:
    """Text length as the page shows it."""
    no_comments = f"regexp_replace({c}, '(?s)<!--.*?-->', '', 'g')"
    decoded = f"replace(replace({decode_html(strip(no_comments))}, '&middot;', chr(183)), '&copy;', chr(169))"
    return collapse(decoded)


REGION = rf"""
rg0 AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'main' WHEN 2 THEN '.content' ELSE '#content' END AS selector,
  length({visible("regexp_extract(html, '(?s)(<article>.*</article>|<main>.*</main>|<div (?:class=.post content.|id=.content.)>.*</div>)', 1)")}) AS n_chars,
  length({visible("regexp_replace(regexp_extract(html, '(?s)</head>(.*)$', 1), '(?s)<nav>.*</nav>|<footer>.*</footer>', '', 'g')")}) AS total_chars FROM mp),
rg AS (SELECT *, (CAST(n_chars AS DOUBLE) / total_chars * 100) * CASE selector WHEN 'article' THEN 3.0::DOUBLE WHEN 'main' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END
   * CASE WHEN n_chars < 100 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS s FROM rg0)"""

def records(content: str, source: str = "pages") -> str:
    """``rc``: one record per address; ``jn``: links with their record."""
    return f"""
rc0 AS (SELECT {KEY} AS key, min(page_id) AS page_id FROM pages GROUP BY 1),
rc AS (SELECT r.key, p.page_id, p.url, {TITLE} AS title, {site("p.url")} AS site_name, {content} AS content FROM rc0 r JOIN {source} p ON p.page_id = r.page_id),
jn AS (SELECT l.message_id, l.pos, l.url, r.page_id, r.title, r.site_name, r.content FROM links l LEFT JOIN rc r ON r.key = regexp_replace(l.url, '#.*$', ''))"""


RECORDS = records(trim(decode_code(strip("regexp_extract(html, '(?s)<article>(.*)</article>', 1)"))))


def json_text(c: str) -> str:
    return f"CAST(to_json({c}) AS VARCHAR)"


BUNDLES = f"""
bu0 AS (SELECT message_id, count(*) AS n_pages, min(title) AS title, min(url) AS url, min(content) AS content, min(site_name) AS site_name,
   string_agg('  -' || {LF} || '    title: ' || {json_text("title")} || {LF} || '    url: ' || {json_text("url")}, {LF} ORDER BY pos) AS sources
  FROM jn WHERE page_id IS NOT NULL GROUP BY message_id),
bu1 AS (SELECT message_id, string_agg('## ' || k || '. ' || title || {LF} || {LF} || '**Source:** [' || url || '](' || url || ')  ' || {LF} || '**Scraped:** {ISO_ARCHIVED}'
    || {LF} || {LF} || content || {LF} || {LF} || '---' || {LF} || {LF}, '' ORDER BY k) AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY pos) AS k FROM jn WHERE page_id IS NOT NULL) GROUP BY message_id),
bu AS (SELECT b.message_id, n_pages, CASE WHEN n_pages = 1 THEN title ELSE 'Scraped Content (' || n_pages || ' links)' END AS name, title,
  CASE WHEN n_pages = 1 THEN '---' || {LF} || 'title: ' || {json_text("title")} || {LF} || 'source: ' || {json_text("url")} || {LF} || 'archived: "{ISO_ARCHIVED}"' || {LF} || 'site: ' || {json_text("site_name")} || {LF} || '---' || {LF} || {LF} || content
  ELSE '---' || {LF} || 'title: "Scraped Content"' || {LF} || 'sources:' || {LF} || sources || {LF} || 'archived: "{ISO_ARCHIVED}"' || {LF} || '---' || {LF} || {LF} || '# Scraped Content (' || n_pages || ' links)' || {LF} || {LF} || s.body END AS body
 FROM bu0 b JOIN bu1 s ON s.message_id = b.message_id)"""


def safe_thread(c: str) -> str:
    kept = f"regexp_replace({c}, '[^0-9A-Za-z_{WS}\\-.()]', '', 'g')"
    return f"coalesce(nullif(left({collapse(kept)}, 100), ''), 'Scraped Content')"


def safe_stem(c: str) -> str:
    out = f"""regexp_replace({c}, '[<>:"/\\\\|?*]', '', 'g')"""
    out = f"regexp_replace(regexp_replace({out}, '[{WS}]+', '-', 'g'), '-+', '-', 'g')"
    return f"coalesce(nullif(left(trim({out}, '-'), 100), ''), 'content')"


# --- events -------------------------------------------------------------------------------------

COUNTS = "cnt AS (SELECT *, row_number() OVER (PARTITION BY message_id, emoji_name ORDER BY ts, event_id) AS n FROM rx)"
ROUTES = f"""
st AS (SELECT c.*, g.guild_id IS NULL AND c.guild_id IS NOT NULL AS fresh, g.bookmark_emoji, g.bookmark_enabled, g.pin_emoji, g.pin_enabled, g.pin_threshold
   FROM cnt c LEFT JOIN guilds g ON g.guild_id = c.guild_id WHERE NOT c.user_is_bot),
rt0 AS (SELECT *, CASE
   WHEN (fresh OR bookmark_enabled) AND (emoji_name = coalesce(nullif(bookmark_emoji, ''), '{BOOKMARK_EMOJI}') OR coalesce(emoji_id = coalesce(nullif(bookmark_emoji, ''), '{BOOKMARK_EMOJI}'), false)) THEN 'bookmark'
   WHEN (fresh OR pin_enabled) AND (emoji_name = coalesce(nullif(pin_emoji, ''), '{PIN_EMOJI}') OR coalesce(emoji_id = coalesce(nullif(pin_emoji, ''), '{PIN_EMOJI}'), false))
        AND n >= CASE WHEN fresh THEN 3 ELSE pin_threshold END THEN 'pin'
   WHEN emoji_name = '{LINK_EMOJI}' AND n = 1 THEN 'link' END AS action FROM st),
routed AS (SELECT * FROM rt0 WHERE action IS NOT NULL)"""
TO_ROUTED = f"WITH {REACTIONS}, {GUILDS}, {COUNTS}, {ROUTES}"
ROUTED = "SELECT event_id, guild_id, channel_id, message_id, user_id, emoji_name, n, action FROM routed"
REACTION_CHANNELS = with_view("rc", views.REACTION_CHANNELS)
TEXT_PINS = """
p AS (SELECT channel_id, message_id, min(ts) AS pinned_at FROM routed WHERE action = 'pin' GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY pinned_at DESC, message_id DESC) AS rank
  FROM p WHERE channel_id IN (SELECT channel_id FROM rc WHERE type = 'text'))"""
CARDS = f"""
cards AS (SELECT message_id,
  CASE WHEN guild_name IS NOT NULL THEN 'Message from ' || guild_name || CASE WHEN channel_name IS NOT NULL AND channel_type = 'text' THEN ' #' || channel_name ELSE '' END END AS title,
  url, CASE WHEN content = '' THEN {quote(NO_CONTENT)} ELSE content END AS description,
  username || CASE WHEN discriminator <> '0' THEN '#' || discriminator ELSE '' END AS author FROM msg)"""

REQUESTS = """
rq AS (SELECT event_id, ia.guild_id AS guild_id, g.channel_category_id AS category_id, user_id, lower(regexp_replace(arg, '[^0-9A-Za-z_]', '-', 'g')) AS channel
  FROM ia JOIN guilds g ON g.guild_id = ia.guild_id WHERE kind = 'command' AND name = 'join' AND arg <> '' AND channels_enabled)"""

LINE = trim("line")
LINE_KIND = f"""CASE WHEN regexp_matches({LINE}, '^#{{1,6}}[{WS}]') THEN 'heading' WHEN regexp_matches({LINE}, '^[-*_]([{WS}]*[-*_]){{2,}}$') THEN 'rule'
  WHEN regexp_matches({LINE}, '^[-*+][{WS}]') THEN 'bullet' WHEN regexp_matches({LINE}, '^[0-9]+\\.[{WS}]') THEN 'ordered' WHEN starts_with({LINE}, '>') THEN 'quote'
  WHEN starts_with({LINE}, '```') THEN 'fence' WHEN regexp_matches({LINE}, '\\|.*\\|') THEN 'table' END"""


def language_case(c: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({c}, {quote('^' + p.replace(chr(92) + 's', f'[{WS}]'))}) THEN {quote(name)}" for p, name in CONTENT_PATTERNS)
    return f"CASE {arms} END"


def clean_up(c: str) -> str:
    mark = "chr(64985)"
    fence = "(?s)```.*?```"
    out = f"regexp_replace({c}, '{fence}', {mark}, 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', {LF} || {LF}, 'g')"
    out = f"regexp_replace({out}, '\\n(#{{1,6}})[{WS}]+', {LF} || '\\1 ', 'g')"
    out = f"regexp_replace({out}, '\\n([{WS}]*[-*+])[{WS}]+', {LF} || '\\1 ', 'g')"
    out = f"regexp_replace({out}, '(?m)[ \\t]+$', '', 'g')"
    out = f"regexp_replace({out}, '([^!])\\[([^\\]]+)\\]\\(([^)]+)\\)', '\\1 [\\2](\\3)', 'g')"
    return trim(f"regexp_replace({out}, '[ \\t]{{2,}}', ' ', 'g')")


CLEAN_UP = f"""
cu0 AS (SELECT doc_id, string_split({clean_up("text")}, chr(64985)) AS parts, regexp_extract_all(text, '(?s)```.*?```') AS code FROM md),
cu1 AS (SELECT doc_id, parts, code, unnest(generate_series(1, len(parts))) AS i FROM cu0),
cu AS (SELECT doc_id, string_agg(parts[i] || coalesce(code[i], ''), '' ORDER BY i) AS text FROM cu1 GROUP BY doc_id)"""

CODE_BODY = f"""'x = "' || {decode_html("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} || '";' || {LF} || 'y < 1'"""



def paragraphs(source: str) -> str:
    """``pg(doc_id, seq, content)``: plain runs of lines and single structural lines."""
    return f"""
pg0 AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, {LF}) AS ls FROM {source})),
pg1 AS (SELECT *, ({LINE_KIND}) IS NOT NULL AS alone, {LINE} = '' AS blank FROM pg0),
pg2 AS (SELECT *, CASE WHEN blank THEN 0 WHEN alone OR n = 1 OR lag(alone) OVER w OR lag(blank) OVER w THEN 1 ELSE 0 END AS opens FROM pg1 WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
pg3 AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS k FROM pg2),
pg AS (SELECT doc_id, CAST(k AS BIGINT) AS seq, string_agg(line, {LF} ORDER BY n) AS content FROM pg3 WHERE NOT blank GROUP BY doc_id, k)"""


# Rules first, then paragraphs, then sentences of a long text, then characters.
CASCADE = f"""
{rule_parts("cleaned")},
unruled AS (SELECT doc_id, text FROM cleaned WHERE doc_id NOT IN (SELECT doc_id FROM ru)),
{paragraphs("unruled")},
pp_items AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n, {trim("content")} AS s, length({trim("content")}) AS len FROM pg),
{pack_items("pp", "doc_id", f"{LF} || {LF}", 2)},
rest AS (SELECT doc_id, text FROM unruled WHERE doc_id NOT IN (SELECT doc_id FROM pp_ok)),
rest_long AS (SELECT doc_id, text FROM rest WHERE length(text) > {MAX_CHARS}),
{sentence_pack("ps", "rest_long", "doc_id")},
rest_chars AS (SELECT doc_id, text FROM rest WHERE doc_id NOT IN (SELECT doc_id FROM ps_ok)),
{cut_chars("pc", "rest_chars", "doc_id")},
ca AS (SELECT doc_id, seq, content FROM ru UNION ALL SELECT doc_id, seq, piece FROM pp_pieces UNION ALL SELECT doc_id, seq, piece FROM ps_pieces
  UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1, piece FROM pc)"""


def escaped(c: str) -> str:
    out = f"regexp_replace({c}, '([\\\\*`_\\[\\]])', '\\\\\\1', 'g')"
    out = f"regexp_replace({out}, '^(-|\\+ |=+|#{{1,6}} |~~~|>)', '\\\\\\1')"
    return f"regexp_replace({out}, '^([0-9]+)\\. ', '\\1\\\\. ')"


# The pages hold a heading and paragraphs. A bold start is never closed, so it goes on in every later
# paragraph; at most three of them are reopened, and a new one comes on top.
PAGE_MARKDOWN = f"""
pm0 AS (SELECT page_id, string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>') AS parts FROM pages),
pm1 AS (SELECT page_id, unnest(generate_series(1, len(parts))) AS i, unnest(parts) AS part FROM pm0),
pm2 AS (SELECT *, starts_with(part, '<b>') AS opens, contains(part, '<br>') AS breaks,
    coalesce(sum(CASE WHEN starts_with(part, '<b>') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    {escaped(collapse(decode_html(strip("part"))))} AS text FROM pm1),
pm3 AS (SELECT *, repeat('**', CAST(least(before, 3) + CASE WHEN opens THEN 1 ELSE 0 END AS INT)) AS stars FROM pm2),
pm AS (SELECT page_id, string_agg(CASE WHEN i = 1 THEN '# ' || text ELSE stars || text || CASE WHEN breaks THEN {LF} ELSE '' END || stars END, {LF} || {LF} ORDER BY i) AS markdown
  FROM pm3 WHERE text <> '' GROUP BY page_id)"""


# Elements of the test pages. A bold start is never closed: three at most are opened again in every later paragraph
# with text and in the footer, each inside the one before.
NODES = f"""{PAGE_MARKDOWN},
pb AS (SELECT page_id, CAST(least(before, 3) AS BIGINT) + CAST(opens AS BIGINT) AS m, len(regexp_extract_all(part, '<br>')) AS brs, opens
  FROM pm2 WHERE i > 1 AND {strip("part")} <> ''),
ps AS (SELECT page_id, sum(m) AS bolds, sum(m * (m - 1) // 2 + m * brs) AS inner_bold, least(sum(CAST(opens AS BIGINT)), 3) AS f FROM pb GROUP BY 1),
pc AS (SELECT pages.page_id, len(regexp_extract_all(html, '<li>')) AS li, len(regexp_extract_all(html, '<p>')) AS p, len(regexp_extract_all(html, '<br>')) AS br,
  coalesce(bolds, 0) AS bolds, coalesce(inner_bold, 0) AS inner_bold, coalesce(f, 0) AS f FROM pages LEFT JOIN ps ON ps.page_id = pages.page_id),
pt AS (SELECT *, 6 + 2 * li + p + br + bolds + f AS in_body FROM pc),
nodes AS (
  SELECT page_id, unnest(['html', 'head', 'meta', 'title', 'style', 'script', 'body', 'nav', 'ul', 'li', 'a', 'div', 'article', 'h1', 'p', 'b', 'br', 'footer']) AS tag,
    unnest([1, 1, 1, 1, 1, 1, 1, 1, 1, li, li, 1, 1, 1, p, bolds + f, br, 1]) AS n_nodes,
    unnest([6 + in_body, 4, 0, 0, 0, 0, in_body, 1 + 2 * li, 2 * li, li, 0, 0, 1 + p + br + bolds, 0, br + bolds, inner_bold + f * (f - 1) // 2, 0, f]) AS n_descendants
  FROM pt)"""

# Rule, language and code of each block of the pages with all markups.
MARKUP_BODY = "'x = \"' || page_id || ' & ' || translate(url, ':/.?=&#_', '') || '\";'"
MARKUPS = [
    ("expressive", "ts", f"{MARKUP_BODY} || {LF} || {LF} || 'end();'"),
    ("expressive", "text", MARKUP_BODY),
    ("container", "jsx", f"{MARKUP_BODY} || {LF} || 'end();'"),
    ("container", "javascript", MARKUP_BODY),
    ("astro", "go", f"{MARKUP_BODY} || {LF} || 'y z'"),
    ("astro", "zig", MARKUP_BODY),
    ("pre_code", "php", MARKUP_BODY),
    ("pre_code", "lua", MARKUP_BODY),
    ("pre_code", "perl", MARKUP_BODY),
    ("pre_code", "xml", MARKUP_BODY),
    ("pre_code", "yaml", MARKUP_BODY),
    ("pre_code", "python", f"'from a import b' || {LF} || {MARKUP_BODY}"),
    ("pre", "ini", MARKUP_BODY),
]
MARKUP_ROWS = " UNION ALL ".join(
    f"SELECT page_id, {k} AS seq, '{rule}' AS rule, '{language}' AS language, {code} AS code FROM pages" for k, (rule, language, code) in enumerate(MARKUPS)
)
# Blocks in fences, one after the other. The clean-up sets blank lines around a fenced part between line feeds; as a match
# takes both line feeds, the next block is not one, and what follows pairs its closing fence with the next opening one.
FENCED = f" || {LF} || ".join(f"'```{language}' || {LF} || {code} || {LF} || '```'" for _, language, code in MARKUPS)
MARKUP_TEXT = f"'# Code' || {LF} || {LF} || 'Call `' || {MARKUP_BODY} || '` or `y < 1` here.' || {LF} || {LF} || {FENCED}"
MARKUP_PAGES = f"""SELECT page_id, regexp_replace({MARKUP_TEXT}, '(?s)\\n(```.*?```)\\n', {LF} || {LF} || '\\1' || {LF} || {LF}, 'g') AS markdown FROM pages"""


# From the table msg on: links, pages and bundles, then chunks and delivery.
TO_BUNDLES = f"""{LINKS}, {PAGE_MARKDOWN}, pmp AS (SELECT p.*, markdown FROM pages p JOIN pm ON pm.page_id = p.page_id),
    {records("markdown", "pmp")}, {BUNDLES}"""
BUNDLE_FILE = f"CASE WHEN n_pages = 1 THEN {safe_stem('title')} ELSE 'scraped-content-{ARCHIVED_AT_MS}' END || '-' || message_id || '.md'"
SCRAPED = f"{LINKS}, {RECORDS}, sc AS (SELECT message_id, pos, url, CASE WHEN page_id % 9 <> 0 THEN page_id END AS page_id FROM jn)"
ARCHIVE = f"""{TO_BUNDLES}, absolute AS (SELECT message_id AS doc_id, body AS text FROM bu), md AS (SELECT * FROM absolute),
    {IMAGES}, {BLOCKS}, {ATOMS}, {REPACK}, {DELIVERY}
    SELECT doc_id AS message_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, sub) - 1 AS seq,
    count(*) OVER (PARTITION BY doc_id) AS n_chunks, type, content, language FROM dv3"""


def all_checks() -> dict[str, str]:
    """SQL per query name."""
    plain_docs = f"SELECT CAST(doc_id AS VARCHAR) AS k, {trim('text')} AS text FROM documents"
    return {
        "extract_links": f"WITH {MESSAGES}, {LINKS} SELECT message_id, pos, url FROM links",
        "link_host_counts": f"""WITH {MESSAGES}, u AS (SELECT unnest(regexp_extract_all(content, 'https?://[^{WS}]+')) AS url FROM msg)
            SELECT {site("url")} AS site, count(*) AS n_links FROM u GROUP BY 1""",
        "resolve_page_links": f"WITH {PAGE_LINKS} SELECT page_id, pos, link, {resolve_link('link', 'url')} AS resolved FROM pl",
        "absolutize_documents": f"WITH {MARKDOWN}, {ABSOLUTE} SELECT doc_id, text FROM absolute",
        "scrape_join": f"WITH {MESSAGES}, {LINKS}, {RECORDS} SELECT message_id, pos, url, page_id, title, site_name FROM jn",
        "failed_links": f"WITH {MESSAGES}, {LINKS}, {RECORDS} SELECT message_id, pos, url, 'Failed to scrape: ' || url AS error FROM jn WHERE page_id IS NULL",
        "scrape_summary": f"""WITH {MESSAGES}, {LINKS}, {RECORDS}, s AS (SELECT message_id, count(*) AS n_links, count(page_id) AS n_scraped FROM jn GROUP BY 1)
            SELECT *, 'Successfully scraped ' || n_scraped || ' out of ' || n_links || ' links' AS summary FROM s WHERE n_scraped > 0""",
        "clean_documents": f"WITH {MARKDOWN} SELECT doc_id, {display('text')} AS text FROM md",
        "clean_page_markdown": f"WITH {MARKDOWN}, {CLEAN_UP} SELECT doc_id, regexp_replace(text, '(?s)\\n(```.*?```)\\n', {LF} || {LF} || '\\1' || {LF} || {LF}, 'g') AS text FROM cu",
        "split_document_sentences": f"""WITH s AS (SELECT doc_id, {sentences("text")} AS ss FROM documents)
            SELECT doc_id, unnest(generate_series(0, len(ss) - 1)) AS seq, unnest(ss) AS sentence FROM s WHERE len(ss) > 0""",
        "classify_lines": f"""WITH {MARKDOWN}, l AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS seq, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, {LF}) AS ls FROM md))
            SELECT doc_id, seq, kind FROM (SELECT doc_id, seq, {LINE_KIND} AS kind FROM l) WHERE kind IS NOT NULL""",
        "heading_ends": f"""WITH {MARKDOWN}, l AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS seq, unnest(ls) AS part FROM (SELECT doc_id, string_split(text, {LF} || {LF}) AS ls FROM md))
            SELECT doc_id, seq, part FROM l WHERE regexp_matches({trim(f"string_split({trim('part')}, {LF})[-1]")}, '{HEADING}')""",
        "strip_page_markup": f"SELECT page_id, {decode_code(strip('html'))} AS text FROM pages",
        "truncate_documents": f"""SELECT doc_id, CASE WHEN length(text) <= 8000 THEN text
            WHEN length(regexp_extract(left(text, 8000), '^((?s:.*)[.!?])', 1)) - 1 > 6400 THEN regexp_extract(left(text, 8000), '^((?s:.*)[.!?])', 1) || {LF} || {LF} || '*[Content truncated]*'
            ELSE left(text, 8000) || {LF} || {LF} || '*[Content truncated]*' END AS text FROM documents""",
        "cap_documents": """SELECT doc_id, CASE WHEN strlen(text) <= 4096 THEN text
            ELSE left(text, list_max(list_filter(range(0, 3687), lambda n: strlen(left(text, n)) <= 4096))) END AS text FROM documents""",
        "event_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS again FROM events",
        "detect_code_language": f"WITH {with_view('sn', views.SNIPPETS)} SELECT doc_id, {language_case(trim('code'))} AS language FROM sn",
        "split_images": f"{TO_IMAGES} SELECT doc_id, seq, is_image, content FROM im",
        "image_cards": f"""{TO_IMAGES} SELECT doc_id, seq, regexp_extract(content, '\\]\\((.+)\\)$', 1) AS image_url,
            CASE WHEN {trim("regexp_extract(content, '^!.([^]]*)', 1)")} <> '' THEN regexp_extract(content, '^!.([^]]*)', 1) END AS caption FROM im WHERE is_image""",
        "code_fence_blocks": f"{TO_BLOCKS} SELECT doc_id, part, seq, type, content, language FROM bl",
        "pack_code_lines": f"""{TO_BLOCKS}, {PACK_CODE} SELECT b.doc_id, b.part, b.seq AS block, c.seq, c.content, c.language
            FROM bl b JOIN cl c ON c.bk = b.doc_id || '/' || b.part || '/' || b.seq""",
        "pack_sentences": f"WITH RECURSIVE d AS ({plain_docs}), {sentence_pack('sp', 'd', 'k')} SELECT CAST(k AS BIGINT) AS doc_id, seq, piece AS content FROM sp_pieces",
        "split_chars": f"WITH RECURSIVE d AS ({plain_docs}), {cut_chars('fc', 'd', 'k')} SELECT CAST(k AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY k ORDER BY j) - 1 AS seq, piece AS content FROM fc",
        "atomic_chunks": f"{TO_ATOMS} SELECT doc_id, seq, type, content, language FROM atoms",
        "chunk_markdown": f"{TO_CHUNKS} SELECT doc_id, seq, n_chunks, type, content, language FROM chunks",
        "chunk_documents": f"{DOC_CHUNKS} SELECT doc_id, seq, n_chunks, type, content, language FROM chunks",
        "chunk_quality": f"""{TO_CHUNKS} SELECT type, count(*) AS n_chunks, max(length(content)) AS max_len, CAST(sum(length(content)) AS BIGINT) AS total_len,
            count(*) FILTER (length(content) > 1000) AS n_over_half, count(*) FILTER (length(content) > 2000) AS n_over_limit,
            count(*) FILTER (len(regexp_extract_all(content, '```')) % 2 = 1) AS n_odd_fences FROM chunks GROUP BY type""",
        "delivery_chunks": f"""{TO_CHUNKS}, {DELIVERY} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, sub) - 1 AS seq,
            count(*) OVER (PARTITION BY doc_id) AS n_chunks, type, content, language FROM dv3""",
        "markdown_paragraphs": f"WITH {MARKDOWN}, {paragraphs('md')} SELECT doc_id, seq, content FROM pg",
        "split_rules": f"WITH {MARKDOWN}, {rule_parts('md')} SELECT doc_id, seq, content FROM ru",
        "chunk_cascade": f"""WITH RECURSIVE {MARKDOWN}, {ABSOLUTE}, cleaned AS (SELECT doc_id, {display("text")} AS text FROM absolute), {CASCADE}
            SELECT doc_id, seq, count(*) OVER (PARTITION BY doc_id) AS n_chunks, 'paragraph' AS type, content, CAST(NULL AS VARCHAR) AS language FROM ca""",
        "page_markdown": f"WITH {PAGE_MARKDOWN} SELECT page_id, markdown FROM pm",
        "scrape_pages": f"""WITH {PAGE_MARKDOWN} SELECT p.page_id, p.url, {TITLE} AS title, markdown AS content, CAST(NULL AS VARCHAR) AS author,
            CAST(NULL AS TIMESTAMP) AS published_at, CAST(NULL AS VARCHAR) AS description, {site("p.url")} AS site_name FROM pages p JOIN pm ON pm.page_id = p.page_id""",
        "page_chunks": f"""WITH RECURSIVE {PAGE_MARKDOWN}, absolute AS (SELECT page_id AS doc_id, markdown AS text FROM pm), {IMAGES}, {BLOCKS}, {ATOMS}, {REPACK}
            SELECT doc_id AS page_id, seq, n_chunks, type, content, language FROM chunks""",
        "archive_outbox": f"WITH RECURSIVE {MESSAGES}, {ARCHIVE}",
        "archive_files": f"WITH RECURSIVE {MESSAGES}, {TO_BUNDLES} SELECT {BUNDLE_FILE} AS filename, body FROM bu",
        "archive_failed": f"WITH {MESSAGES}, {SCRAPED} SELECT message_id, pos, url, 'Failed to scrape: ' || url AS error FROM sc WHERE page_id IS NULL",
        "archive_summaries": f"""WITH {MESSAGES}, {SCRAPED}, s AS (SELECT message_id, count(*) AS n_links, count(page_id) AS n_scraped FROM sc GROUP BY 1)
            SELECT *, 'Successfully scraped ' || n_scraped || ' out of ' || n_links || ' links' AS summary FROM s WHERE n_scraped > 0""",
        "page_names": f"SELECT page_id, {safe_thread(TITLE)} AS thread, {safe_stem(TITLE)} AS stem FROM pages",
        "event_time_forms": """SELECT event_id, strftime(CASE WHEN event_id % 13 IN (0, 2, 11) THEN date_trunc('second', ts) WHEN event_id % 13 = 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
            WHEN event_id % 13 < 9 THEN date_trunc('day', ts) WHEN event_id % 13 = 9 THEN date_trunc('month', ts) WHEN event_id % 13 = 10 THEN date_trunc('year', ts) END,
            '%Y-%m-%dT%H:%M:%S.%gZ') AS parsed FROM events""",
        "archive_delivery": f"WITH RECURSIVE {MESSAGES}, {ARCHIVE}",
        "stream_archive": f"""WITH RECURSIVE {TO_ROUTED.removeprefix("WITH ")}, {with_view("all_msg", views.MESSAGES)},
            msg AS (SELECT * FROM all_msg WHERE message_id IN (SELECT message_id FROM routed WHERE action = 'link')), {ARCHIVE}""",
        "page_metadata": f"WITH {META_PAGES}, {META} SELECT page_id, title, author, published, description, site_name FROM meta",
        "main_region": f"WITH {META_PAGES}, {REGION} SELECT page_id, selector, n_chars, total_chars, round(s, 6) AS score FROM rg",
        "dom_descendants": "SELECT page_id, 1 + 2 * len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*)</nav>', 1), '<li>')) AS n_descendants FROM pages",
        "code_blocks": f"""SELECT page_id, 0 AS seq, CASE WHEN page_id % 6 IN (1, 3) THEN 'pre' ELSE 'pre_code' END AS rule,
            CASE page_id % 6 WHEN 0 THEN 'sql' WHEN 1 THEN 'python' WHEN 2 THEN 'rust' WHEN 3 THEN 'text' WHEN 4 THEN 'css' ELSE 'python' END AS language,
            CASE WHEN page_id % 6 = 5 THEN 'import os' || {LF} ELSE '' END || {CODE_BODY} AS code FROM pages""",
        "page_nodes": f"WITH {NODES} SELECT page_id, tag, CAST(n_nodes AS BIGINT) AS n_nodes FROM nodes WHERE n_nodes > 0",
        "dom_containment": f"WITH {NODES} SELECT page_id, tag, CAST(n_nodes AS BIGINT) AS n_nodes, CAST(n_descendants AS BIGINT) AS n_descendants FROM nodes WHERE n_nodes > 0",
        "code_markups": MARKUP_ROWS,
        "code_markup_pages": MARKUP_PAGES,
        "front_matter": f"""WITH {META_PAGES}, {META} SELECT page_id, concat_ws({LF}, '---', 'title: ' || {json_text("title")}, 'source: ' || {json_text("url")}, 'archived: "{ISO_ARCHIVED}"',
            'author: ' || {json_text("author")}, 'published: ' || {json_text("published")}, 'description: ' || {json_text("description")}, 'site: ' || {json_text("site_name")}, '---') AS head FROM meta""",
        "bundle_markdown": f"""WITH {MESSAGES}, {LINKS}, {RECORDS}, {BUNDLES} SELECT message_id, n_pages, {safe_thread("name")} AS thread,
            CASE WHEN n_pages = 1 THEN {safe_stem("title")} ELSE 'scraped-content-{ARCHIVED_AT_MS}' END || '-' || message_id || '.md' AS filename, body FROM bu""",
        "bundle_names": f"SELECT page_id, {safe_thread(RAW_TITLE)} AS thread, {safe_stem(RAW_TITLE)} AS stem FROM pages",
        "reaction_counts": f"WITH {REACTIONS}, {COUNTS} SELECT event_id, message_id, emoji_name, n FROM cnt",
        "route_reactions": f"{TO_ROUTED} {ROUTED}",
        "pin_retention": f"""{TO_ROUTED}, p AS (SELECT channel_id, message_id, min(ts) AS pinned_at FROM routed WHERE action = 'pin' GROUP BY 1, 2),
            q AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY pinned_at DESC, message_id DESC) AS rank FROM p)
            SELECT channel_id, message_id, rank FROM q WHERE rank <= 50""",
        "guild_upsert": f"""WITH {REACTIONS}, {GUILDS} SELECT * FROM guilds UNION ALL
            SELECT DISTINCT guild_id, 1, '{BOOKMARK_EMOJI}', true, '{PIN_EMOJI}', true, 3, CAST(NULL AS VARCHAR), false FROM rx
            WHERE guild_id IS NOT NULL AND guild_id NOT IN (SELECT guild_id FROM guilds)""",
        "message_cards": f"WITH {MESSAGES}, {CARDS} SELECT * FROM cards",
        "bookmark_cards": f"""{TO_ROUTED}, {MESSAGES}, {CARDS} SELECT r.event_id, r.user_id, c.* FROM routed r JOIN cards c ON c.message_id = r.message_id WHERE r.action = 'bookmark'""",
        "bookmark_deliveries": f"""{TO_ROUTED}, {MESSAGES}, {CARDS}, {with_view("media", views.MEDIA)}, size AS (SELECT *, file_size * (n_files * (n_files + 1) // 2) AS total FROM media)
            SELECT r.event_id, r.user_id, c.message_id, c.author, avatar_url || '?size=64' AS icon_url,
            CASE WHEN total > 10485760 OR n_files = 0 THEN '' WHEN n_files = 1 THEN file_url || '-1' ELSE file_url || '-1 ' || file_url || '-2' END AS files, total > 10485760 AS files_left_out
            FROM routed r JOIN cards c ON c.message_id = r.message_id JOIN size ON size.message_id = c.message_id WHERE r.action = 'bookmark'""",
        "command_dispatch": f"""WITH {INTERACTIONS} SELECT event_id, name, user_id, name = 'join' AS has_autocomplete FROM ia WHERE kind = 'command' AND name IN ('join', 'flush', 'ping')""",
        "unknown_commands": f"""WITH {INTERACTIONS} SELECT event_id, name, 'Trying to execute nonexistent command ' || name AS warning FROM ia
            WHERE kind = 'command' AND name NOT IN ('join', 'flush', 'ping')""",
        "valid_deletes": f"""WITH {INTERACTIONS}, {MESSAGES} SELECT event_id, message_id, user_id FROM ia WHERE kind = 'button' AND name = 'deleteMessage'
            AND message_id IN (SELECT message_id FROM msg WHERE author_is_self)""",
        "delete_own_messages": f"""WITH {INTERACTIONS}, {MESSAGES} SELECT message_id, username FROM msg m WHERE NOT (author_is_self AND EXISTS (SELECT 1 FROM ia
            WHERE ia.message_id = m.message_id AND kind = 'button' AND name = 'deleteMessage'))""",
        "channel_get_or_create": f"""WITH {INTERACTIONS}, {GUILDS}, {CHANNELS}, {REQUESTS}, e AS (SELECT guild_id, category_id, name AS channel FROM ch WHERE type = 'text')
            SELECT *, false AS created FROM e UNION ALL
            SELECT DISTINCT guild_id, category_id, channel, true FROM rq WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.guild_id = rq.guild_id AND e.channel = rq.channel AND e.category_id IS NOT DISTINCT FROM rq.category_id)""",
        "channel_names": f"WITH {INTERACTIONS}, {GUILDS}, {CHANNELS}, {REQUESTS} SELECT guild_id, name AS channel FROM ch WHERE type = 'text' UNION SELECT guild_id, channel FROM rq",
        "channel_grants": f"WITH {INTERACTIONS}, {GUILDS}, {REQUESTS} SELECT DISTINCT guild_id, channel, user_id FROM rq",
        "channel_prefix": f"WITH {CHANNELS} SELECT guild_id, category_id, name FROM ch WHERE type = 'text' AND category_id IS NOT NULL AND name LIKE 'st%'",
        "stream_route": f"{TO_ROUTED} {ROUTED}",
        "stream_counts": f"WITH {REACTIONS} SELECT message_id, emoji_name, count(*) AS n FROM rx GROUP BY 1, 2",
        "channel_autocomplete": f"""WITH {GUILDS}, {CHANNELS}, {with_view("ty", views.TYPED)} SELECT event_id, name FROM ty
            JOIN guilds ON guilds.guild_id = ty.guild_id JOIN ch ON ch.guild_id = ty.guild_id AND ch.category_id = guilds.channel_category_id
            WHERE ch.type = 'text' AND starts_with(name, typed)""",
        "stored_settings": f"""WITH {with_view("old_st", views.OLD_SETTINGS)}, {with_view("new_st", views.NEW_SETTINGS)}
            SELECT guild_id, version, bookmark_emoji, bookmark_enabled, '📌' AS pin_emoji, false AS pin_enabled, 3 AS pin_threshold,
            CAST(NULL AS VARCHAR) AS channel_category_id, false AS channels_enabled FROM old_st
            UNION ALL SELECT guild_id, version, bookmark_emoji, bookmark_enabled, pin_emoji, pin_enabled, pin_threshold, channel_category_id, channels_enabled FROM new_st""",
        "stream_effects": f"""{TO_ROUTED} {ROUTED} WHERE action = 'bookmark'
            OR event_id IN (SELECT arg_min(event_id, (ts, event_id)) FROM routed GROUP BY message_id, action)""",
        "stream_pins": f"""{TO_ROUTED}, {REACTION_CHANNELS}, {TEXT_PINS} SELECT channel_id, message_id, CAST(1 AS BIGINT) AS n_pins,
            CAST(CASE WHEN rank > 10 THEN 1 ELSE 0 END AS BIGINT) AS n_unpins, rank <= 10 AS lasts FROM q""",
        "pin_text_channels": f"{TO_ROUTED}, {REACTION_CHANNELS}, {TEXT_PINS} SELECT channel_id, message_id, rank FROM q WHERE rank <= 50",
        "stream_first_actions": f"{TO_ROUTED} SELECT message_id, action, arg_min(event_id, (ts, event_id)) AS event_id FROM routed GROUP BY 1, 2",
    }


