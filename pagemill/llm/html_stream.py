"""Raw HTML as a stream of block elements and text runs, read in one linear pass."""

from __future__ import annotations

import re
from html import unescape

# Elements of the HTML standard by what their tags do to blocks.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW_TEXT = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
RAW = RAW_TEXT | {"template", "svg", "math", "object", "canvas"}
BLOCK = {
    "address", "article", "aside", "blockquote", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "label",
    "legend", "li", "main", "menu", "nav", "noscript", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
KEEPS_PARAGRAPH = {"button", "head", "label", "noscript", "optgroup", "option", "select", "table"}
# Start tag: the open elements that it ends, and the elements beyond which they stay open.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
CELL = {"table", "td", "th", "caption", "button"}

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LETTER = re.compile("[a-zA-Z]")
_LOOSE_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_CHUNKS = re.compile(r"[^\W_]+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\Wa-zA-Z]+")

#: Elements below this depth are read as siblings of the element there. Texts stay; only the nesting is less deep.
DEPTH = 48


def name_words(attributes: str) -> list[str]:
    """Words of the element's class, id, role and itemprop, in order, each once. Numbers, and chunks with one inside, go."""
    words = {}
    for match in _NAMED.finditer(attributes) if "=" in attributes else ():
        for chunk in _CHUNKS.findall(match[2] or match[3] or match[4] or ""):
            chunk = chunk.rstrip("0123456789")
            if not any(letter.isdigit() for letter in chunk):
                words |= dict.fromkeys(word.lower() for word in _WORDS.findall(chunk))
    return list(words)


class Run:
    """The text of one block between two block boundaries, and how much of it stands in links."""

    __slots__ = ("pieces", "linked")

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.linked = 0

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


class Reader:
    """Calls ``opened(key words, tag)``, ``closed()`` and ``run(Run)`` of a receiver in page order.

    ``named`` tells of an inline element's words whether it is to count as a block.
    """

    def __init__(self, receiver: object, named: object) -> None:
        self.to = receiver
        self.named = named
        self.stack: list[str] = []
        self.at: dict[str, list[int]] = {}
        self.in_link = False
        self.current = Run()
        self.endless: set[str] = set()

    def _flush(self) -> None:
        if self.current.pieces:
            self.to.run(self.current)
            self.current = Run()

    def _open(self, tag: str, words: list[str]) -> None:
        self._flush()
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append(tag)
        self.to.opened(tag, words)

    def _close_to(self, depth: int) -> None:
        self._flush()
        while len(self.stack) > depth:
            self.at[self.stack.pop()].pop()
            self.to.closed()

    def _end(self, tags: set[str], stop: set[str]) -> bool:
        """Close the innermost open element of ``tags``, unless one of ``stop`` lies further in."""
        depth = -1
        for tag in tags:
            depths = self.at.get(tag)
            if depths and depths[-1] > depth:
                depth = depths[-1]
        if depth < 0:
            return False
        for tag in stop:
            depths = self.at.get(tag)
            if depths and depths[-1] > depth and tag not in tags:
                return False
        self._close_to(depth)
        return True

    def _leave_head(self, tag: str) -> None:
        if tag not in IN_HEAD and self.at.get("head"):
            self._close_to(self.at["head"][-1])

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.current.pieces.append("\n")
            return
        if tag == "a":
            self.in_link = True
        if tag == "hr":
            self._flush()
        if tag in ("html", "body"):
            self._leave_head(tag)
            return
        self._leave_head(tag)
        if tag in VOID:
            return
        words = name_words(attributes)
        if tag not in BLOCK and not self.named(tag, words):
            return
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in BLOCK and tag not in KEEPS_PARAGRAPH:
            self._end({"p"}, CELL)
        self._open(tag, words)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag == "br":
            self.current.pieces.append("\n")
        elif self.at.get(tag):
            self._end({tag}, CELL)

    def text(self, data: str) -> None:
        if self.at.get("head"):
            if not data.strip():
                return
            self._leave_head("")
        data = unescape(data) if "&" in data else data
        self.current.pieces.append(data)
        if self.in_link:
            self.current.linked += len(data) - data.count(" ")

    def _after_raw(self, tag: str, html: str, at: int) -> int:
        """Where reading goes on after raw content. Without an end tag, text elements reach to the end, others are skipped."""
        close = None if tag in self.endless else _RAW_END[tag].search(html, at)
        if close:
            return close.end()
        self.endless.add(tag)
        return len(html) if tag in RAW_TEXT else at

    def read(self, html: str) -> None:
        at, size, tag_pattern = 0, len(html), _TAG
        while at < size:
            opening = html.find("<", at)
            if opening < 0:
                self.text(html[at:])
                break
            follows = html[opening + 1 : opening + 2]
            if not follows or not (follows in "!/?" or _LETTER.match(follows)):
                after = html.find("<", opening + 1)
                after = size if after < 0 else after
                self.text(html[at:after])
                at = after
                continue
            if opening > at:
                self.text(html[at:opening])
            if html.startswith("<!--", opening):
                close = html.find("-->", opening + 2)
                at = size if close < 0 else close + 3
                continue
            match = tag_pattern.match(html, opening)
            if match is None and tag_pattern is _TAG and (_LETTER.match(follows) or follows == "/"):
                tag_pattern = _LOOSE_TAG  # a quote stays open to the end: from here on a tag ends at its first >
                match = tag_pattern.match(html, opening)
            if match is None:  # declarations, and marks of no tag, up to the next >
                close = html.find(">", opening)
                at = size if close < 0 else close + 1
                continue
            tag, at = match[1].lower(), match.end()
            if follows == "/":
                self.end(tag)
                continue
            if tag in RAW and not match[2].endswith("/"):
                at = self._after_raw(tag, html, at)
                continue
            self.start(tag, match[2])
        self._close_to(0)
