"""Raw HTML to one row of tokens per page.

The only Python in page extraction: a tokenizer with tree repair, run over Arrow batches. What
the tokens mean (boilerplate, regions, metadata, Markdown) is decided by native expressions.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Executors need no copy of this package: what runs in Python travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OPEN, TEXT, CLOSE = 0, 1, 2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Start tags that end an open paragraph and do not reopen inline formatting.
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form "
    "header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
# Start tag -> open elements it ends, and the elements that stop the search for them.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
PREFIXED = {"li": "l", "blockquote": "q"}
SCOPE_STOP = frozenset(["html", "table", "td", "th", "caption"])
PARAGRAPH = frozenset(["p"])
PARAGRAPH_STOP = SCOPE_STOP | {"button"}

ELEMENT = pa.struct(
    [
        ("id", pa.int32()),
        ("parent", pa.int32()),
        ("nth", pa.int32()),
        ("kids", pa.int32()),
        ("open", pa.int32()),
        ("close", pa.int32()),
        ("tag", pa.string()),
        ("cls", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("last", pa.int32()),
        ("path", pa.string()),
    ]
)
TOKEN = pa.struct([("kind", pa.int32()), ("el", pa.int32()), ("text", pa.string())])

ELEMENT_DDL = (
    "array<struct<id:int,parent:int,nth:int,kids:int,open:int,close:int,tag:string,"
    "cls:array<string>,attrs:map<string,string>,last:int,path:string>>"
)
TOKEN_DDL = "array<struct<kind:int,el:int,text:string>>"


class PageTokenizer(HTMLParser):
    """Token list of one page, with implied end tags and reopened inline formatting."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.tokens: list[tuple[int, int, str | None]] = []
        self.stack: list[int] = []
        self.open: set[int] = set()
        self.depths: dict[str, list[int]] = {}
        self.path = ""
        self.formatting: list[int] = []
        self.body: int | None = None
        self.fresh_pre = False
        self._push("html", {})

    def updatepos(self, i: int, j: int) -> int:
        """Nobody asks for line numbers."""
        return j

    def _tag(self, element: int) -> str:
        return self.elements[element]["tag"]

    def _push(self, tag: str, attrs: dict[str, str], void: bool = False) -> int:
        parent = self.stack[-1] if self.stack else -1
        number = len(self.elements)
        self.elements.append(
            {
                "id": number,
                "parent": parent,
                "nth": self.elements[parent]["kids"] if parent >= 0 else 0,
                "kids": 0,
                "open": len(self.tokens),
                "close": len(self.tokens),
                "tag": tag,
                "cls": attrs.get("class", "").split(),
                "attrs": list(attrs.items()),
                "last": number,
                "path": self.path,
            }
        )
        if parent >= 0:
            self.elements[parent]["kids"] += 1
        self.tokens.append((OPEN, number, None))
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append(number)
        self.open.add(number)
        self.path += PREFIXED.get(tag, "")
        if void:
            self._pop()
        return number

    def _pop(self) -> None:
        number = self.stack.pop()
        element = self.elements[number]
        self.open.remove(number)
        self.depths[element["tag"]].pop()
        self.path = element["path"]
        element["close"] = len(self.tokens)
        element["last"] = len(self.elements) - 1
        self.tokens.append((CLOSE, number, None))

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self._pop()

    def _find(self, tags: set | frozenset, stop: set | frozenset) -> int:
        """Stack depth of the innermost element of ``tags``, or -1."""
        depth = self._deepest(tags)
        if depth <= 0:
            return -1
        for tag in stop:
            at = self.depths.get(tag)
            if at and at[-1] > depth and tag not in tags:
                return -1
        return depth

    def _deepest(self, tags: set | frozenset) -> int:
        deepest = -1
        for tag in tags:
            at = self.depths.get(tag)
            if at and at[-1] > deepest:
                deepest = at[-1]
        return deepest

    def _need_body(self) -> None:
        if self.body is None:
            self._pop_to(1)
            self.body = self._push("body", {})

    def _in_head(self) -> bool:
        return self.body is None and len(self.stack) > 1

    def _reopen_formatting(self) -> None:
        for position, number in enumerate(self.formatting):
            if number not in self.open:
                element = self.elements[number]
                self.formatting[position] = self._push(element["tag"], dict(element["attrs"]))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.fresh_pre = False
        values = {}
        for name, value in attrs:
            values.setdefault(name, value or "")
        if tag in ("html", "body", "head"):
            if tag == "body":
                known = self.body is not None
                self._need_body()
                tag_number = self.body
                if not known:
                    self.elements[tag_number]["attrs"] = list(values.items())
                    self.elements[tag_number]["cls"] = values.get("class", "").split()
            elif tag == "head" and self.body is None and len(self.stack) == 1:
                self._push("head", values)
            return
        if tag in HEAD_ONLY and self.body is None:
            if len(self.stack) == 1:
                self._push("head", {})
            self._push(tag, values, void=tag in VOID)
            return
        if not (self._in_head() and self._tag(self.stack[-1]) == "noscript"):
            self._need_body()
        if tag in IMPLIED_END:
            ends, stop = IMPLIED_END[tag]
            depth = self._find(ends, stop)
            if depth > 0:
                self._pop_to(depth)
        if tag in BLOCKS:
            depth = self._find(PARAGRAPH, PARAGRAPH_STOP)
            if depth > 0:
                self._pop_to(depth)
            if tag in HEADINGS and self._tag(self.stack[-1]) in HEADINGS:
                self._pop()
            self._push(tag, values, void=tag in VOID)
            self.fresh_pre = tag == "pre"
            return
        if tag in TABLE_PARTS:
            self._push(tag, values, void=tag in VOID)
            return
        if tag == "a" and any(self._tag(n) == "a" for n in self.formatting):
            self.handle_endtag("a")
        self._reopen_formatting()
        number = self._push(tag, values, void=tag in VOID)
        if tag in FORMATTING:
            same = [n for n in self.formatting if self._tag(n) == tag and self.elements[n]["attrs"] == self.elements[number]["attrs"]]
            if len(same) >= 3:
                self.formatting.remove(same[0])
            self.formatting.append(number)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.fresh_pre = False
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self._in_head():
                self._pop_to(1)
            return
        tags = HEADINGS if tag in HEADINGS else {tag}
        depth = self._find(tags, SCOPE_STOP)
        if tag in FORMATTING:
            self._end_formatting(tag, depth)
        elif depth > 0:
            self._pop_to(depth)

    def _end_formatting(self, tag: str, depth: int) -> None:
        active = [n for n in self.formatting if self._tag(n) == tag]
        if active:
            self.formatting.remove(active[-1])
        # A block inside the formatting element keeps it open until the block ends.
        if depth > 0 and self._deepest(BLOCKS) <= depth:
            self._pop_to(depth)

    def handle_data(self, data: str) -> None:
        if self.fresh_pre:
            self.fresh_pre = False
            data = data.removeprefix("\r\n") if data.startswith("\r\n") else data.removeprefix("\n")
        if not data:
            return
        if self.body is None and not (len(self.stack) > 2 and self._tag(self.stack[-1]) in HEAD_ONLY):
            if data.isspace():
                return
            self._need_body()
        tag = self._tag(self.stack[-1])
        if tag not in HEAD_ONLY:
            self._reopen_formatting()
        self.tokens.append((TEXT, self.stack[-1], data))

    def finish(self) -> None:
        self.close()
        self._need_body()
        self._pop_to(0)


def _tokenize(html: str | None) -> PageTokenizer:
    tokenizer = PageTokenizer()
    # Noncharacters serve as marks in later steps and have no place in a document.
    tokenizer.feed(_NONCHARACTERS.sub("\ufffd", html or ""))
    tokenizer.finish()
    return tokenizer


_NONCHARACTERS = re.compile("[\ufdd0-\ufdef]")
# Text whose tokens a task holds before they go out: as Python objects they take some thirty times its size.
_SLICE_CHARS = 1 << 18


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice holds much more than ``_SLICE_CHARS`` of text."""
    start = size = 0
    for row, length in enumerate(pa.compute.utf8_length(batch.column(column)).to_pylist()):
        size += length or 0
        if size >= _SLICE_CHARS:
            yield batch.slice(start, row + 1 - start)
            start, size = row + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def page_tokens(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Replace the HTML column by ``elements`` and ``tokens``; element id = array index.

    ``open`` and ``close`` are positions in ``tokens``, and ``last`` is the id of the last descendant, so
    containment of nodes is containment of intervals. ``path`` has a letter for each enclosing list item
    (l) and quotation (q), whose lines get a prefix.
    """
    keep = [name for name in pages.columns if name != html_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, html_col):
                done = [_tokenize(value.as_py()) for value in part.column(html_col)]
                elements = pa.array([t.elements for t in done], pa.list_(ELEMENT))
                tokens = _token_array(done)
                del done
                columns = [part.column(name) for name in keep] + [elements, tokens]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "elements", "tokens"])

    return pages.select(*keep, html_col).mapInArrow(run, f"{schema}, elements {ELEMENT_DDL}, tokens {TOKEN_DDL}")


def _token_array(done: list[PageTokenizer]) -> pa.ListArray:
    offsets, kinds, owners, texts = [0], [], [], []
    for tokenizer in done:
        for kind, owner, text in tokenizer.tokens:
            kinds.append(kind)
            owners.append(owner)
            texts.append(text)
        offsets.append(len(kinds))
    flat = pa.StructArray.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(owners, pa.int32()), pa.array(texts, pa.string())],
        fields=list(TOKEN),
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
