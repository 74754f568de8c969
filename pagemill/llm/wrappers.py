"""Main text of web pages by wrappers: union-free expressions inferred from the pages of a host.

A page is read as a stream of block elements and text runs. Streams of one host are aligned one after another with
the expression found so far. Where they agree, texts become slots. Where they disagree, the item that does not fit is
a repetition, if it fits an earlier item of the same element (what lies between becomes a repeated group), else an
optional item, found by looking ahead for the place where both agree again. An item knows in how many instances of
its parent it occurs and how often in all: it is optional where it misses some, repeated where it occurs more often.

The expression then tells which of its elements hold the article. Menus, footers, sidebars, notices, adverts, forms
and comments go by their element or by the words of their names. The article is the ``article`` or ``main`` element
with the most running text on the host; without one, the innermost element that holds most of it, without lists of
links and texts that every page repeats. Each page is aligned with its host's expression, and its runs take the
slot's part.

Inference covers all pages and is a sum in two steps: equal expressions are counted within each task and met again by
(host, hash of the expression), so that a host with a third of all pages is spread over many tasks; the partial
wrappers of a host are aligned last. Rows arrive sorted, one wrapper is held at a time, and order does not depend on
partitions. An element's content that outgrows ``Inference.items`` becomes one repeated group of its kinds of items,
which bounds a wrapper by its names, not by its pages. HTML itself is not shuffled unless the wrappers are too many to
broadcast by their written size.

Null HTML counts as empty and gives an empty text. A page without a host (null or relative URL) is its own wrapper.
Repeated page_ids are separate rows, each with its own text. An empty table gives no rows. Other columns are not
carried on, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, text_slices, written
from pagemill.llm.html_stream import DEPTH, Reader, Run


@dataclass(frozen=True)
class Inference:
    """``salts`` tasks share a host's expressions; ``items`` is how many items one content lists in order."""

    salts: int = 32
    items: int = 120
    held: int = 20_000
    slice_bytes: int = 4 << 20


# An item is [kind, content, instances, occurrences, more]. Kinds: SLOT with content [running text, linked text, hash of
# the only text, or 0], GROUP with a list of items, else an element's name with a list of items. More is the numbers of
# the page's runs for a slot, the rank among the places of the article for an element that is one, and the number of
# the item taken last for a group.
SLOT, GROUP = "#", "()"
KIND, CONTENT, INSTANCES, OCCURRENCES, RUNS = range(5)
RANK = LAST = RUNS
UNKNOWN = -1

# Elements that are never part of an article, and words of names that tell the same. Fixed values.
ASIDE_TAGS = {"head", "nav", "footer", "aside", "form", "noscript", "button", "select", "dialog", "menu", "search", "fieldset", "label"}
ASIDE_WORDS = {
    "nav", "navbar", "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "topbar",
    "masthead", "banner", "header", "topnav",
    "footer", "colophon", "contentinfo", "copyright",
    "sidebar", "aside", "rail", "widget", "widgets", "related", "recommended", "recommendations", "trending", "complementary",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "paywall", "newsletter", "subscribe",
    "signup", "popup", "modal", "overlay", "disclaimer", "dialog",
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "adslot", "adbox",
    "sponsor", "sponsored", "promo", "promotion", "promoted",
    "form", "search", "searchform", "login",
    "comment", "comments", "commentlist", "respond", "responses", "reply", "replies", "disqus", "discussion",
    "share", "sharing", "social", "teaser", "teasers",
}
# Words that also name the whole of a layout: an element with no other ones that holds half of the host's text is content.
WEAK_WORDS = {"widget", "widgets", "form", "header", "overlay", "modal", "search", "menu"}
# Words beside which a word tells of the layout and not of the element: has-sidebar, no-comments, comments-open.
BEFORE_WORDS = {"has", "with", "no", "not", "without", "non"}
AFTER_WORDS = {"open", "closed", "enabled", "disabled", "off"}
NEVER = ASIDE_TAGS - {"form", "fieldset", "label"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "respond", "responses", "reply", "replies", "disqus", "discussion"}
ARTICLE_TAGS = {"article", "main"}
ARTICLE_WORDS = {"articlebody"}
HEADER_WORDS = {"header", "masthead"}
# Elements whose name alone makes two of them alike; others are compared by what they hold.
NAMED_BY_TAG = ARTICLE_TAGS | {"nav", "header", "footer", "aside", "form", "ul", "ol", "li", "p", "dl", "dt", "dd"} | {f"h{n}" for n in range(1, 7)}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"ul", "ol", "dl", "div", "table", "p", "section"}
HOLDERS = {"div", "section", "table", "tbody", "tr", "td", "center", "form", "fieldset", "details"}
LINK_SHARE = 0.7


def tag_of(kind: str) -> str:
    return kind.partition(".")[0]


def words_of(kind: str) -> set[str]:
    return set(kind.split(".")[1:])


def own_words(words: list[str]) -> list[str]:
    """Words of a name without those that tell of the layout around."""
    around = zip(["", *words], words, [*words[1:], ""], strict=False)
    return [w for before, w, after in around if w not in ASIDE_WORDS or not (before in BEFORE_WORDS or after in AFTER_WORDS)]


def is_aside(kind: str) -> bool:
    return tag_of(kind) in ASIDE_TAGS or not ASIDE_WORDS.isdisjoint(words_of(kind))


def fits(a: list, b: list) -> bool:
    """Whether two items can be instances of one."""
    if a[KIND] != b[KIND] or a[KIND] == GROUP:
        return False
    if a[KIND] == SLOT or "." in a[KIND] or a[KIND] in NAMED_BY_TAG:
        return True
    left, right = ({item[KIND] for item in flat(x[CONTENT])} for x in (a, b))
    return left == right or 2 * len(left & right) >= len(left | right)


def flat(content: list) -> Iterator[list]:
    """Items of a content, those of its groups included."""
    for item in content:
        if item[KIND] == GROUP:
            yield from item[CONTENT]
        else:
            yield item


def join(a: list, b: list, params: Inference) -> None:
    """Make ``a`` stand for both items; only a repetition keeps the number of instances."""
    a[OCCURRENCES] += b[OCCURRENCES]
    if a[KIND] == SLOT:
        a[CONTENT] = added(a[CONTENT], b[CONTENT])
        if len(b) > RUNS:
            a[RUNS:] = [(a[RUNS] if len(a) > RUNS else []) + b[RUNS]]
    else:
        a[CONTENT] = align(a[CONTENT], b[CONTENT], params)
        if len(b) > RANK:
            a[RANK:] = [min(b[RANK], a[RANK]) if len(a) > RANK else b[RANK]]


def added(a: list, b: list) -> list:
    """Sums of two slots; the text is known as long as all texts are the same one."""
    text = b[2] if a[2] == UNKNOWN else a[2] if b[2] in (a[2], UNKNOWN) else 0
    return [a[0] + b[0], a[1] + b[1], text]


def _meet(a: list, b: list, params: Inference) -> list:
    a[INSTANCES] += b[INSTANCES]
    join(a, b, params)
    return a


def _absorb(group: list, item: list, params: Inference, repeated: bool = False) -> bool:
    """Take an item, or the items of another group, into a group that has one that fits.

    ``repeated`` says that it follows what the group took last: the item taken last again is a repetition of that
    item, an earlier one begins the group anew.
    """
    body = group[CONTENT]
    taken = item[CONTENT] if item[KIND] == GROUP else [item]
    if not any(fits(known, new) for known in body for new in taken):
        return False
    last = group[LAST] if repeated and item[KIND] != GROUP else -1
    for new in taken:
        at = next((at for at, known in enumerate(body) if fits(known, new)), None)
        if at is None:
            at = len(body)
            body.append(new)
        else:
            if at != last:
                body[at][INSTANCES] += new[INSTANCES]
            join(body[at], new, params)
        group[LAST:] = [at]
    if last < 0 or at < last:
        group[OCCURRENCES] += item[OCCURRENCES]
    if not repeated:
        group[INSTANCES] += item[INSTANCES]
    return True


def push(out: list, item: list, params: Inference) -> None:
    """Append an item to a content; one that fits an earlier item is a repetition of all from there."""
    for at in range(len(out) - 1, max(-1, len(out) - 1 - params.items), -1):
        known = out[at]
        if known[KIND] == GROUP or item[KIND] == GROUP:
            alike = any(fits(x, y) for x in flat([known]) for y in flat([item]))
        else:
            alike = fits(known, item)
        if not alike:
            continue
        if at == len(out) - 1 and known[KIND] != GROUP and item[KIND] != GROUP:
            join(known, item, params)
            return
        rest = out[at:]
        group = rest[0] if rest[0][KIND] == GROUP else [GROUP, [rest[0]], rest[0][INSTANCES], rest[0][INSTANCES], 0]
        for other in rest[1:]:
            if not _absorb(group, other, params, repeated=True):
                group[CONTENT].extend(flat([other]))
                group[LAST:] = [len(group[CONTENT]) - 1]
        _absorb(group, item, params, repeated=True)
        out[at:] = [group]
        return
    out.append(item)
    if len(out) > params.items:
        out[:] = [generalised(out, params)]


def generalised(content: list, params: Inference) -> list:
    """All items of a long content as one repeated group with one item of each tag."""
    kinds: dict[str, list] = {}
    for item in flat(content):
        item = [tag_of(item[KIND]) + "".join("." + word for word in sorted(words_of(item[KIND]) & ASIDE_WORDS)), *item[1:]]
        known = kinds.get(item[KIND])
        if known is None:
            kinds[item[KIND]] = item
        else:
            known[INSTANCES] += item[INSTANCES]
            join(known, item, params)
    return [GROUP, list(kinds.values()), max(i[INSTANCES] for i in content), sum(i[OCCURRENCES] for i in content), 0]


def align(left: list, right: list, params: Inference) -> list:
    """One content for both: agreeing items met, the others optional or repeated."""
    out: list = []
    i = j = 0
    while i < len(left) and j < len(right):
        a, b = left[i], right[j]
        if fits(a, b):
            push(out, _meet(a, b, params), params)
            i, j = i + 1, j + 1
        elif a[KIND] == GROUP and _absorb(a, b, params):
            j += 1
            while j < len(right) and _absorb(a, right[j], params, repeated=True):
                j += 1
            push(out, a, params)
            i += 1
        elif b[KIND] == GROUP and _absorb(b, a, params):
            i += 1
            while i < len(left) and _absorb(b, left[i], params, repeated=True):
                i += 1
            push(out, b, params)
            j += 1
        else:
            # Look ahead on both sides for where they agree again; the items on the shorter way are optional.
            on_left = next((k for k in range(i + 1, len(left)) if fits(left[k], b)), None)
            on_right = next((k for k in range(j + 1, len(right)) if fits(a, right[k])), None)
            if on_left is not None and (on_right is None or on_left - i <= on_right - j):
                for item in left[i:on_left]:
                    push(out, item, params)
                i = on_left
            elif on_right is not None:
                for item in right[j:on_right]:
                    push(out, item, params)
                j = on_right
            else:
                push(out, a, params)
                push(out, b, params)
                i, j = i + 1, j + 1
    for item in (*left[i:], *right[j:]):
        push(out, item, params)
    return out


class Folder:
    """Receives the stream of a page and folds it into an expression as its elements close."""

    def __init__(self, params: Inference) -> None:
        self.params = params
        self.stack: list[list] = [["page", [], 1, 1]]
        self.runs: list[str] = []

    def opened(self, tag: str, words: list[str]) -> None:
        kind = ".".join([tag, *own_words(words)])
        if len(self.stack) >= DEPTH and is_aside(self.stack[-1][KIND]) and not is_aside(kind):
            kind = self.stack[-1][KIND]
        self.stack.append([kind, [], 1, 1])

    def closed(self) -> None:
        done = self.stack.pop()
        push(self.stack[min(len(self.stack), DEPTH) - 1][CONTENT], done, self.params)

    def run(self, run: Run) -> None:
        text = run.text()
        if not text:
            return
        size = len(text) - text.count(" ")
        linked = min(size, run.linked)
        slot = [SLOT, [size - linked, linked, text_hash(text)], 1, 1, [len(self.runs)]]
        self.runs.append(text)
        push(self.stack[-1][CONTENT], slot, self.params)


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1 or 1


def counts_inline(tag: str, words: list[str]) -> bool:
    """An inline element counts as a block where its name tells that it is no part of an article."""
    return not ASIDE_WORDS.isdisjoint(own_words(words))


def page_expression(html: str | None, params: Inference) -> tuple[list, list[str]]:
    """The page's own expression and the texts of its runs."""
    folder = Folder(params)
    Reader(folder, counts_inline).read(html or "")
    return folder.stack[0], folder.runs


def slots(item: list) -> Iterator[list]:
    if item[KIND] == SLOT:
        yield item
    else:
        for inner in item[CONTENT]:
            yield from slots(inner)


def signature(item: list) -> str:
    """The expression as text: ``+`` for repeated, ``?`` for optional items."""
    mark = "+" if item[OCCURRENCES] > item[INSTANCES] else ""
    if item[KIND] == SLOT:
        return SLOT + mark
    inner = " ".join(
        signature(x) + ("?" if x[INSTANCES] < item[OCCURRENCES] else "") for x in item[CONTENT]
    )
    return f"{'' if item[KIND] == GROUP else item[KIND]}({inner}){mark}"


def bare(item: list) -> list:
    """Without the numbers of runs."""
    if item[KIND] == SLOT:
        return item[:RUNS]
    more = item[LAST:] if item[KIND] == GROUP else []
    return [item[KIND], [bare(x) for x in item[CONTENT]], item[INSTANCES], item[OCCURRENCES], *more]


def add_equal(a: list, b: list) -> None:
    """Add the counts of an expression of the same signature."""
    a[INSTANCES] += b[INSTANCES]
    a[OCCURRENCES] += b[OCCURRENCES]
    if a[KIND] == SLOT:
        a[CONTENT] = added(a[CONTENT], b[CONTENT])
    else:
        for x, y in zip(a[CONTENT], b[CONTENT], strict=True):
            add_equal(x, y)


def merged(a: list, b: list, params: Inference) -> list:
    """One expression for both pages or wrappers; ``a`` is used up."""
    return _meet(a, b, params)


def dump(item: list) -> str:
    return json.dumps(item, separators=(",", ":"), ensure_ascii=False)


# What an expression tells about the article.


class Reading:
    """An expression's parts by what they are."""

    def __init__(self, wrapper: list) -> None:
        self.wrapper = wrapper
        self.total = sum(slot[CONTENT][0] for slot in slots(wrapper))
        self.sums: dict[int, tuple[int, int]] = {}
        self.holds: dict[int, bool] = {}

    def text_sums(self, item: list) -> tuple[int, int]:
        """Running and linked text of an item."""
        if id(item) not in self.sums:
            inner = [x[CONTENT][:2] if x[KIND] == SLOT else self.text_sums(x) for x in item[CONTENT]]
            self.sums[id(item)] = (sum(x[0] for x in inner), sum(x[1] for x in inner))
        return self.sums[id(item)]

    def holds_article(self, item: list) -> bool:
        """Whether an article with much of the host's text lies in it: a form around a whole page, ``div.with-sidebar``."""
        if id(item) not in self.holds:
            self.holds[id(item)] = any(
                (is_article(x[KIND]) and 10 * self.text_sums(x)[0] >= 3 * self.total > 0)
                or (tag_of(x[KIND]) not in NEVER and self.holds_article(x))
                for x in item[CONTENT]
                if x[KIND] != SLOT
            )
        return self.holds[id(item)]

    def left_out(self, item: list, in_article: bool) -> bool:
        """Whether an element is no part of the article. An article's own header is one."""
        kind = item[KIND]
        tag, words = tag_of(kind), words_of(kind)
        if tag == "main" or kind == GROUP:
            return False
        if tag in NEVER or not COMMENT_WORDS.isdisjoint(words):
            return True
        told = words & ASIDE_WORDS
        if tag not in ASIDE_TAGS and tag != "header" and told and told <= WEAK_WORDS and 2 * self.text_sums(item)[0] >= self.total > 0:
            return False
        header = tag == "header" or (not HEADER_WORDS.isdisjoint(words) and tag not in HEADINGS)
        if header and not in_article:
            return not self.holds_article(item)
        if tag in ASIDE_TAGS or told - HEADER_WORDS:
            return not self.holds_article(item)
        if in_article or is_article(kind) or len(item) > RANK or self.holds_article(item):
            return False
        running, linked = self.text_sums(item)
        return tag in LISTS and linked > LINK_SHARE * (running + linked)

    def mass(self, item: list, constant: bool) -> int:
        """Running text but for parts that are left out; texts that never vary count if ``constant``."""
        if item[KIND] == SLOT:
            return item[CONTENT][0] if constant or not is_constant(item) else 0
        if item is not self.wrapper and self.left_out(item, False):
            return 0
        return sum(self.mass(x, constant) for x in item[CONTENT])

    def articles(self, item: list) -> Iterator[list]:
        for inner in item[CONTENT]:
            if inner[KIND] != SLOT and not self.left_out(inner, False):
                if is_article(inner[KIND]):
                    yield inner
                yield from self.articles(inner)

    def rank(self) -> None:
        """Mark where the article may be; a page takes the place of the lowest rank that has text."""
        found = []
        for number, item in enumerate(self.articles(self.wrapper)):
            mass = self.text_sums(item)[0]
            around = tag_of(item[KIND]) == "main" and not self.has_title(item)
            found.append((-(mass // 2) if around else -mass, number, item))
        places = [item for _, _, item in sorted(found, key=lambda x: x[:2])] or self.descend()
        for rank, item in enumerate(places):
            item[RANK:] = [rank]
        self.wrapper[RANK:] = [len(places)]

    def has_title(self, item: list) -> bool:
        """Whether the main heading lies in it, outside articles: then it is the article with its heading."""
        parts = [x for x in item[CONTENT] if x[KIND] != SLOT and not is_article(x[KIND]) and not self.left_out(x, True)]
        return any(tag_of(x[KIND]) == "h1" or self.has_title(x) for x in parts)

    def descend(self) -> list[list]:
        """Innermost first: elements with most of the running text of the one around, until headings lie beside it."""
        constant = not self.mass(self.wrapper, False)
        at, places = self.wrapper, []
        while True:
            inner = [x for x in flat(at[CONTENT]) if x[KIND] != SLOT]
            best = max(inner, key=lambda x: self.mass(x, constant), default=None)
            if best is None or tag_of(best[KIND]) not in HOLDERS or any(tag_of(x[KIND]) in ("h1", "h2") for x in inner):
                return places[::-1]
            if 10 * self.mass(best, constant) < 6 * self.mass(at, constant):
                return places[::-1]
            places.append(best)
            at = best


def is_constant(slot: list) -> bool:
    return slot[CONTENT][2] not in (0, UNKNOWN) and slot[OCCURRENCES] > 2


def is_article(kind: str) -> bool:
    words = words_of(kind)
    return (tag_of(kind) in ARTICLE_TAGS or not ARTICLE_WORDS.isdisjoint(words)) and words.isdisjoint(ASIDE_WORDS - HEADER_WORDS)


def main_runs(wrapper: list, page: list | None, params: Inference) -> list[int]:
    """Numbers of the page's runs that belong to the article, by the ranked expression aligned with the page's.

    ``wrapper`` is used up. A page of its own is its wrapper.
    """
    whole = merged(wrapper, page, params) if page is not None else wrapper
    reading = Reading(whole)
    varied = bool(reading.mass(whole, False))
    kept: dict[int, list[int]] = {}

    def take(item: list, ranks: tuple[int, ...], in_article: bool) -> None:
        for inner in item[CONTENT]:
            if inner[KIND] == SLOT:
                if len(inner) > RUNS and (in_article or not varied or not is_constant(inner)):
                    for rank in ranks:
                        kept.setdefault(rank, []).extend(inner[RUNS])
            elif not reading.left_out(inner, in_article):
                own = (*ranks, inner[RANK]) if inner[KIND] != GROUP and len(inner) > RANK else ranks
                take(inner, own, in_article or is_article(inner[KIND]))

    take(whole, tuple(whole[RANK:]), False)
    return sorted(kept[min(kept)]) if kept else []


# Spark.


def host(url: str) -> Column:
    """Lower-case host of a URL column, null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


class Expressions:
    """Expressions of pages, equal ones of a host counted once for as long as they are held."""

    def __init__(self, params: Inference) -> None:
        self.params = params
        self.known: dict[tuple[str, str], list] = {}

    def _rows(self) -> Iterator[pa.RecordBatch]:
        yield _wrapper_rows([(name, sign, dump(item)) for (name, sign), item in self.known.items()])
        self.known = {}

    def __call__(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, end in text_slices(batch, "html", self.params.slice_bytes):
            part = batch.slice(start, end - start)
            for name, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                item = bare(page_expression(html, self.params)[0])
                key = (name, signature(item))
                if key in self.known:
                    add_equal(self.known[key], item)
                else:
                    self.known[key] = item
            if len(self.known) > self.params.held:
                yield from self._rows()

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self._rows()


class Merging:
    """Sorted rows (group, signature, expression): one wrapper a group, held until the next group begins."""

    def __init__(self, params: Inference, last: bool) -> None:
        self.params = params
        self.last = last
        self.group: tuple | None = None
        self.wrapper: list | None = None
        self.equal: tuple[str, list] | None = None

    def _settle(self) -> None:
        if self.equal:
            item = self.equal[1]
            self.wrapper = item if self.wrapper is None else merged(self.wrapper, item, self.params)
            self.equal = None

    def _done(self) -> Iterator[tuple[str, str, str]]:
        self._settle()
        if self.wrapper is not None:
            if self.last:
                Reading(self.wrapper).rank()
            yield self.group[0], signature(self.wrapper), dump(self.wrapper)
        self.wrapper = None

    def __call__(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        names = ("host", "salt", "signature", "expression")
        for name, salt, sign, text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            group = (name, None if self.last else salt)
            if group != self.group:
                out.extend(self._done())
                self.group = group
            item = json.loads(text)
            if self.equal and self.equal[0] == sign:
                add_equal(self.equal[1], item)
            else:
                self._settle()
                self.equal = (sign, item)
        yield _wrapper_rows(out)

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield _wrapper_rows(list(self._done()))


WRAPPER = "host string, signature string, expression string"


def _wrapper_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["host", "signature", "expression"])


def infer(pages: DataFrame, params: Inference = Inference()) -> DataFrame:
    """The wrapper of every host over all of its pages: (host, signature, expression)."""
    known = pages.select(host("url").alias("host"), "html").where("host is not null")
    rows = map_batches(known, WRAPPER, lambda: Expressions(params))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("signature"), F.lit(params.salts)).cast("int"))
    order = ["host", "salt", "signature", "expression"]
    parts = salted.repartition("host", "salt").sortWithinPartitions(*order).select(*order)
    partial = map_batches(parts, WRAPPER, lambda: Merging(params, last=False))
    again = partial.withColumn("salt", F.lit(0)).repartition("host").sortWithinPartitions("host", "signature", "expression").select(*order)
    return map_batches(again, WRAPPER, lambda: Merging(params, last=True))


def extract(pages: DataFrame, wrappers: DataFrame, params: Inference = Inference()) -> DataFrame:
    """Main text of every page: (page_id, url, text, n_chars). ``wrappers`` is a written table."""
    plain = wrappers.select(F.col("host").alias("wrapper_host"), "expression")
    met = pages.select("page_id", "url", "html", host("url").alias("page_host"))
    joined = met.join(plain, F.col("page_host") == F.col("wrapper_host"), "left").select("page_id", "url", "html", "expression")
    kinds = ", ".join(f"{name} {pages.schema[name].dataType.simpleString()}" for name in ("page_id", "url"))

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        known: dict[tuple[int, int], list[int]] = {}

        def chosen(expression: str, page: list) -> list[int]:
            """Slots of the page that belong to the article, by number; once for equal pages of a host."""
            shape = _shape(page)
            key = (text_hash(expression), text_hash(dump(shape)))
            if key not in known:
                if len(known) >= params.held:
                    known.clear()
                for number, slot in enumerate(slots(shape)):
                    slot.append([number])
                known[key] = main_runs(json.loads(expression), shape, params)
            return known[key]

        def text(html: str | None, expression: str | None) -> str:
            page, runs = page_expression(html, params)
            if expression is None:
                Reading(page).rank()
                numbers = main_runs(page, None, params)
            else:
                found = list(slots(page))
                numbers = sorted(run for at in chosen(expression, page) for run in found[at][RUNS])
            return " ".join(runs[number] for number in numbers)

        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for start, end in text_slices(batch, "html", params.slice_bytes):
                part = batch.slice(start, end - start)
                given = zip(part.column("html").to_pylist(), part.column("expression").to_pylist(), strict=True)
                texts = pa.array([text(*row) for row in given], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), texts], names=["page_id", "url", "text"])

        return one

    return map_batches(joined, f"{kinds}, text string", make).withColumn("n_chars", F.length("text").cast("long"))


def _shape(item: list) -> list:
    """What of a page's expression matters for alignment: pages of one shape have equal ones."""
    many = 2 if item[OCCURRENCES] > item[INSTANCES] else 1
    if item[KIND] == SLOT:
        return [SLOT, [0, 0, UNKNOWN], 1, many]
    more = item[LAST:] if item[KIND] == GROUP else []
    return [item[KIND], [_shape(x) for x in item[CONTENT]], 1, many, *more]


def main_text(pages: DataFrame, params: Inference = Inference()) -> DataFrame:
    """Wrappers of all hosts, and the main text of all pages by them."""
    return extract(pages, written(infer(pages, params), "wrappers"), params)
