"""Code blocks of tokenised pages, found by an ordered rule table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codelang import language_of_code, language_of_pre, prefixed
from ..functions.core import built_once, let, pick
from ..functions.text import decode_entities, newline_normalised, trim_ws
from ..sources.html import TEXT
from .chunking import explode_array
from .pages import Page, flagged, page_columns, topmost

NBSP = chr(0xA0)


def inside(els: Column, e: Column) -> Column:
    """Descendant elements; ids grow with document order, so they are a slice."""
    return F.slice(els, e["id"] + 2, e["last"] - e["id"])


def has_class(e: Column, name: str) -> Column:
    return F.array_contains(e["cls"], name)


def raw_text(page: Page, e: Column) -> Column:
    span = F.slice(page["tokens"], e["open"] + 1, e["close"] - e["open"] + 1)
    return F.array_join(F.transform(F.filter(span, lambda t: t["kind"] == TEXT), lambda t: t["text"]), "")


def _first(els: Column, e: Column, tag: str) -> Column:
    return pick(F.filter(inside(els, e), lambda d: d["tag"] == tag), 0)


def _with_class(els: Column, e: Column, name: str) -> Column:
    return F.filter(inside(els, e), lambda d: has_class(d, name))


def _lines(page: Page, elements: Column, text: Callable[[Column], Column]) -> Column:
    return F.when(F.size(elements) > 0, F.array_join(F.transform(elements, text), "\n"))


def _result(language: Column, code: Column) -> Column:
    return F.struct(language.alias("language"), code.alias("code"))


@dataclass(frozen=True)
class Rule:
    """A kind of code block: which element it is and how language and code are read from it."""

    name: str
    match: Callable[[Page, Column], Column]
    render: Callable[[Page, Column], Column]


def _is_expressive(page: Page, e: Column) -> Column:
    return (e["tag"] == "div") & has_class(e, "expressive-code") & _first(page["els"], e, "pre").isNotNull()


def _expressive(page: Page, e: Column) -> Column:
    def line(d: Column) -> Column:
        return let(lambda b: F.coalesce(decode_entities(raw_text(page, b["span"])), F.lit("")), span=pick(_with_class(page["els"], d, "code"), 0))

    def body(b: Column) -> Column:
        pre = b["pre"]
        code = F.coalesce(
            _lines(page, _with_class(page["els"], pre, "ec-line"), line),
            _lines(page, _with_class(page["els"], pre, "code"), lambda d: raw_text(page, d)),
            raw_text(page, pre),
        )
        language = F.coalesce(F.nullif(F.element_at(pre["attrs"], "data-language"), F.lit("")), F.lit("text"))
        return _result(language, trim_ws(newline_normalised(code)))

    return let(body, pre=_first(page["els"], e, "pre"))


# Fixed value: the class of the containers of the second rule.
CONTAINER_CLASS = "codeBlockContainer_ZGJx"


def _is_container(page: Page, e: Column) -> Column:
    parent = pick(page["els"], e["parent"])
    prism = F.exists(inside(page["els"], e), lambda d: (d["tag"] == "pre") & has_class(d, "prism-code"))
    return (e["tag"] == "div") & has_class(e, CONTAINER_CLASS) & prism & ~F.coalesce(has_class(parent, CONTAINER_CLASS), F.lit(False))


def _container(page: Page, e: Column) -> Column:
    def body(b: Column) -> Column:
        pre = b["pre"]
        code = F.coalesce(
            _lines(page, _with_class(page["els"], pre, "token-line"), lambda d: raw_text(page, d)),
            raw_text(page, b["code"]),
            raw_text(page, pre),
        )
        language = F.coalesce(prefixed(e["cls"], "language-"), prefixed(pre["cls"], "language-"), F.lit("javascript"))
        return _result(language, trim_ws(newline_normalised(code)))

    return let(
        lambda a: let(body, pre=a["pre"], code=_first(page["els"], a["pre"], "code")),
        pre=_first(page["els"], e, "pre"),
    )


def _is_astro(page: Page, e: Column) -> Column:
    return (e["tag"] == "pre") & has_class(e, "astro-code") & _first(page["els"], e, "code").isNotNull()


def _astro(page: Page, e: Column) -> Column:
    def clean(d: Column) -> Column:
        return decode_entities(F.replace(raw_text(page, d), F.lit(NBSP), F.lit(" ")))

    def body(b: Column) -> Column:
        code = F.coalesce(_lines(page, _with_class(page["els"], b["code"], "line"), clean), clean(b["code"]))
        language = F.coalesce(F.nullif(F.element_at(e["attrs"], "data-language"), F.lit("")), prefixed(e["cls"], "language-"), F.lit("text"))
        return _result(language, newline_normalised(code))

    return let(body, code=_first(page["els"], e, "code"))


def _is_bare_pre(page: Page, e: Column) -> Column:
    return (e["tag"] == "pre") & _first(page["els"], e, "code").isNull()


def _markup_text(page: Page, e: Column) -> Column:
    """Tags stripped, then entities decoded: the tokenizer has done both."""
    return newline_normalised(F.replace(raw_text(page, e), F.lit(NBSP), F.lit(" ")))


def _bare_pre(page: Page, e: Column) -> Column:
    return _result(language_of_pre(e), _markup_text(page, e))


def _is_pre_code(page: Page, e: Column) -> Column:
    return (e["tag"] == "pre") & _first(page["els"], e, "code").isNotNull()


def _pre_code(page: Page, e: Column) -> Column:
    return let(
        lambda b: let(
            lambda c: _result(language_of_code(c["code"], e, c["text"]), c["text"]),
            code=b["code"],
            text=_markup_text(page, b["code"]),
        ),
        code=_first(page["els"], e, "code"),
    )


# The most specific rule first; an element takes the first rule that matches it.
RULES = [
    Rule("expressive", _is_expressive, _expressive),
    Rule("container", _is_container, _container),
    Rule("astro", _is_astro, _astro),
    Rule("pre", _is_bare_pre, _bare_pre),
    Rule("pre_code", _is_pre_code, _pre_code),
]


def code_blocks(page: Page, rules: list[Rule] | None = None) -> Column:
    """Outermost live code blocks in order: (id, open, close, rule, language, code)."""
    rules = rules or RULES

    def rule_of(e: Column) -> Column:
        out = F.when(rules[0].match(page, e), F.lit(0))
        for number, rule in enumerate(rules[1:], start=1):
            out = out.when(rule.match(page, e), F.lit(number))
        return out

    hits = F.transform(
        F.filter(page["els"], lambda e: e["tag"].isin("div", "pre") & ~pick(page["removed"], e["id"])),
        lambda e: F.struct(e["id"].alias("id"), rule_of(e).alias("rule")),
    )
    hits = F.filter(hits, lambda h: h["rule"].isNotNull())

    def rendered(h: Column) -> Column:
        def fields(x: Column) -> Column:
            e = x["e"]
            result = F.when(h["rule"] == 0, rules[0].render(page, e))
            for number, rule in enumerate(rules[1:], start=1):
                result = result.when(h["rule"] == number, rule.render(page, e))
            return let(
                lambda r: F.struct(
                    e["id"].alias("id"),
                    e["open"].alias("open"),
                    e["close"].alias("close"),
                    pick(F.array(*[F.lit(rule.name) for rule in rules]), h["rule"]).alias("rule"),
                    r["r"]["language"].alias("language"),
                    r["r"]["code"].alias("code"),
                ),
                r=result,
            )

        return let(fields, e=pick(page["els"], h["id"]))

    def outermost(b: Column) -> Column:
        placed = F.transform(b["hits"], lambda h: F.struct(h["id"].alias("id"), h["rule"].alias("rule"), pick(page["els"], h["id"])["last"].alias("last")))
        blocks = F.transform(topmost(placed), rendered)
        return F.filter(blocks, lambda c: trim_ws(c["code"]) != "")

    return let(outermost, hits=hits)


@built_once
def code_blocks_expression() -> Column:
    return code_blocks(page_columns())


def code_block_table(tokens: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per code block of each page."""
    blocks = code_blocks(page_columns(), rules) if rules else code_blocks_expression()
    rows = explode_array(flagged(tokens), blocks, "b", "page_id")
    return rows.select("page_id", "seq", "b.rule", "b.language", "b.code")
