"""Wrappers over planted templates, and over odd pages."""

import time

import pytest

from pagemill.llm.wrappers import Inference, Reading, main_runs, main_text, merged, page_expression, signature

SCHEMA = "page_id long, url string, html string, text string, host string, expression string"
PROSE = "Many words of running text stand in this paragraph, so that it counts as prose."


def own(html):
    page, runs = page_expression(html, Inference())
    Reading(page).rank()
    return " ".join(runs[n] for n in main_runs(page, None, Inference()))


def wrapper_of(pages):
    wrapper = None
    for html in pages:
        page = page_expression(html, Inference())[0]
        wrapper = page if wrapper is None else merged(wrapper, page, Inference())
    return signature(wrapper)


def blog(i, paragraphs, comments):
    body = "".join(f"<p>Text {i}.{k} &amp; <b>bold</b><br>{PROSE}</p>" for k in range(paragraphs))
    replies = "".join(f'<article class="comment"><p>Reply {i}.{k}. {PROSE} {PROSE}</p></article>' for k in range(comments))
    page = f"""<html><head><title>T{i}</title><style>p{{}}</style></head><body class="single comments-open">
        <header class="site-header"><h1>My site</h1><nav><ul><li><a href=/>Home</a><li><a href=/x>About</a></ul></nav></header>
        <div class="cookie-notice">We use cookies {i}</div>
        <div class="wrap with-sidebar"><article class="post post-{i}"><header><h1>Title {i}</h1></header>{body}
        <div class="share"><a href=#>Share</a></div><ul><li>one {i}<li>two <a href=q>linked</a></ul><aside>Beside {i}</aside>
        <div class="advert">Buy {i}</div><footer>Tags {i}</footer></article>
        <section id="comments"><h2>Comments</h2>{replies}</section></div>
        <div id="sidebar"><ul><li><a href=1>Related {i}</a></ul></div>
        <form><label>Name</label><input><textarea>no</textarea><button>Go</button></form>
        <footer>&copy; {i}</footer><script>var x = "<p>no</p>"</script></body></html>"""
    said = " ".join(f"Text {i}.{k} & bold {PROSE}" for k in range(paragraphs))
    return page, " ".join(f"Title {i} {said} one {i} two linked".split())


def plain(i, paragraphs):
    body = "".join(f"<p>Text {i}.{k} {PROSE}</p>" for k in range(paragraphs))
    page = f"""<div><a href=1>Home</a> | <a href=2>News</a></div><div><div><h1>Heading {i}</h1>{body}</div></div>
        <div>Copyright 2020 by a large company</div>"""
    return page, " ".join([f"Heading {i}", *[f"Text {i}.{k} {PROSE}" for k in range(paragraphs)]])


def test_planted_articles_come_out_whole(spark):
    rows, want = [], {}
    for i in range(12):
        for number, url, (html, text) in ((i, "https://blog.example.org/p", blog(i, i % 4 + 1, i % 3)), (100 + i, "http://Plain.example.org", plain(i, i % 3 + 2))):
            rows.append((number, f"{url}/{i}", html, "t", "h", "e"))
            want[number] = text
    got = main_text(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    for row in got.collect():
        assert row.text == want[row.page_id] and row.n_chars == len(row.text)


def test_order_and_partitions_do_not_matter(spark):
    rows = [(i, f"https://a.example.org/{i}", blog(i, i % 5, i % 4)[0], None, None, None) for i in range(20)]
    one, other = spark.createDataFrame(rows, SCHEMA).coalesce(1), spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)
    assert sorted(main_text(one).collect()) == sorted(main_text(other).collect())


def test_odd_rows(spark):
    page = blog(1, 2, 1)
    rows = [
        (1, None, page[0], None, None, None), (1, None, page[0], None, None, None), (2, "/relative", page[0], None, None, None),
        (3, "https://x.example.org", None, None, None, None), (4, "https://x.example.org", "", None, None, None), (None, "", "plain text", "", "", ""),
        (5, "https://x.example.org/long", f"<article><p>{'word ' * 200_000}</article>", None, None, None),
    ]
    got = sorted(((r.page_id or 0, r.text) for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == [(0, "plain text"), (1, page[1]), (1, page[1]), (2, page[1]), (3, ""), (4, ""), (5, ("word " * 200_000).strip())]
    assert main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_mismatches_become_optional_and_repeated_items():
    assert wrapper_of(["<h1>a</h1><p>b</p>", "<h1>a</h1><ul><li>x</ul><p>b<p>c"]) == "page(h1(#) ul(li(#))? p(#)+)"
    assert wrapper_of(["<h2>a</h2><p>b</p>", "<h2>a</h2><p>b</p><h2>c</h2><p>d</p><p>e"]) == "page((h2(#) p(#)+)+)"
    assert wrapper_of(["<ul><li>a</ul>", "<ul><li>a<li>b<li>c</ul><p>d"]) == "page(ul(li(#)+) p(#)?)"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a b"), ("<p>a &amp; b&nbsp;c<br>d</p>tail", "a & b c d tail"),
        ("<script>x", ""), ("a<script>x</script>b", "ab"), ("a<!-- no -->b", "ab"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ('<p class="a>text <b class="b">more</p>', "text more"), ("<nav>only a menu</nav>", ""), ("<p>a</p></div></p>b", "a b"),
        (f'<table><tr><td><a href=x>menu</a><td><h1>T</h1><p>{PROSE}</table>', f"T {PROSE}"),
        (f"<form><article><p>{PROSE}</article></form>", PROSE), (f"<ul>{'<li><a href=x>l</a>' * 5}</ul><p>{PROSE}", PROSE),
        (f"<div class=related><article>teaser</article></div><article><p>{PROSE}</article>", PROSE),
        (f'<article><div class="content has-sidebar no-comments"><p>{PROSE}</div><div class="banner">buy</div><div class="responses">x</div></article>', PROSE),
        (f'<div class="page-widget"><div class="widget text-widget"><p>{PROSE}</div></div><div class="widget">More</div>', PROSE),
        (f'<ARTICLE><H1>T</H1><P>{PROSE}<BR/>end<!-- no --></P><NOSCRIPT>js</NOSCRIPT></ARTICLE><DIV CLASS=Ad>buy</DIV>', f"T {PROSE} end"),
        (f'<main><h1>T</h1><article><p>{PROSE}</article><nav>m</nav></main>', f"T {PROSE}"),
        (f'<main><h2>News</h2><article><h1>T</h1><p>{PROSE}</article></main>', f"T {PROSE}"),
        (f'<main><p>{PROSE} <span class="ad">buy</span> end</main><footer>f', f"{PROSE} end"),
    ],
)
def test_single_pages(html, text):
    assert own(html) == text


@pytest.mark.parametrize("html", ["<div>" * 30_000 + "x", '<a "' * 30_000, "<a <" * 50_000, "<p>" * 50_000, "<ul><td>" * 5000 + "</ul>" * 5000, "<svg>" * 20_000 + "<b>"])
def test_reading_stays_linear(html):
    started = time.time()
    own(html)
    assert time.time() - started < 8
