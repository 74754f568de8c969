import pytest
from pyspark.sql import functions as F

from pagemill.functions.codelang import language_of_content
from pagemill.functions.text import clean_markdown
from pagemill.operators import codeblocks, pages, render
from pagemill.sources.html import _tokenize, page_tokens


def tokens(spark, *htmls, url="https://www.example.com/a/b"):
    df = spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id int, url string, html string")
    return page_tokens(df)


def markdown(spark, *htmls):
    rows = render.page_markdown(tokens(spark, *htmls)).orderBy("page_id").collect()
    return [r.markdown for r in rows]


def test_tree_repair(spark):
    html = '<title>T</title><p>one<b>two<p>three</b> four<ul><li>a<li>b</ul><script>x="</p>"</script>'
    nodes = pages.page_nodes(tokens(spark, html)).orderBy("id").collect()
    by_id = {n.id: n for n in nodes}
    shape = [(n.tag, by_id[n.parent].tag if n.parent >= 0 else None) for n in nodes]
    assert shape == [
        ("html", None), ("head", "html"), ("title", "head"), ("body", "html"), ("p", "body"), ("b", "p"), ("p", "body"),
        ("b", "p"), ("ul", "body"), ("li", "ul"), ("li", "ul"), ("script", "body"),
    ]
    assert all(n.open < n.close for n in nodes)


def test_region_choice(spark):
    filler = "word " * 60
    htmls = [
        f"<body><main>{filler}</main><div class=content>{filler}</div></body>",
        f"<body><article>{'x' * 30}</article><div class=post>{filler * 3}</div></body>",
        f"<body><div class=content>a</div><p>{filler * 5}</p></body>",
        "<body><p>plain</p></body>",
        "",
        f"<body><nav><article>{filler}</article></nav><div id=content>{filler}</div></body>",
    ]
    got = [r.selector for r in pages.main_regions(tokens(spark, *htmls)).orderBy("page_id").collect()]
    assert got == ["main", ".post", ".content", "body", "body", "#content"]


def test_region_ties_go_to_the_first_element(spark):
    text = "word " * 40
    row = pages.main_regions(tokens(spark, f"<body><article>{text}</article><article>{text}</article></body>")).first()
    assert (row.selector, row.id) == ("article", 2)


def test_metadata_lists(spark):
    htmls = [
        '<head><title> A </title><meta property="article:author" content="Ann"><meta name=date content="March 3, 2024"><meta name=description content=" d "></head>',
        '<body><header><h1>no</h1></header><h1>Head</h1><span class=byline>By B</span><time datetime="2024-01-02T03:04:05Z">x</time></body>',
        '<head><meta name=author content=""><meta name=date content="never"><meta property="og:article:published_time" content="2024-05-06"></head>',
    ]
    rows = pages.page_metadata(tokens(spark, *htmls)).orderBy("page_id").collect()
    assert [(r.title, r.author, str(r.published_at), r.description, r.site_name) for r in rows] == [
        ("A", "Ann", "2024-03-03 00:00:00", "d", "example.com"),
        ("Head", "By B", "2024-01-02 03:04:05", None, "example.com"),
        ("Untitled", None, "2024-05-06 00:00:00", None, "example.com"),
    ]


CODE = """<article>
<div class="expressive-code"><pre data-language="ts"><div class="ec-line"><div class="code">a &lt; b</div></div><div class="ec-line"></div><div class="ec-line"><span class="code">c</span></div></pre></div>
<div class="codeBlockContainer_ZGJx language-go"><pre class="prism-code"><code><span class="token-line">x</span><span class="token-line">y</span></code></pre></div>
<pre class="astro-code" data-language="md"><code><span class="line"><span style="c">p</span> q</span><span class="line">r</span></code></pre>
<pre class="Python">def f():</pre>
<pre><code class="hljs-rust">fn</code></pre><pre class="language-css"><code>a{}</code></pre><pre><code>SELECT a FROM b</code></pre>
<p>use <code>x*y</code></p></article>"""


def test_code_rules(spark):
    rows = codeblocks.code_block_table(tokens(spark, CODE)).orderBy("seq").collect()
    assert [(r.rule, r.language, r.code) for r in rows] == [
        ("expressive", "ts", "a < b\n\nc"),
        ("container", "go", "x\ny"),
        ("astro", "md", "p q\nr"),
        ("pre", "python", "def f():"),
        ("pre_code", "rust", "fn"),
        ("pre_code", "css", "a{}"),
        ("pre_code", "sql", "SELECT a FROM b"),
    ]


def test_markdown_of_inline_and_blocks(spark):
    html = (
        '<article><h1>A <em>b</em></h1><p>one <b>two </b>and <a href="/x" title="t">l</a>  x<br>y * z</p><ul><li>i<li><p>j</p></ul>'
        "<ol start=3><li>k<li>l</ol><blockquote><p>q<p>r</blockquote><hr><p>- no</p><img src=s.png alt=t><h2></h2><div class=comments>c</div></article>"
    )
    assert markdown(spark, html)[0] == (
        '# A *b*\n\none **two** and [l](/x "t") x\ny \\* z\n\n- i\n- j\n\n3. k\n4. l\n\n> q\n>\n> r\n\n* * *\n\n\\- no\n\n![t](s.png)'
    )


def test_empty_marks_go_at_any_depth(spark):
    nested = "<b><i>" * 40 + "</i></b>" * 40
    out = markdown(spark, f"<article><p>x {nested} y <b>z<i></i></b></p></article>")[0]
    assert out == "x y **z**"


def test_code_survives_clean_up(spark):
    out = markdown(spark, "<article><p>a</p><pre><code class='language-x'>$1  y\n\n\n\nz $&amp;</code></pre><p>b</p></article>")[0]
    assert "```x\n$1  y\n\n\n\nz $&\n```" in out


def test_records_drop_empty_pages(spark):
    rows = render.scrape_pages(tokens(spark, "<body><nav>n</nav></body>", "<title>t</title><article>x</article>")).collect()
    assert [(r.page_id, r.title, r.content) for r in rows] == [(1, "t", "x")]


def test_clean_markdown(spark):
    df = spark.createDataFrame([("a\n\n\n\nb\n##   h\n-   i\nx[l](u)   y  \n```\n  k   k\n```\nz",)], "t string")
    assert df.select(clean_markdown(F.col("t"))).first()[0] == "a\n\nb\n## h\n- i\nx [l](u) y\n\n```\n  k   k\n```\n\nz"


def test_language_order(spark):
    codes = ["import a from 'b'", "import java.util", "import (", "  #!/bin/sh", "select 1 from", "package main;", "none"]
    df = spark.createDataFrame(list(enumerate(codes)), "i int, c string")
    got = [r[1] for r in df.select("i", language_of_content(F.col("c"))).orderBy("i").collect()]
    assert got == ["javascript", "python", "go", "bash", "sql", "java", None]


def test_extraction_is_one_stage(spark):
    plan = render.scrape_pages(tokens(spark, "<p>x</p>"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize(
    "html",
    ["<div>" * 20_000 + "x", "<b><i>" + "<div>" * 20_000 + "x", "<main>" + "<pre><code>a = 1</code></pre>" * 5_000 + "</main>"],
)
def test_intervals_agree_with_parents(html):
    elements = _tokenize(html).elements
    last = list(range(len(elements)))
    for e in reversed(elements):
        if e["parent"] >= 0:
            last[e["parent"]] = max(last[e["parent"]], last[e["id"]])
    assert [e["last"] for e in elements] == last


def test_covered_marks_topmost_spans(spark):
    spans = "array(named_struct('id', 1, 'last', 3), named_struct('id', 2, 'last', 2), named_struct('id', 5, 'last', 5))"
    row = spark.range(1).select(pages.covered(F.lit(7), pages.topmost(F.expr(spans))).alias("c")).first()
    assert row["c"] == [False, True, True, True, False, True, False]
    none = spark.range(1).select(pages.covered(F.lit(2), pages.topmost(F.expr(f"slice({spans}, 1, 0)"))).alias("c")).first()
    assert none["c"] == [False, False]


def test_tokens_go_out_in_small_parts():
    # A task held the tokens of four million characters of HTML as Python objects.
    from types import SimpleNamespace

    import pyarrow as pa

    from pagemill.sources import html

    class Pages(SimpleNamespace):
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = html.page_tokens(Pages(columns=["page_id", "html"], schema=SimpleNamespace(fields=[])))
    texts = [f"<p>{i} é﷐</p>" + "<b>x</b>" * 2000 if i % 7 else None for i in range(100)]
    parts = list(run(iter([pa.RecordBatch.from_pydict({"page_id": list(range(100)), "html": texts})])))
    assert [i for p in parts for i in p["page_id"].to_pylist()] == list(range(100))
    assert max(sum(len(texts[i] or "") for i in p["page_id"].to_pylist()) for p in parts) <= (1 << 18) + 20_000
    kept = parts[0]["tokens"][1].as_py()
    assert "1 é�" in [t["text"] for t in kept]


def test_the_tokenizer_counts_no_lines_and_replaces_noncharacters():
    done = _tokenize("<p>﷐a\n﷯b\n<button><p>c</button>\n<td>d")
    assert done.getpos() == (1, 0)
    assert "".join(t[2] or "" for t in done.tokens) == "�a\n�b\nc\nd"
