import random

from pyspark.sql import functions as F

from pagemill.functions.text import clean_for_display, line_class, split_sentences
from pagemill.operators import chunking


def chunks(spark, text, **options):
    df = spark.createDataFrame([(1, text, "https://example.com/docs/current/page.md")], "id int, text string, url string")
    rows = chunking.chunk_documents(df, "id", "text", **options).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(len(rows)))
    assert all(r.n_chunks == len(rows) for r in rows)
    return rows


def column(spark, values, build):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in df.select("i", build(F.col("t")).alias("x")).orderBy("i").collect()]


PROSE = "The quick brown fox jumps over the lazy dog near the river bank. "


def test_short_text_is_one_paragraph(spark):
    rows = chunks(spark, "# Title\n\nA short text.\n\n## More\n\nEnd.")
    assert [(r.type, r.content) for r in rows] == [("paragraph", "# Title\n\nA short text.\n\n## More\n\nEnd.")]


def test_images_stand_alone(spark):
    rows = chunks(spark, "# T\n\n![a](x.png)\n\ntext\n\n![b](y.png) tail")
    assert [r.type for r in rows] == ["paragraph", "image", "paragraph", "image", "paragraph"]
    assert rows[1].content == "![a](x.png)"


def test_single_code_block_keeps_type_and_language(spark):
    rows = chunks(spark, "```js\nlet a = 1;\n```")
    assert [(r.type, r.language) for r in rows] == [("code", "js")]


def test_merged_group_is_a_paragraph_without_language(spark):
    rows = chunks(spark, "Before.\n\n```js\nlet a = 1;\n```\n\nAfter.")
    assert [(r.type, r.language) for r in rows] == [("paragraph", None)]
    assert rows[0].content == "Before.\n\n```js\nlet a = 1;\n```\n\nAfter."


def test_large_code_is_split_on_lines(spark):
    code = "```ts\n" + "".join(f"const value_{i} = compute({i});\n" for i in range(100)) + "```"
    rows = chunks(spark, "Intro.\n\n" + code + "\n\nOutro.")
    assert [r.type for r in rows] == ["paragraph", "code", "code", "paragraph"]
    assert all(len(r.content) <= 1900 for r in rows)
    assert "\n".join(r.content for r in rows[1:3]) == code
    assert {r.language for r in rows[1:3]} == {"ts"}


def test_refence_closes_every_piece(spark):
    code = "```ts\n" + "".join(f"const value_{i} = compute({i});\n" for i in range(100)) + "```"
    rows = chunks(spark, code, refence=True)
    assert all(r.content.count("```") == 2 for r in rows)


def test_long_code_line_stays_whole_until_delivery(spark):
    text = "```\n" + "x" * 2500 + "\n```"
    assert max(len(r.content) for r in chunks(spark, text)) == 2500
    assert max(len(r.content) for r in chunks(spark, text, delivery=True)) <= 2000


def test_sentences_are_packed(spark):
    rows = chunks(spark, PROSE * 60)
    assert all(len(r.content) <= 2000 for r in rows)
    assert " ".join(r.content for r in rows) == (PROSE * 60).strip()


def test_unclosed_code_and_heading_break(spark):
    rows = column(spark, ["# H\n\ntext\n## I\nmore\n\n```py\nx"], chunking.split_blocks)[0]
    assert [(r.type, r.content, r.language) for r in rows] == [
        ("paragraph", "# H", None),
        ("paragraph", "text\n## I\nmore", None),
        ("code", "```py\nx", "py"),
    ]


def test_links_are_resolved(spark):
    text = "# D\n\n[o](./other-page.md) [p](../parent/file.md)\n\n![t](./images/test.png)"
    rows = chunks(spark, text, url_col="url")
    assert "https://example.com/docs/current/other-page.md" in rows[0].content
    assert "https://example.com/docs/parent/file.md" in rows[0].content
    assert rows[1].content == "![t](https://example.com/docs/current/images/test.png)"


def test_front_matter_at_start_or_anywhere(spark):
    text = "---\ntitle: x\n---\nbody\n\n---\n\nkept\n\n---\nend"
    assert column(spark, [text], clean_for_display)[0] == "body\n\n---\n\nkept\n\n---\nend"
    late = "body\n---\ngone\n---\nend"
    assert column(spark, [late], lambda c: clean_for_display(c, True))[0] == "body\nend"


def test_length_counts_utf16_units(spark):
    smile = chr(0x1F600)
    rows = chunks(spark, smile * 1500)
    assert [len(r.content) for r in rows] == [1000, 500]
    assert "".join(r.content for r in rows) == smile * 1500


def test_line_classes(spark):
    lines = ["# h", "#h", "---", "* * *", "- a", "12. b", "> q", "```x", "|a|b|", "plain", ""]
    kinds = ["heading", None, "rule", "rule", "bullet", "ordered", "quote", "fence", "table", None, None]
    assert column(spark, lines, line_class) == kinds


# Brute force, one character or item at a time.


def trim(text):
    return text.strip("\t\n\x0b\x0c\r \xa0")


def plain_split_chars(text, limit):
    out, rest = [], trim(text)
    while len(rest) > limit:
        cut = next((i for i in range(limit, limit * 7 // 10, -1) if rest[i] in " \n.!"), limit)
        out.append(trim(rest[:cut]))
        rest = trim(rest[cut:])
    return [p for p in [*out, rest] if p]


def plain_repack(units, limit):
    out, i = [], 0
    while i < len(units):
        kind, content = units[i]
        j = i + 1
        while kind != "image" and j < len(units) and units[j][0] != "image":
            joined = content + "\n\n" + units[j][1]
            if len(joined) > limit or joined.count("```") % 2:
                break
            content, j = joined, j + 1
        out.append((kind if j == i + 1 else "paragraph", trim(content) if j > i + 1 else content))
        i = j
    return out


def plain_pack_code(text, limit):
    out, current = [], ""
    for line in text.split("\n"):
        joined = current + ("\n" if current else "") + line
        if len(joined) > limit and current:
            out.append(current)
            current = line
        else:
            current = joined
    return out + ([current] if current else [])


def random_text(rng, size, alphabet="ab .!?\nC"):
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, size)))


def test_split_chars_against_brute_force(spark):
    rng = random.Random(1)
    texts = [random_text(rng, 400, alphabet) for alphabet in ["ab .!?\nC", "abcdefghijklmnop .", "ab"] for _ in range(80)]
    got = column(spark, texts, lambda c: chunking.split_chars(chunking.trim_ws(c), 50))
    assert got == [plain_split_chars(t, 50) for t in texts]


def test_pack_code_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["x" + random_text(rng, 300, "ab\n\n\n") for _ in range(150)]
    got = column(spark, texts, lambda c: F.transform(chunking.pack_code(c, F.lit("l"), 20), lambda p: p["content"]))
    assert got == [plain_pack_code(t, 20) for t in texts]


def test_repack_against_brute_force(spark):
    rng = random.Random(3)
    cases = [
        [(rng.choice(["paragraph", "code", "image"]), rng.choice(["a", "```", "bb", "```c```"]) * rng.randrange(1, 5)) for _ in range(rng.randrange(1, 12))]
        for _ in range(150)
    ]
    data = [(i, [(kind, content, None) for kind, content in case]) for i, case in enumerate(cases)]
    df = spark.createDataFrame(data, "i int, u array<struct<type:string,content:string,language:string>>")
    rows = df.select("i", chunking.repack(F.col("u"), 24).alias("x")).orderBy("i").collect()
    assert [[(c.type, c.content) for c in r.x] for r in rows] == [plain_repack(case, 24) for case in cases]


def test_sentence_split(spark):
    assert column(spark, ["One. Two! three? Four.Five  \nSix. Été"], split_sentences)[0] == ["One.", "Two! three?", "Four.Five  \nSix. Été"]


def test_cascade_prefers_rules_then_paragraphs(spark):
    rows = chunks(spark, "one\n\n---\n\ntwo", strategy="cascade")
    assert [r.content for r in rows][0::2] == ["one", "two"]
    rows = chunks(spark, "\n\n".join([PROSE * 20] * 3), strategy="cascade")
    assert len(rows) == 3


def test_quality_report(spark):
    df = spark.createDataFrame([("code", "```a"), ("paragraph", "b" * 1500), ("paragraph", "c")], "type string, content string")
    got = {r.type: r for r in chunking.chunk_quality(df).collect()}
    assert (got["code"].n_odd_fences, got["paragraph"].n_over_half, got["paragraph"].max_len) == (1, 1, 1500)


def test_chunking_is_narrow(spark):
    df = spark.range(10).select("id", F.lit(PROSE * 50).alias("text"))
    plan = chunking.chunk_documents(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Generate") == 1


def test_long_rule_line(spark):
    text = "before\n" + "- " * 50_000 + "-\nafter"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    line = df.select(line_class(F.split("text", "\n")[1]).alias("kind")).first()["kind"]
    assert line == "rule"
    assert df.select(F.size(F.split("text", chunking.RULE_LINE, -1)).alias("n")).first()["n"] == 2
