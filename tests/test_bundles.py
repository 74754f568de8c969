"""Chunks of a bundle made page by page, against those of the bundle's whole text."""

import random

from pyspark.sql import functions as F

from pagemill.operators import bundles
from pagemill.operators.chunking import chunk_documents

RECORD = "title string, content string, url string, author string, description string, published_at timestamp, site_name string"


def page_text(rng):
    parts = []
    for _ in range(rng.randint(1, 9)):
        kind = rng.randrange(8)
        words = " ".join(rng.choice(["word", "Other.", "naïve", "😀", "end!", "## no", "a b"]) for _ in range(rng.randint(1, 300)))
        parts.append(
            ["## Part\n\n" + words, words, f"![fig](https://a.org/{rng.randrange(99)}.png)", "```py\n" + "x = 1\n" * rng.randint(1, 500) + "```",
             "- item\n- other", "* * *\n\n\n\n" + words, "---\n" + words + "\n---", "tail  \n\n\n\n" + words][kind]
        )
    return "\n\n".join(parts)


def joined_rows(spark, seed, messages=60):
    rng = random.Random(seed)
    rows = []
    for m in range(messages):
        for pos in range(rng.choice([1, 1, 2, 3, 12])):
            text = page_text(rng) if rng.random() < 0.8 else "short *text*"
            rows.append((m, pos * 2, 1 + pos, f"Title {m}-{pos}", text, f"https://a.org/{m}/{pos}", rng.choice([None, "", "Me"]), "", None, "a.org"))
        rows.append((m, 99, None, None, None, "https://a.org/none", None, None, None, None))
    df = spark.createDataFrame(rows, f"message_id int, pos int, page_id int, {RECORD}")
    return df.withColumn("archived_at", F.timestamp_millis(F.lit(1717243200500)))


def test_page_by_page_equals_whole(spark):
    joined = joined_rows(spark, 7)
    at = F.timestamp_millis(F.lit(1717243200500))
    want = chunk_documents(bundles.bundle_markdown(joined, at), "message_id", "body", delivery=True)
    got = bundles.bundle_chunks(joined, at)
    assert got.columns == want.columns
    left, right = ({(r.message_id, r.seq): tuple(r) for r in df.collect()} for df in (got, want))
    assert len(left) > 300 and left == right


def test_no_row_holds_the_texts_of_a_message(spark):
    plan = bundles.bundle_chunks(joined_rows(spark, 1, 2), F.timestamp_millis(F.lit(0)))._jdf.queryExecution().optimizedPlan().toString()
    collected = [part.split(")")[0] for part in plan.split("collect_list(")[1:]]
    assert collected and all("content" not in part and "units" not in part for part in collected)
