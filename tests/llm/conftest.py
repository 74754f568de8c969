import pytest

from pagemill.llm.common import read

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sketch string, kept string, rep long, token_ids string, value long"


@pytest.fixture(scope="session")
def documents(spark):
    return read(spark, SMALL, "documents")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, shared ids, and columns with clashing names."""
    long = " ".join(f"word{i % 997} and more" for i in range(60_000))
    texts = [
        (1, "one two three four five six"), (2, "One two THREE four five six"), (2, "One two THREE four five six"), (3, None), (4, ""),
        (5, " \t\n"), (6, "x" * 200_000), (7, long), (8, long + " end"), (None, "one two three four five six"), (9, "naïve café 日本語 😀 end"),
        (10, "solo"), (11, "SOLO"), (12, " "), (13, "1" * 50_000), (14, "a@" * 20_000), (15, "token=" + "Ab3" * 5000),
    ]
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "s", None, "x", "y", 1, "z", 2) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
