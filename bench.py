"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from pagemill.plans import catalog  # noqa: E402
from pagemill.session import build_session  # noqa: E402
from pagemill.sources.tables import READ_PARTITIONS  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
HEADLINE = [
    "chunk_documents",
    "chunk_markdown",
    "scrape_pages",
    "page_chunks",
    "extract_links",
    "scrape_summary",
    "archive_outbox",
    "reaction_counts",
    "route_reactions",
    "pin_retention",
    "guild_upsert",
    "channel_get_or_create",
    "stream_route",
]


#: Queries over texts, timed once more without dealing rows anew, which is the plan by default.
DEFAULT_PLAN = ["chunk_documents", "scrape_pages", "page_chunks"]


def run(spark: SparkSession, name: str) -> float:
    """Seconds to plan the query and to produce all of its rows and columns."""
    started = time.time()
    df: DataFrame = catalog.QUERIES[name](spark, SF_DIR)
    df.write.format("noop").mode("overwrite").save()
    return time.time() - started


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set(READ_PARTITIONS, CPUS)  # each test table is one row group
    run(spark, "guild_upsert")  # start-up cost of the session
    seconds = {name: round(sorted(run(spark, name) for _ in range(RUNS))[RUNS // 2], 3) for name in HEADLINE}
    spark.conf.unset(READ_PARTITIONS)
    default_plan = {name: round(run(spark, name), 3) for name in DEFAULT_PLAN}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "default_plan": default_plan,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
