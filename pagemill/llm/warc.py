"""WARC archives of captures, and their index merged from locally sorted runs."""

from __future__ import annotations

import gzip
import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, written
from pagemill.session import shared_dir

END = "\r\n"
RECORD = "urn:pagemill:page:"


@dataclass(frozen=True)
class Archiving:
    """``least_bytes``: shorter payloads are stored every time. ``file_records``: records a file. ``range_entries``:
    index entries a range of the merged index holds, about. ``splitters``: bound on what is sampled to cut ranges.
    """

    least_bytes: int = 100
    file_records: int = 1000
    range_entries: int = 20_000
    splitters: int = 10_000


def url_key(url: str | None) -> str:
    """Sort-friendly form of an address: host labels reversed, then path and query in lower case; no scheme, port 80/443 or fragment."""
    try:
        parts = urlsplit((url or "").strip())
        port = parts.port
    except ValueError:
        return (url or "").lower()
    host = ",".join(reversed((parts.hostname or "").removeprefix("www.").split(".")))
    place = f":{port}" if port not in (None, 80, 443) else ""
    return f"{host}{place}){(parts.path or '/').lower()}{'?' + parts.query.lower() if parts.query else ''}"


def write_archives(pages: DataFrame, p: Archiving = Archiving()) -> str:
    """Write a WARC 1.1 record for each row of ``pages`` (page_id, url, html, captured) and return the folder.

    The payload is the html in UTF-8, a null one empty. Of equal payloads of ``least_bytes`` or more the smallest
    page_id gives the response, the others are revisits that refer to it; shorter ones are all responses.
    Digests are grouped with partial aggregation and only thin rows (page_id, digest) meet in the skewed join;
    html moves once, by page_id. Files are whole gzip streams in the shared folder, written by Spark's own sink.
    """
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.col("captured").cast("timestamp").alias("captured"),
    )
    thin = pages.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").alias("n"))
    thin = thin.where((F.col("n") >= p.least_bytes) & F.col("page_id").isNotNull())
    groups = thin.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    revisits = thin.join(groups, "digest").where("page_id > first").groupBy("page_id", "digest").agg(F.min("first").alias("first"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    marked = pages.withColumn("digest", digest).join(revisits, ["page_id", "digest"], "left")
    again = F.col("first").isNotNull()
    line = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts), F.lit(END))
    maybe = lambda test, *parts: F.when(test, line(*parts)).otherwise(F.lit(""))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    # Line ends inside an address would end the header.
    address = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(
        line("HTTP/1.1 200 OK"),
        line("Content-Type: text/html; charset=utf-8"),
        line("Content-Length: ", F.octet_length("html").cast("string")),
        F.lit(END),
    )
    size = F.octet_length(http) + F.when(again, 0).otherwise(F.octet_length("html"))
    head = F.concat(
        line("WARC/1.1"),
        line("WARC-Type: ", F.when(again, "revisit").otherwise("response")),
        line(f"WARC-Record-ID: <{RECORD}", name, ">"),
        line("WARC-Date: ", F.date_format(F.coalesce("captured", F.lit("1970-01-01").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        maybe(F.col("url").isNotNull(), "WARC-Target-URI: ", F.coalesce(address, F.lit(""))),
        line("WARC-Payload-Digest: sha256:", F.col("digest")),
        maybe(again, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        maybe(again, f"WARC-Refers-To: <{RECORD}", F.coalesce(F.col("first").cast("string"), F.lit("")), ">"),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", size.cast("string")),
        F.lit(END),
    )
    path = shared_dir(pages.sparkSession, "warc")
    record = F.concat(head, http, F.when(again, F.lit("")).otherwise(F.col("html")))
    (
        marked.select(record.alias("value"))
        .write.option("lineSep", END + END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", p.file_records)
        .text(path)
    )
    return path


def _headers(block: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in block.split(b"\r\n") if b":" in line)
    return {k.strip().lower().decode("ascii", "replace"): v.strip().decode("utf-8", "replace") for k, v in pairs}


def records(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes, int]]:
    """(WARC headers, HTTP headers, payload, offset) of the records of an archive; lengths, not separators, tell where they end."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = _headers(data[at:end])
        stop = end + 4 + int(head["content-length"])
        border = data.index(b"\r\n\r\n", end + 4)
        yield head, _headers(data[end + 4 : border]), data[border + 4 : stop], at
        at = stop + 4


ENTRY = "url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long"
FIELDS = [f.split()[0] for f in ENTRY.split(", ")]


def _order(entry: dict) -> tuple:
    return entry["url_key"], entry["captured"], -1 if entry["page_id"] is None else entry["page_id"]


def _number(text: str | None) -> int | None:
    digits = (text or "").strip("<>").removeprefix(RECORD)
    return int(digits) if digits else None


def read_archives(spark, path: str) -> DataFrame:
    """Index entries of all records, one sorted run for each archive file: (run, place, and the fields of ENTRY).

    A response's digest and length are those of the payload as read; a revisit has none and repeats its headers'.
    """

    def make():
        def one(batch: pa.RecordBatch):
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                found = []
                for head, http, payload, offset in records(gzip.decompress(content.as_py())):
                    again = head["warc-type"] == "revisit"
                    digest = head["warc-payload-digest"].removeprefix("sha256:") if again else hashlib.sha256(payload).hexdigest()
                    url = head.get("warc-target-uri")
                    found.append(
                        dict(
                            url_key=url_key(url), captured=head["warc-date"], page_id=_number(head["warc-record-id"]), url=url,
                            record_type=head["warc-type"], refers_to=_number(head.get("warc-refers-to")),
                            payload_bytes=int(http["content-length"]) if again else len(payload), payload_digest=digest, offset=offset,
                        )
                    )
                found.sort(key=_order)
                if found:
                    columns = [pa.array([name] * len(found)), pa.array(range(len(found)), pa.int64())]
                    columns += [pa.array([f[c] for f in found], pa.int64() if c in LONGS else pa.string()) for c in FIELDS]
                    yield pa.RecordBatch.from_arrays(columns, names=["run", "place", *FIELDS])

        return one

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return map_batches(files, f"run string, place long, {ENTRY}", make)


LONGS = {f.split()[0] for f in ENTRY.split(", ") if f.endswith(" long")}


class LoserTree:
    """K-way merge: each inner node keeps the loser of its match, so the next smallest takes one match a level."""

    def __init__(self, runs: list[Iterator], key) -> None:
        self.runs, self.key, k = runs, key, len(runs)
        self.heads = [self._next(i) for i in range(k)]
        self.losers = [-1] * k
        self.winner = -1
        for i in range(k):
            self._play(i)

    def _next(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, i: int) -> None:
        """Bring run i up from its leaf. While the tree is built, the first to reach a node waits there."""
        node = (i + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and (head := self.heads[self.winner]) is not None:
            yield head[2]
            self.heads[self.winner] = self._next(self.winner)
            self._play(self.winner)


def merge(runs: Iterable[Iterable], key) -> Iterator:
    """Items of sorted ``runs`` in one order."""
    return iter(LoserTree([iter(r) for r in runs], key))


def merged_index(runs: DataFrame, p: Archiving = Archiving()) -> DataFrame:
    """The runs of ``read_archives`` as one index in the order of url_key, capture time and page_id.

    Adds range_no and place in it; (range_no, place) orders all entries, so an address's history lies together.
    Every so many entries of each run are sampled as splitters, a bounded number, and cut all runs into ranges;
    the captures of one address may be cut too, so no range depends on how often an address occurs. A range's
    pieces of runs travel as blocks and are merged by a loser tree in one task.
    """
    spark = runs.sparkSession
    total = runs.count()
    ranges = max(1, -(-total // p.range_entries))
    step = max(1, total // p.splitters)
    cuts: list[tuple] = []
    if ranges > 1:
        sampled = runs.where(F.pmod(F.col("place") + F.xxhash64("run"), F.lit(step)) == 0).select("url_key", "captured", "page_id").collect()
        keys = sorted(_order(r.asDict()) for r in sampled)
        cuts = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []
    sent = spark.sparkContext.broadcast(cuts)
    block = ", ".join(f"{f.split()[0]}:{f.split()[1]}" for f in ENTRY.split(", "))

    def make():
        kind = pa.list_(pa.struct([(c, pa.int64() if c in LONGS else pa.string()) for c in FIELDS]))

        def one(batch: pa.RecordBatch):
            rows = batch.to_pylist()
            parts: dict[tuple, list] = {}
            for row in rows:
                parts.setdefault((bisect_right(sent.value, _order(row)), row["run"]), []).append(row)
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in parts], pa.int32()),
                        pa.array([k[1] for k in parts]),
                        pa.array([v[0]["place"] for v in parts.values()], pa.int64()),
                        pa.array([[{c: r[c] for c in FIELDS} for r in v] for v in parts.values()], kind),
                    ],
                    names=["range_no", "run", "first", "entries"],
                )

        return one

    def merge_range(table: pa.Table) -> pa.Table:
        blocks: dict[str, list] = {}
        for row in table.sort_by([("run", "ascending"), ("first", "ascending")]).to_pylist():
            blocks.setdefault(row["run"], []).extend(row["entries"])
        # A run that reached this task in several batches is still one sorted run.
        found = list(merge(blocks.values(), _order))
        columns = [pa.array([c[x] for c in found], pa.int64() if x in LONGS else pa.string()) for x in FIELDS]
        number = table.column("range_no")[0].as_py()
        return pa.Table.from_arrays(
            [pa.array([number] * len(found), pa.int32()), pa.array(range(len(found)), pa.int64()), *columns], names=["range_no", "place", *FIELDS]
        )

    blocks = map_batches(runs.select("run", "place", *FIELDS), f"range_no int, run string, first long, entries array<struct<{block}>>", make)
    return blocks.groupBy("range_no").applyInArrow(merge_range, f"range_no int, place long, {ENTRY}")


def archive(pages: DataFrame, params: Archiving = Archiving()) -> DataFrame:
    """Write ``pages`` (page_id, url, html, captured) to archives, read these and return their merged index.

    One row for each row of ``pages``: range_no, place and the fields of ENTRY; payload_bytes and payload_digest
    (hex SHA-256) are those of the full payload for revisits too. Nulls: html counts as empty, captured as 1970,
    a null url stays null and sorts first, a row without page_id is a response. An empty table gives no rows;
    other columns are not read. Tasks hold one archive file or one range.
    """
    path = write_archives(pages, params)
    return merged_index(written(read_archives(pages.sparkSession, path), "runs"), params)
