"""Small helpers of the operators in this folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import pagemill
from pagemill.session import shared_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most so many rows for the Python workers of the jobs inside; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per session, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_pagemill_sent", None) != context.applicationId:
        package = Path(pagemill.__file__).parent
        file = Path(tempfile.mkdtemp(prefix="pagemill-"), "pagemill.zip")
        with zipfile.ZipFile(file, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(file))
        context._pagemill_sent = context.applicationId


def release() -> None:
    """Give freed memory back to the system: a worker goes on to tasks of other stages, which need other tables."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there with the GNU library only
    if trim:
        trim(0)


def map_batches(
    df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch]]
) -> DataFrame:
    """``mapInArrow`` with state per task: ``make`` is called once a task, its result once a batch.

    A result that has a ``rest`` attribute is asked for what it still holds when the batches end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            out = one(batch)
            yield from [out] if isinstance(out, pa.RecordBatch) else out
        if hasattr(one, "rest"):
            yield from one.rest()
        one = batch = out = None
        release()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def sample_bucket(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; 0 for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus)), F.lit(0)).cast("int")


def text_slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts (or lists) hold about ``limit`` bytes (or items), one row at least."""
    values = batch.column(column)
    length = pa.compute.list_value_length if pa.types.is_list(values.type) else pa.compute.binary_length
    start, held = 0, 0
    for i, size in enumerate(length(values).to_pylist()):
        held += size or 0
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield start, batch.num_rows
