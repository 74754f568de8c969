"""Vectors as whole numbers, and exact sums of them by group."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches

#: Scaled components beyond this end the job: squared distances of longer ones would not fit a long.
LIMIT = 1 << 25
SLICE_ROWS = 8192


def is_complete(vector: str) -> Column:
    """Neither null nor holding a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def scaled(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component, taken in double precision."""

    def whole(x: Column) -> Column:
        product = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(product) <= LIMIT, F.floor(product)).otherwise(
            F.raise_error(F.lit(f"a vector component exceeds {LIMIT // scale} in size")).cast("long")
        )

    return F.transform(vector, whole)


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as rows of an int64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(start, SLICE_ROWS)


class GroupSums:
    """Sums and counts by group within one task, handed on when its batches end: one row per group."""

    def __init__(self, groups: int, width: int, add: Callable[[GroupSums, np.ndarray], None]) -> None:
        self.sums = np.zeros((groups, width + 1), np.int64)
        self._add = add

    def take(self, groups: np.ndarray, rows: np.ndarray) -> None:
        """Add each row to its group. Rows are sorted by group and summed in runs."""
        order = np.argsort(groups, kind="stable")
        present, starts, counts = np.unique(groups[order], return_index=True, return_counts=True)
        if len(present):
            self.sums[present, :-1] += np.add.reduceat(rows[order], starts, axis=0)
            self.sums[present, -1] += counts

    def __call__(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            self._add(self, matrix(part.column(0)))
        return iter(())

    def rest(self) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(self.sums[:, -1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(list(self.sums[used]), pa.list_(pa.int64()))], names=["group", "sums"]
        )


def group_means(vectors: DataFrame, groups: int, width: int, add: Callable[[GroupSums, np.ndarray], None]) -> dict[int, list[int]]:
    """Exact floor(sum / count) of every group that has rows.

    Each task sends one row per group; ``groups * width`` numbers, a parameter's worth, come to the driver.
    """
    partial = map_batches(vectors, "group long, sums array<long>", lambda: GroupSums(groups, width, add))
    parts = partial.select("group", F.posexplode("sums").alias("at", "value"))
    total = F.sum(F.col("value").cast("decimal(38,0)")).alias("total")
    found: dict[int, dict[int, int]] = {}
    for row in parts.groupBy("group", "at").agg(total).collect():
        found.setdefault(row["group"], {})[row["at"]] = int(row["total"])
    return {group: [sums[at] // sums[width] for at in range(width)] for group, sums in found.items()}


def digest(values: np.ndarray) -> str:
    """SHA-256 of the components as decimal numbers, joined by commas."""
    return hashlib.sha256(",".join(map(str, values.ravel().tolist())).encode()).hexdigest()
