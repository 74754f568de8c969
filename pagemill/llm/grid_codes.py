"""Vector code compression: parts of vectors as indexes into codebooks, found through memoised grid cells.

A part is cut into a coarse cell of a grid. For the cell's box every codebook entry has a least and a greatest
squared distance; an entry whose least distance exceeds the smallest greatest one is nearest to no point of the
box. The entries left are kept by the cell's hash, and only they are evaluated exactly for the parts that fall into
it. What is kept is a memo: emptying it when it is full costs time and changes no result.

Vectors that are null, or hold null or non-finite components, are left out, as are those of another length than the
first kept one whose length the parts divide (first by id, rows without an id last). Repeated rows count each;
among rows of one id the smallest vector comes first. With fewer than ``entries`` vectors the codebooks are shorter.
Null labels are one label. An empty table gives no rows. Other columns are not carried on, whatever their names. A
component of more than 2^25 after scaling ends the job with a message, as its distances would not fit a long.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, written
from pagemill.llm.whole_vectors import GroupSums, group_means, is_complete, matrix, scaled, slices


@dataclass(frozen=True)
class Coding:
    """``memo`` bounds the cells kept by a task, not the cells there may be."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    memo: int = 1 << 16


def distinct(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and for every row which it is. Rows become single numbers where their ranges allow it."""
    low = cells.min(axis=0)
    spans = [int(x) for x in cells.max(axis=0) - low + 1]
    if math.prod(spans) >= 1 << 62:
        found, of = np.unique(cells, axis=0, return_inverse=True)
        return found, of.ravel()
    number = np.ravel_multi_index(tuple((cells - low).T), spans)
    _, first, of = np.unique(number, return_index=True, return_inverse=True)
    return cells[first], of


class Cells:
    """The entries of one codebook that can be nearest within a cell, by the cell's coordinates."""

    def __init__(self, entries: np.ndarray, memo: int) -> None:
        self.entries = entries
        self.memo = memo
        self.known: dict[bytes, np.ndarray] = {}
        spread = float(entries.std(axis=0).mean()) if len(entries) else 0.0
        self.shift = int(np.log2(max(spread, 1.0)))  # a cell is half to one standard deviation wide

    def _undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        low = (cells << self.shift)[:, None, :]
        high = low + (1 << self.shift) - 1
        below, above = low - self.entries, self.entries - high
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
        greatest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
        kept = least <= greatest.min(axis=1)[:, None]
        return [np.flatnonzero(row) for row in kept]

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """The entries left for every cell; cells not met before are worked out together."""
        names = [row.tobytes() for row in cells]
        new = [at for at, name in enumerate(names) if name not in self.known]
        if len(self.known) + len(new) > self.memo:
            self.known = {}
            new = list(range(len(names)))
        for start in range(0, len(new), 1024):
            some = new[start : start + 1024]
            for at, kept in zip(some, self._undominated(cells[some]), strict=True):
                self.known[names[at]] = kept
        return [self.known[name] for name in names]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of every row, the lower one of equals, and its squared distance."""
        cells, of = distinct(rows >> self.shift)
        lists = self.candidates(cells)
        sizes = np.array([len(kept) for kept in lists], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.concatenate(lists)
        mine = sizes[of]
        first = np.concatenate([[0], np.cumsum(mine)[:-1]])
        entry = flat[np.arange(mine.sum()) - np.repeat(first - starts[of], mine)]
        gap = np.repeat(rows, mine, axis=0) - self.entries[entry]
        best = np.minimum.reduceat(np.einsum("nd,nd->n", gap, gap) * len(self.entries) + entry, first)
        return best % len(self.entries), best // len(self.entries)


class Coder:
    """All parts of a block of vectors against their codebooks [parts, entries, width]."""

    def __init__(self, codebooks: np.ndarray, memo: int) -> None:
        self.width = codebooks.shape[2]
        self.cells = [Cells(entries, memo) for entries in codebooks]

    def code(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes [rows, parts] and squared distances of the same shape."""
        found = [cells.nearest(rows[:, at * self.width : (at + 1) * self.width]) for at, cells in enumerate(self.cells)]
        return np.stack([index for index, _ in found], axis=1), np.stack([distance for _, distance in found], axis=1)


def whole_table(df: DataFrame, params: Coding, vec_id: str, vector: str, label: str) -> DataFrame:
    """The kept vectors as whole numbers: (vec_id, label, whole)."""
    given = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kept = given.where(is_complete("vector") & (F.size("vector") > 0) & (F.size("vector") % params.parts == 0))
    first = kept.select("vec_id", F.size("vector").alias("dims")).orderBy(F.col("vec_id").asc_nulls_last(), "dims").first()
    even = kept.where(F.size("vector") == (first["dims"] if first else 0))
    return even.select("vec_id", "label", scaled("vector", params.scale).alias("whole"))


def fit(vectors: DataFrame, params: Coding) -> np.ndarray:
    """Codebooks [parts, entries, width] after all rounds over a written table of whole vectors."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(params.entries).select("whole").collect()
    if not rows:
        return np.zeros((params.parts, 0, 1), np.int64)
    codebooks = np.array([row["whole"] for row in rows], np.int64).reshape(len(rows), params.parts, -1).transpose(1, 0, 2).copy()
    parts, entries, width = codebooks.shape
    for _ in range(params.rounds):
        means = group_means(vectors.select("whole"), parts * entries, width, _adder(codebooks, params.memo))
        for group, mean in means.items():
            codebooks[group // entries, group % entries] = mean
    return codebooks


def _adder(codebooks: np.ndarray, memo: int) -> Callable[[GroupSums, np.ndarray], None]:
    parts, entries, width = codebooks.shape
    held: list[Coder] = []  # one coder a task: made there, and kept from batch to batch

    def add(sums: GroupSums, rows: np.ndarray) -> None:
        if not held:
            held.append(Coder(codebooks, memo))
        index, _ = held[0].code(rows)
        sums.take((index + np.arange(parts) * entries).ravel(), rows.reshape(-1, width))

    return add


def encode(vectors: DataFrame, codebooks: np.ndarray, params: Coding) -> DataFrame:
    """Every vector with its indexes and the exact error: (vec_id, label, code, error)."""
    kinds = ", ".join(f"{name} {vectors.schema[name].dataType.simpleString()}" for name in ("vec_id", "label"))

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        coder = Coder(codebooks, params.memo)

        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch):
                index, distance = coder.code(matrix(part.column("whole")))
                codes = pa.array(list(index.astype(np.int32)), pa.list_(pa.int32()))
                columns = [part.column("vec_id"), part.column("label"), codes, pa.array(distance.sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

        return one

    return map_batches(vectors, f"{kinds}, code array<int>, error long", make)


def decode(coded: DataFrame, codebooks: np.ndarray, params: Coding = Coding()) -> DataFrame:
    """Codes back to vectors: ``approximate``, each component the middle of its whole number's step."""
    tables = [F.array(*[F.array(*[F.lit((int(x) + 0.5) / params.scale) for x in entry]) for entry in book]) for book in codebooks]
    parts = [F.element_at(table, F.element_at("code", at + 1) + 1) for at, table in enumerate(tables)]
    return coded.withColumn("approximate", F.concat(*parts))


def compress(
    df: DataFrame, params: Coding = Coding(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """Codes and errors of all vectors with the errors summed by label, and the codebooks.

    Label sums are combined before the shuffle and written, so that their size is known when they meet the rows: a
    small table is broadcast, a large one is joined by sorting, where adaptive execution splits a hot label.
    """
    vectors = written(whole_table(df, params, vec_id, vector, label), "whole-vectors")
    codebooks = fit(vectors, params)
    coded = written(encode(vectors, codebooks, params), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")
    sums = written(coded.groupBy(F.col("label").alias("__label")).agg(total), "label-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label"), codebooks


def code_text(code: str = "code") -> Column:
    """Indexes in part order, two hexadecimal digits each."""
    return F.array_join(F.transform(code, lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")

