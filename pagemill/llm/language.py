"""Language identification: several TF-IDF centroids per language, nearest by cosine, rejection by distance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches


@dataclass(frozen=True)
class Centroids:
    """Parameters.

    Letter n-grams of the given ``orders`` are hashed to 2**``bits`` columns. ``per_language`` centroids
    are clustered from a bounded sample of about ``fit_rows`` documents a language, in ``rounds`` rounds.
    A document with ``judged`` letters or more is rejected when its distance from the nearest centroid is
    over the largest one of that language's sample times ``reach``.
    """

    orders: tuple[int, ...] = (2, 3)
    bits: int = 12
    per_language: int = 3
    fit_rows: int = 500
    rounds: int = 8
    judged: int = 40
    reach: float = 1.5


@dataclass(frozen=True)
class Model:
    """What prediction needs; its size depends on the parameters and the number of languages only."""

    params: Centroids
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray  # one unit vector a row
    owner: np.ndarray  # index of the language of each row
    radius: np.ndarray  # by language


class NGrams:
    """Counts of hashed letter n-grams. Runs of characters that are no letters count as one space."""

    def __init__(self, params: Centroids) -> None:
        self.params = params
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x11_0000)), bool, 0x11_0000)

    def __call__(self, text: str | None) -> tuple[np.ndarray, int]:
        """(counts, number of letters)."""
        columns = 1 << self.params.bits
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.letter[codes]
        n = int(letters.sum())
        if not n:
            return np.zeros(columns, np.float32), 0
        codes = np.where(letters, codes, 32)
        gaps = np.flatnonzero(letters | np.r_[True, letters[:-1]])  # a run of spaces shrinks to one
        codes = np.concatenate(([32], codes[gaps], [32])).astype(np.uint64)
        counts = np.zeros(columns, np.int64)
        for order in self.params.orders:
            if len(codes) < order:
                continue
            rolled = np.full(len(codes) - order + 1, order, np.uint64)
            for i in range(order):
                rolled = (rolled + codes[i : len(codes) - order + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                rolled ^= rolled >> np.uint64(29)
            counts += np.bincount((rolled >> np.uint64(20) & np.uint64(columns - 1)).astype(np.int64), minlength=columns)
        return counts.astype(np.float32), n


def _weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of a block of counts."""
    rows = np.log1p(counts) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def _document_frequencies(texts: DataFrame, params: Centroids) -> tuple[np.ndarray, int]:
    """Over all rows: documents that hold each column, and documents. A task gives one row a column."""

    def make():
        grams, total = NGrams(params), np.zeros((1 << params.bits) + 1, np.int64)

        def one(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            for text in batch.column("text"):
                counts, n = grams(text.as_py())
                total[:-1] += counts > 0
                total[-1] += n > 0
            return []

        def rest():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

        one.rest = rest
        return one

    found = map_batches(texts.select("text"), "slot int, n long", make).groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((1 << params.bits) + 1, np.int64)
    total[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return total[:-1], int(total[-1])


def _clustered(rows: np.ndarray, params: Centroids) -> np.ndarray:
    """Spherical k-means; the first centres are rows far from each other."""
    centres = rows.mean(0, keepdims=True)
    for _ in range(min(params.per_language, len(rows)) - 1):
        centres = np.vstack((centres, rows[np.argmin((rows @ centres.T).max(1))]))
    for _ in range(params.rounds):
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        nearest = (rows @ centres.T).argmax(1)
        centres = np.vstack([rows[nearest == i].mean(0) if (nearest == i).any() else centres[i] for i in range(len(centres))])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, params: Centroids = Centroids(), key: str = "doc_id") -> Model | None:
    """Learn from ``docs`` (text, lang); rows with a null in either or without a letter teach nothing.
    ``key`` only deals out the sample.

    Document frequencies come from all rows, centroids from the bounded sample, each language's in a task
    of its own. Repeated rows count as often as they occur. None if there is nothing to learn from.
    """
    known = docs.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(key).alias("dealt")
    )
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    frequencies, total = _document_frequencies(known, params)
    idf = (np.log((1 + total) / (1 + frequencies)) + 1).astype(np.float32)
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, params.fit_rows / n)))
    chance = F.shiftrightunsigned("dealt", 11) / F.lit(float(1 << 53))
    sample = known.where(chance < share[F.col("lang")])

    def vectors():
        grams = NGrams(params)

        def one(batch: pa.RecordBatch):
            counted = [grams(text.as_py()) for text in batch.column("text")]
            keep = [i for i, (_, n) in enumerate(counted) if n]
            if keep:
                rows = _weights(np.stack([counted[i][0] for i in keep]), idf)
                offsets = pa.array(np.arange(len(keep) + 1, dtype=np.int32) * rows.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("lang").take(pa.array(keep)),
                        pa.array([counted[i][1] for i in keep], pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(rows.ravel())),
                    ],
                    names=["lang", "letters", "vector"],
                )

        return one

    def cluster(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(group["vector"].to_numpy())
        centres = _clustered(rows, params)
        far = 1 - (rows @ centres.T).max(1)
        long = far[(group["letters"] >= params.judged).to_numpy()]
        radius = float(long.max()) if len(long) else 1.0
        return pd.DataFrame({"lang": key[0], "radius": radius, "centre": list(centres.astype(np.float32))})

    rows = (
        map_batches(sample.select("lang", "text"), "lang string, letters long, vector array<float>", vectors)
        .groupBy("lang")
        .applyInPandas(cluster, "lang string, radius double, centre array<float>")
        .collect()
    )
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["centre"]))
    languages = tuple(sorted({r["lang"] for r in rows}))
    owner = np.array([languages.index(r["lang"]) for r in rows])
    radius = np.array([max(r["radius"] for r in rows if r["lang"] == lang) for lang in languages])
    return Model(params, languages, idf, np.array([r["centre"] for r in rows], np.float32), owner, radius)


def predict(docs: DataFrame, model: Model | None, keys: list[str]) -> DataFrame:
    """``keys`` of ``docs`` and lang_pred, score (cosine to the nearest centroid), rejected: one row for each row.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text when there
    is no model. A short text is never rejected for its distance. Ties go to the language that sorts first.
    """
    # A text that is a key as well goes to the workers once.
    text = "text" if "text" in keys and docs.schema["text"].dataType.simpleString() == "string" else "__text"
    keyed = docs.select(*keys, *([F.col("text").cast("string").alias(text)] if text not in keys else []))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields[: len(keys)])

    def make():
        grams = NGrams(model.params) if model else None

        def one(batch: pa.RecordBatch):
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                names, scores, rejected = ["und"] * part.num_rows, np.zeros(part.num_rows), np.ones(part.num_rows, bool)
                counted = [grams(value.as_py()) for value in part.column(text)] if model else []
                some = np.array([i for i, (_, n) in enumerate(counted) if n], int)
                if len(some):
                    near = _weights(np.stack([counted[i][0] for i in some]), model.idf) @ model.centroids.T
                    best = near.argmax(1)
                    scores[some] = np.clip(near.max(1), 0, 1)
                    letters = np.array([counted[i][1] for i in some])
                    lang = model.owner[best]
                    rejected[some] = (letters >= model.params.judged) & (1 - near.max(1) > model.radius[lang] * model.params.reach)
                    for i, k in zip(some, lang):
                        names[i] = model.languages[k]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keys))), pa.array(names), pa.array(scores), pa.array(rejected)],
                    names=[*keys, "lang_pred", "score", "rejected"],
                )

        return one

    return map_batches(keyed, fields + ", lang_pred string, score double, rejected boolean", make)
