"""Toxicity: class-conditional Kneser-Ney models of words, compared by length-normalised log-likelihood."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, written
from pagemill.llm.quality import plain_words
from pagemill.llm.shingles import WordHashes, mixed


@dataclass(frozen=True)
class KneserNey:
    """Parameters.

    About ``fit_rows`` labelled documents teach: two thirds give counts, one third calibrates. Words are
    hashed to 2**``word_bits`` columns, and at most ``pair_rows`` word pairs, the most frequent ones, have
    counts of their own, so the model's size is bounded. Other pairs, and those seen once, are left to the backoff. ``discounts`` are taken off counts of 1, 2 and 3 or more; a full
    discount of 1 keeps what only one context shows from speaking for a class. ``best``: how many of the
    most telling words are compared beside the whole text, so that a few words in a long text count.
    A document counts once for a pair, and a context is trusted as if ``doubt`` more occurrences had gone to
    the backoff, so that neither a repeated line nor a rare context speaks for a class.
    """

    fit_rows: int = 20_000
    word_bits: int = 18
    pair_rows: int = 300_000
    discounts: tuple[float, float, float] = (1.0, 2.0, 3.0)
    best: int = 3
    doubt: float = 50.0


@dataclass(frozen=True)
class Model:
    params: KneserNey
    base: np.ndarray  # [2, words]: log of the lower-order probability, ordinary and toxic
    pairs: np.ndarray  # sorted hashes of the pairs that are kept
    kept: np.ndarray  # [2, pairs + 1]: their discounted counts; the last column, of zeros, is that of other pairs
    seen: np.ndarray  # [2, words]: occurrences as a context, with doubt
    rest: np.ndarray  # [2, words]: share of a context that is left to the lower order
    weights: np.ndarray  # logistic: constant, mean over the text, mean of the best words, log of the length


def _hashed(text: str | None, hashes: WordHashes, p: KneserNey) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the words and hashes of the pairs (word before, word) of a text."""
    words = plain_words((text or "").encode("utf-8", "surrogatepass"))
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        pairs = mixed(ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:])
    return (ids & np.uint64((1 << p.word_bits) - 1)).astype(np.int64), (pairs >> np.uint64(1)).astype(np.int64)


def _pair_counts(texts: DataFrame, p: KneserNey) -> DataFrame:
    """(before, word, pair, ordinary, toxic): counts of word pairs, summed in the tasks first."""

    def make():
        hashes = WordHashes()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes, flags = [], []
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                words, pairs = _hashed(text.as_py(), hashes, p)
                if len(pairs):
                    once = np.unique(pairs, return_index=True)[1]
                    codes.append(np.stack((words[once], words[once + 1], pairs[once]), 1))
                    flags.append(np.full(len(once), toxic))
            rows = np.concatenate(codes) if codes else np.empty((0, 3), np.int64)
            flag = np.concatenate(flags) if flags else np.empty(0, bool)
            unique, first, inverse = np.unique(rows[:, 2], return_index=True, return_inverse=True)
            toxic = np.bincount(inverse, flag, len(unique)).astype(np.int64)
            every = np.bincount(inverse, minlength=len(unique)).astype(np.int64)
            rows = rows[first]
            return pa.RecordBatch.from_arrays(
                [*(pa.array(rows[:, i]) for i in range(3)), pa.array(every - toxic), pa.array(toxic)], names=["before", "word", "pair", "ordinary", "toxic"]
            )

        return one

    counted = map_batches(texts.select("text", "toxic"), "before long, word long, pair long, ordinary long, toxic long", make)
    return counted.groupBy("before", "word", "pair").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _table(rows: DataFrame, key: str, size: int, **sums: Column) -> dict[str, np.ndarray]:
    """Sums by a hashed column, as arrays of ``size``."""
    found = rows.groupBy(key).agg(*(F.sum(c).cast("double").alias(n) for n, c in sums.items())).toArrow()
    out = {}
    for name in sums:
        out[name] = np.zeros(size)
        out[name][found.column(key).to_numpy()] = found.column(name).to_numpy()
    return out


def _discounted(count: Column, p: KneserNey) -> Column:
    one, two, more = p.discounts
    return F.greatest(count - F.when(count == 1, one).when(count == 2, two).otherwise(more), F.lit(0.0))


def _counts_model(pairs: DataFrame, p: KneserNey) -> Model | None:
    words = 1 << p.word_bits
    both = F.col("ordinary") + F.col("toxic")
    # A type is one distinct pair: it continues its word, in a class if the class has seen it.
    ending = _table(
        pairs, "word", words,
        ordinary=(F.col("ordinary") > 0).cast("long"), toxic=(F.col("toxic") > 0).cast("long"), shared=F.lit(1),
    )
    context = _table(pairs, "before", words, ordinary=F.col("ordinary"), toxic=F.col("toxic"))
    # The least count from which on pairs are kept, so that they are no more than the bound.
    sizes = pairs.where(both > 1).groupBy(F.least(both, F.lit(100_000)).alias("count")).agg(F.count("*").alias("n")).collect()
    held, least = 0, 100_001
    for row in sorted(sizes, key=lambda r: -r["count"]):
        held += row["n"]
        if held > p.pair_rows:
            break
        least = row["count"]
    own = pairs.where(both >= least).select("pair", "before", _discounted(F.col("ordinary"), p).alias("o"), _discounted(F.col("toxic"), p).alias("t"))
    found = own.orderBy("pair").toArrow()
    kept = [found.column(c).to_numpy() for c in ("o", "t")]
    if not ending["toxic"].sum() or not ending["ordinary"].sum():
        return None
    shared = (ending["shared"] + 1) / (ending["shared"].sum() + words)
    base, seen, rest = [], [], []
    one, two, more = p.discounts
    for name, direct in zip(("ordinary", "toxic"), kept):
        n = ending[name]
        cut = np.maximum(n - np.select([n == 1, n == 2], [one, two], more), 0)
        base.append((cut + (n.sum() - cut.sum()) * shared) / n.sum())
        total = context[name] + p.doubt
        seen.append(total)
        rest.append(1 - np.bincount(found.column("before").to_numpy(), direct, words) / total)
    as_float = lambda rows: np.array(rows, np.float32)
    direct = as_float([np.append(k, 0) for k in kept])
    return Model(p, as_float(base), found.column("pair").to_numpy(), direct, as_float(seen), as_float(rest), np.zeros(4))


def _features(text: str | None, model: Model, hashes: WordHashes) -> tuple[float, float, float]:
    """Mean log ratio over the text, that of its most telling words, log of the number of words; zeros for a text without words."""
    words, pairs = _hashed(text, hashes, model.params)
    if not len(words):
        return 0.0, 0.0, 0.0
    chance = model.base[:, words]
    if len(pairs):
        before = words[:-1]
        at = np.searchsorted(model.pairs, pairs)
        own = model.pairs[np.minimum(at, len(model.pairs) - 1)] == pairs if len(model.pairs) else np.zeros(len(pairs), bool)
        direct = model.kept[:, np.where(own, at, len(model.pairs))] / model.seen[:, before]
        chance = np.concatenate((chance[:, :1], direct + model.rest[:, before] * chance[:, 1:]), 1)
    ratio = np.log(np.maximum(chance[1], 1e-30)) - np.log(np.maximum(chance[0], 1e-30))
    k = model.params.best
    return float(ratio.mean()), float(np.sort(ratio)[::-1][:k].sum() / k), float(np.log1p(len(words)))


def _logistic(rows: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of a lightly regularised logistic regression, by Newton steps."""
    x = np.column_stack((np.ones(len(rows)), rows))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - chance) - 1e-2 * w
        curve = (x * (chance * (1 - chance))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return w


def fit(docs: DataFrame, labels: DataFrame, params: KneserNey = KneserNey()) -> Model | None:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); null labels teach nothing, of several the largest counts.

    The labels are a bounded sample by hash, small enough to be sent to every task. None if a class is missing.
    """
    p = params
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    total = known.count()
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(chance < min(1.0, p.fit_rows / max(total, 1)))
    fitted = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    fitted = written(fitted.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0), "labelled")
    model = _counts_model(written(_pair_counts(fitted.where("not calibrates"), p), "pairs"), p)
    if model is None:
        return None
    measured = _measured(fitted.where("calibrates"), model, ["toxic"]).toArrow()
    rows = np.column_stack([measured.column(c).to_numpy() for c in ("mean", "best", "size")])
    truth = measured.column("toxic").to_numpy().astype(float)
    if len(set(truth)) < 2:
        return None
    return Model(p, model.base, model.pairs, model.kept, model.seen, model.rest, _logistic(rows, truth))


def _measured(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    keyed = docs.select(*keys, F.col("text").cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        hashes = WordHashes()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([_features(t.as_py(), shared.value, hashes) for t in batch.column("__text")]).reshape(-1, 3)
            columns = [batch.column(i) for i in range(len(keys))] + [pa.array(found[:, i]) for i in range(3)]
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "mean", "best", "size"])

        return one

    return map_batches(keyed, f"{fields}, mean double, best double, size double", make)


def score(docs: DataFrame, model: Model | None, keys: list[str], threshold: float = 0.7) -> DataFrame:
    """``keys`` of ``docs`` and score (0 to 1), predicted (1 from ``threshold`` on): one row for each row.

    Whole texts are read. Null and wordless texts are scored by the constant and their length. Without
    a model every score is 0.
    """
    if model is None:
        return docs.select(*keys, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    constant, mean, best, size = (float(w) for w in model.weights)
    logit = F.lit(constant) + F.col("mean") * mean + F.col("best") * best + F.col("size") * size
    value = 1 / (1 + F.exp(-logit))
    return _measured(docs, model, keys).select(*keys, value.alias("score"), (value >= threshold).cast("int").alias("predicted"))
