"""Quality rules: fixed counts, and how far a text's histograms lie from those of its language."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Character classes: lower, upper and other letters, digits, white space, sentence marks, SYMBOLS, other marks.
CLASSES = 8
SENTENCE = ".,;:!?'\"()-"


@dataclass(frozen=True)
class Divergence:
    """Jensen-Shannon distances (base 2, 0 to 1) up to which a text is kept, and the lengths from which each counts.

    Common words of a language are those that make up at least 1 / ``common`` of its words.
    """

    chars: float = 0.28
    words: float = 0.52
    min_chars: int = 200
    min_words: int = 100
    common: int = 1000


@dataclass(frozen=True)
class References:
    """Histograms by language; the words' last column stands for all other words."""

    chars: np.ndarray
    vocabulary: dict[bytes, int]
    words: np.ndarray


def class_table() -> np.ndarray:
    """Character class by code point."""
    table = np.full(0x11_0000, 7, np.int8)
    for code in range(0x11_0000):
        char = chr(code)
        if char.isalpha():
            table[code] = 0 if char.islower() else 1 if char.isupper() else 2
        elif char.isdigit():
            table[code] = 3
        elif char.isspace():
            table[code] = 4
    for i, chars in ((5, SENTENCE), (6, SYMBOLS)):
        table[[ord(c) for c in chars]] = i
    return table


def char_histogram(text: str, table: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(table[codes], minlength=CLASSES)


#: ASCII marks become blanks, so that a word is the same with and without a comma behind it.
UNMARKED = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def plain_words(raw: bytes) -> list[bytes]:
    return raw.lower().translate(UNMARKED).split()


def distance(row: np.ndarray, references: np.ndarray) -> float:
    """Smallest Jensen-Shannon distance between a histogram and the rows of ``references``."""
    p = row / max(row.sum(), 1)
    middle = (p + references) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / middle), 0).sum(1)
        b = np.where(references > 0, references * np.log2(references / middle), 0).sum(1)
    return float(np.sqrt(np.maximum((a + b) / 2, 0).min()))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    windows, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)[1:]
    again = np.flatnonzero(counts[windows] > 1)
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[again + i] = True
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def references(docs: DataFrame, p: Divergence = Divergence()) -> References | None:
    """Histograms of every language over all documents (lang and text not null); None if there are none.

    Tasks sum their own characters and words first; only common words, at most ``p.common`` a language, are read back.
    """

    def make():
        table = class_table()
        chars: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def batch_of(kind: int, lang: str, keys: list[bytes], counts: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(keys), pa.int32()), pa.array([lang] * len(keys)), pa.array(keys, pa.binary()), pa.array(counts, pa.int64())],
                names=["kind", "lang", "key", "n"],
            )

        def flush(lang: str):
            found = words.pop(lang, Counter())
            yield batch_of(1, lang, list(found), list(found.values()))

        def one(batch: pa.RecordBatch):
            for lang, value in zip(batch.column("lang").to_pylist(), batch.column("text")):
                text = value.as_py()
                chars[lang] = chars.get(lang, 0) + char_histogram(text, table)
                words.setdefault(lang, Counter()).update(plain_words(text.encode("utf-8", "surrogatepass")))
                if len(words[lang]) > 300_000:
                    yield from flush(lang)

        def rest():
            for lang in list(words):
                yield from flush(lang)
            for lang, found in chars.items():
                yield batch_of(0, lang, [bytes([i]) for i in range(CLASSES)], found.tolist())

        one.rest = rest
        return one

    known = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = map_batches(known, "kind int, lang string, key binary, n long", make).groupBy("kind", "lang", "key").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("kind", "lang").agg(F.sum("n").alias("total"))
    rows = (
        counts.join(totals, ["kind", "lang"])
        .where((F.col("kind") == 0) | (F.col("n") * p.common >= F.col("total")))
        .select("kind", "lang", "key", "n", "total")
        .collect()
    )
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    vocabulary = {k: i for i, k in enumerate(sorted({bytes(r["key"]) for r in rows if r["kind"] == 1}))}
    chars, words = np.zeros((len(languages), CLASSES)), np.zeros((len(languages), len(vocabulary) + 1))
    for r in rows:
        at = languages.index(r["lang"])
        if r["kind"] == 0:
            chars[at, r["key"][0]] = r["n"] / max(r["total"], 1)
        else:
            words[at, vocabulary[bytes(r["key"])]] = r["n"] / r["total"]
    words[:, -1] = 1 - words.sum(1)
    return References(chars, vocabulary, words)


class _Known(dict):
    """Number of a common word, and one number for all others."""

    def __init__(self, words: dict[bytes, int]) -> None:
        super().__init__(words)
        self.other = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.other


def judge(docs: DataFrame, known: References | None, keys: list[str], p: Divergence = Divergence()) -> DataFrame:
    """``keys`` of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    char_distance, word_distance, kept: one row for each row, from the whole column ``text``.

    A distance is the smallest over all languages, and null where a guard of minimum length or the lack
    of references leaves the text unjudged; such a text passes. Null texts count as empty.
    """
    keyed = docs.select(*keys, F.col("text").cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields[:-1])
    added = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}
    added |= {"base_failed": "boolean", "char_distance": "double", "word_distance": "double", "kept": "boolean"}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def make():
        table = class_table()
        common = _Known(shared.value.vocabulary) if shared.value else None

        def measures(text: str) -> tuple:
            raw = text.encode("utf-8", "surrogatepass")
            words = raw.split()
            word_chars = len(text) - sum(map(text.count, SPACES))
            repeated = repeated_words(words)
            failed = len(words) < 50 or 100 * repeated > 50 * len(words)
            by_char = by_word = None
            if shared.value and word_chars >= p.min_chars:
                by_char = distance(char_histogram(text, table), shared.value.chars)
            if shared.value and len(words) >= p.min_words:
                plain = plain_words(raw)
                numbers = np.fromiter(map(common.__getitem__, plain), np.int64, len(plain))
                by_word = distance(np.bincount(numbers, minlength=common.other + 1), shared.value.words)
            kept = not failed and (by_char or 0) <= p.chars and (by_word or 0) <= p.words
            return (len(words), word_chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated, failed, by_char, by_word, kept)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [measures(t.as_py() or "") for t in batch.column("__text")]
            types = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
            columns = [pa.array([f[i] for f in found], types[kind]) for i, kind in enumerate(added.values())]
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *columns], names=[*keys, *added])

        return one

    return map_batches(keyed, f"{fields}, {', '.join(f'{k} {v}' for k, v in added.items())}", make)
