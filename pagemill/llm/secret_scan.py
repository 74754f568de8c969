"""Secrets in texts: fixed formats, and high sliding-window entropy inside candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, text_slices

KINDS = ("assign", "access", "hex", "entropy")
#: Base formats. Letters of the keywords count in either case, in ASCII only.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(
    "(?:" + "|".join(re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", word) for word in KEYWORDS) + ")"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")  # a run is matched whole, so the length can stand in the pattern
HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
#: Bytes of text that are scanned before their rows go out.
SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class Entropy:
    """Sliding-window entropy: candidate strings, windows and the bits a window needs, by character class.

    ``hex``: hexadecimal digits with a letter and a digit among them; ``mixed``: letters and digits;
    ``letters``: no digit. Strings of digits alone carry too little to tell. A candidate that an
    ``allowed`` pattern matches as a whole, or behind an ``allowed_before`` text, is left alone.
    """

    window: int = 20
    bits: dict = field(default_factory=lambda: {"hex": 3.0, "mixed": 3.9, "letters": 4.25})
    candidate: str = r"[A-Za-z0-9+/_=-]{20,}"
    allowed: tuple[str, ...] = (
        r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
        r"sha(1|256|384|512)-[A-Za-z0-9+/=]+",  # integrity marks
        r"(?i:.*(example|placeholder|changeme|xxxxxx|your[_-]?).*)",
        r"[a-z]+([-_/][a-z]+)+",  # slugs and paths
    )
    allowed_before: tuple[str, ...] = ("://", "/", "#", "commit ", "sha256:")


def char_class(string: str) -> str | None:
    """The entropy class of a candidate string."""
    digits = sum(c.isdigit() for c in string)
    if digits == len(string):
        return None
    if not digits:
        return "letters"
    return "hex" if HEX_DIGITS.issuperset(string) else "mixed"


def dense_ranges(string: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Ranges covered by windows of at least ``bits`` Shannon entropy; neighbours are joined.

    The entropy of w characters is log2(w) minus the mean of c * log2(c) over the counts c. One step
    of the window changes two counts, so a string takes time in proportion to its length.
    """
    weight = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for i, char in enumerate(string):
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += weight[c + 1] - weight[c]
        if i >= window:
            old = string[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += weight[c - 1] - weight[c]
        if i >= window - 1 and math.log2(window) - total / window >= bits - 1e-9:
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed formats, in that order; offsets count code points."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans.sort()
    return spans


def entropy_spans(text: str, p: Entropy, candidate: re.Pattern, allowed: list[re.Pattern], taken: list) -> list[tuple[int, int, int]]:
    """Dense ranges of the candidates that touch no base span."""
    spans = []
    if not any(len(word) >= p.window for word in text.split()):
        return spans
    at = 0  # base spans are sorted by start; those that end before the candidate are done with
    ends = 0
    for m in candidate.finditer(text):
        string, start = m[0], m.start()
        while at < len(taken) and taken[at][0] < m.end():
            ends = max(ends, taken[at][2])
            at += 1
        if ends > start:
            continue
        kind = char_class(string)
        if kind is None or any(a.fullmatch(string) for a in allowed) or text[max(0, start - 8) : start].endswith(p.allowed_before):
            continue
        spans += [(start + a, 3, start + b) for a, b in dense_ranges(string, p.window, p.bits[kind])]
    return spans


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each union of overlapping spans replaced by the kind of its first one."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scan_secrets(docs: DataFrame, keys: list[str], params: Entropy = Entropy(), redact: bool = False) -> DataFrame:
    """Secret spans of every text: ``keys`` of ``docs`` and n_assign, n_access, n_hex, n_entropy,
    base_sha256 (of the fixed formats' spans), spans; with ``redact`` also text_masked.

    Spans are kind:start:end by start, then kind, joined by commas; starts and ends count code points.
    A null text counts as empty and stays null when masked. Whole texts are scanned, in time in
    proportion to their length, and rows go out by ``SLICE_BYTES`` of text, so a task holds its batch once. One row
    for each row of ``docs``, in a narrow job without shuffle; columns that are not in ``keys`` are not read.
    """
    keyed = docs.select(*keys, F.col("text").cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields[:-1])
    schema = (
        fields + ", n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string" + ", text_masked string" * redact
    )

    def make():
        candidate = re.compile(params.candidate)
        allowed = [re.compile(a) for a in params.allowed]

        def scanned(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, hashes, spans, texts = [], [], [], []
            for value in batch.column("__text"):
                text = value.as_py()
                base = base_spans(text or "")
                every = sorted(base + entropy_spans(text or "", params, candidate, allowed, base))
                number = [0, 0, 0, 0]
                for _, kind, _ in every:
                    number[kind] += 1
                counts.append(number)
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                if redact:
                    texts.append(None if text is None else masked(text, every))
            columns = [batch.column(i) for i in range(len(keys))]
            columns += [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            columns += [pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
            columns += [pa.array(texts, pa.string())] if redact else []
            names = [*keys, "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"] + ["text_masked"] * redact
            return pa.RecordBatch.from_arrays(columns, names=names)

        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for a, b in text_slices(batch, "__text", SLICE_BYTES):
                yield scanned(batch.slice(a, b - a))

        return one

    return map_batches(keyed, schema, make)
