"""Personal data in texts, in DataFrame operations only: fixed formats, and boosted trees over loose candidates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.core import let
from pagemill.llm.common import written

#: Base formats in the order of the digest. Possessive runs and the look-behind leave the leftmost,
#: non-overlapping matches as they are and keep the search linear: inside a run of characters that may
#: start a match, only its first place (or the end of the match before) can start one.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators. They overlap each other and the base formats.
LOOSE = {
    "maybe_email": r"[^\x00-\x20@<>\"',;]{1,64}@[^\x00-\x20@<>\"',;]{1,255}",
    "maybe_ip": r"(?<![0-9A-Fa-f.:])[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{1,4}){3,7}",
    "maybe_number": r"[+(]?[0-9][0-9() ./-]{5,40}[0-9]",
}
KINDS = [*BASE, *LOOSE]
#: Words before a candidate that speak for personal data.
CUES = r"(?i)(mail|phone|tel|mobile|fax|call|card|visa|account|konto|iban|ssn|server|host|addr)[^\n]{0,12}$"
FEATURES = [
    "generator", "length", "digits", "letters", "dots", "dashes", "spaces", "plus", "brackets", "longest_run", "groups",
    "luhn", "octets", "domain", "glued_before", "glued_after", "cue",
]


@dataclass(frozen=True)
class Boosting:
    """``rounds`` trees of ``depth``. A candidate is selected from the lowest score on whose calibration candidates reach
    ``precision``, with ``least`` of them at least. All candidates take part: a quarter (by hash) calibrates, the
    others train.
    """

    rounds: int = 12
    depth: int = 4
    precision: float = 0.99
    least: int = 20


SPAN = "struct<kind:string,start:int,stop:int,value:string>"


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Matches as array<struct<kind, start, stop, value>>; offsets count code points, stop is exclusive.

    ``split`` gives what lies between the matches, so the offsets are running sums of lengths.
    """
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))

    def step(gaps: Column):
        def add(state: Column, value: Column) -> Column:
            start = state["at"] + F.length(F.get(gaps, state["i"]))
            stop = start + F.length(value)
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), value.alias("value"))
            return F.struct(stop.alias("at"), (state["i"] + 1).alias("i"), F.array_append(state["out"], span).alias("out"))

        return add

    return let(
        lambda b: F.aggregate(b["found"], zero, step(b["gaps"]), lambda s: s["out"]),
        found=F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        gaps=F.split(text, pattern, -1),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of one digit or more passes the Luhn check."""
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, size - i, F.lit(1)).cast("int")
        doubled = digit * 2
        return total + F.when(i % 2 == 0, digit).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add) % 10 == 0


def _octets(value: Column) -> Column:
    """Whether all parts between dots are numbers of at most 255."""
    small = lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (part.rlike("^[0-9]+$"))
    return F.forall(F.split(value, r"\."), lambda p: F.when(small(p), p.cast("int") <= 255).otherwise(F.lit(False)))


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": _octets,
    "card": lambda v: F.when(F.length(_digits(v)).between(13, 19), _luhn(_digits(v))).otherwise(F.lit(False)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
#: Cheap tests that a text without any match fails; most texts need no search.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "maybe_email": lambda t: F.contains(t, F.lit("@")),
    "maybe_ip": lambda t: t.rlike(r"[0-9A-Fa-f][.:][0-9A-Fa-f]{1,4}[.:]"),
    "maybe_number": lambda t: t.rlike(r"[0-9][0-9() ./-]{5}"),
}


def _scan(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, a row number, the base spans and the candidates with what surrounds them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keys, text.alias("__text"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    search = lambda k, p: F.when(HINTS[k](F.col("__text")), _found(F.col("__text"), k, p)).otherwise(none)
    passing = lambda k: lambda s: CHECKS[k](s["value"])
    base = F.concat(*(F.filter(search(k, p), passing(k)) for k, p in BASE.items()))
    loose = F.transform(
        F.concat(*(search(k, p) for k, p in LOOSE.items())),
        lambda s: s.withField("before", F.substring(F.col("__text"), F.greatest(s["start"] - 24, F.lit(0)) + 1, s["start"] - F.greatest(s["start"] - 24, F.lit(0)))).withField(
            "after", F.substring(F.col("__text"), s["stop"] + 1, F.lit(1))
        ),
    )
    return rows.select(*keys, F.monotonically_increasing_id().alias("__row"), base.alias("__base"), loose.alias("__loose"))


def _candidates(scanned: DataFrame) -> DataFrame:
    """A row for each candidate: __row, span, whether it is a base span, whether it overlaps one, features."""
    rows = scanned.where(F.size("__loose") > 0).select("__row", "__base", F.inline("__loose"))
    value, before = F.col("value"), F.col("before")
    touches = lambda b: (b["start"] < F.col("stop")) & (b["stop"] > F.col("start"))
    same = lambda b: touches(b) & (b["stop"] - b["start"] >= (F.col("stop") - F.col("start")) - 2)
    count = lambda chars: F.length(value) - F.length(F.regexp_replace(value, chars, ""))
    features = {
        "generator": F.array_position(F.array(*map(F.lit, LOOSE)), F.col("kind")),
        "length": F.length(value),
        "digits": count("[0-9]"),
        "letters": count(r"\p{L}"),
        "dots": count(r"\."),
        "dashes": count("-"),
        "spaces": count(" "),
        "plus": F.startswith(value, F.lit("+")),
        "brackets": count("[()]"),
        "longest_run": F.array_max(F.transform(F.split(value, "[^0-9]+"), F.length)),
        "groups": F.size(F.split(value, "[^0-9]+")),
        "luhn": F.when(count("[0-9]") > 0, _luhn(_digits(value))).otherwise(F.lit(False)),
        "octets": _octets(value),
        "domain": value.rlike(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\W*$"),
        "glued_before": before.rlike(r"[\p{L}0-9_]$"),
        "glued_after": F.col("after").rlike(r"^[\p{L}0-9_]"),
        "cue": before.rlike(CUES),
    }
    return rows.select(
        "__row",
        "kind",
        "start",
        "stop",
        F.exists("__base", same).cast("double").alias("label"),
        F.exists("__base", touches).alias("taken"),
        *(c.cast("double").alias(n) for n, c in features.items()),
    )


def _selected(candidates: DataFrame, p: Boosting) -> DataFrame | None:
    """Candidates beside the base spans whose calibrated score selects them; None where nothing can be learned.

    No table names personal data, so the base formats label the candidates; the trees learn what such
    spans look like and where they stand.
    """
    # Features are small whole numbers, so equal candidates are counted, not left out: the trees get each with its weight.
    held = F.pmod(F.xxhash64("start", "__row"), F.lit(4)) == 0
    tally = written(candidates.groupBy(held.alias("held"), "label", *FEATURES).agg(F.count("*").cast("double").alias("weight")), "candidates")
    rows = tally.count()
    train = tally.where("not held").coalesce(max(4, rows // 50_000))
    if train.select("label").distinct().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    # Spark looks for splits in a sample once there are more rows than the square of the bins.
    bins = max(32, math.isqrt(rows) + 1)
    trees = GBTClassifier(maxIter=p.rounds, maxDepth=p.depth, maxBins=bins, labelCol="label", featuresCol="features", weightCol="weight", seed=7)
    model = trees.fit(assembler.transform(train))
    score = lambda df: model.transform(assembler.transform(df)).withColumn("score", vector_to_array("probability")[1])
    sums = [F.sum("weight").cast("long").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("hits")]
    bins = score(tally.where("held")).groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(*sums).collect()
    seen, right, threshold = 0, 0.0, None
    for row in sorted(bins, key=lambda r: -r["bin"]):
        seen, right = seen + row["n"], right + row["hits"]
        if seen >= p.least and right >= p.precision * seen:
            threshold = row["bin"] / 100
    if threshold is None:
        return None
    return score(candidates.where("not taken")).where(F.col("score") >= max(threshold, 0.5)).select("__row", "kind", "start", "stop")


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("a"), s["stop"].alias("b"), s["kind"].alias("kind")),
        )
    )
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")


def find_personal_data(docs: DataFrame, keys: list[str], params: Boosting = Boosting()) -> DataFrame:
    """``keys`` of ``docs`` and n_email, n_ip, n_card, n_phone, base_sha256, n_added, spans: one row for each row.

    Counts and digest are those of the base formats; ``spans`` has these and the candidates that the boosted
    trees add, which touch no base span. Spans are kind:start:stop by kind, then start; offsets count code
    points. Null texts count as empty. Texts are searched once, and what is found is written to the shared
    folder; only counts of equal candidates and added spans are shuffled. Columns that are not in ``keys`` are not read.
    """
    scanned = written(_scan(docs, keys), "scanned")
    added = _selected(_candidates(scanned), params)
    if added is None:
        rows = scanned.withColumn("__added", F.expr("cast(array() as array<struct<kind:string,start:int,stop:int>>)"))
    else:
        per = added.groupBy("__row").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("__added"))
        rows = scanned.join(per, "__row", "left").withColumn("__added", F.coalesce("__added", F.array()))
    bare = F.transform("__base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    of_kind = lambda k: lambda s: s["kind"] == k
    return rows.select(
        *keys,
        *(F.size(F.filter("__base", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(bare).cast("binary"), 256).alias("base_sha256"),
        F.size("__added").cast("long").alias("n_added"),
        _joined(F.concat(bare, F.col("__added"))).alias("spans"),
    )
