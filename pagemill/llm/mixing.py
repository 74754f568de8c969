"""Mixing sources to target weights as a Pfair schedule, in DataFrame operations only.

A source of weight w (units of a period) must have had its k-th block released by floor(k * period / w)
and placed before ceil((k + 1) * period / w). Earliest deadline first places one block a slot inside
these windows, so no prefix of the periods is a whole block away from any weight. Rows that whole weights cannot
hold are dealt evenly between their slots.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import written

#: Sources below this share of the rows are scheduled together, as one.
POOLED = "(pooled)"
NO_SOURCE = "(none)"


@dataclass(frozen=True)
class Mix:
    """``period``: slots of a schedule that repeats; weights are whole numbers of its slots. ``block_rows``: rows a block.

    Targets that follow supply: shares of the rows, where no source gets more than ``most`` and sources
    under ``least`` are pooled. ``buckets``: parts that a source's rows are numbered in.
    """

    period: int = 10_000
    block_rows: int = 1
    most: float = 0.25
    least: float = 0.005
    buckets: int = 4096


class Targets(dict):
    """Whole weights by source, and in ``rows`` how many of each source's rows the mix is to hold."""

    def __init__(self, weights: dict[str, int], rows: dict[str, int]) -> None:
        super().__init__(weights)
        self.rows = rows


def supply_weights(rows: DataFrame, source: str, p: Mix) -> Targets:
    """Whole weights by source, ``p.period`` in total, and the rows that each source has for the mix.

    A source under one slot of the period has no weight, only rows. Slots that rounding down leaves go
    where they exceed the supply least. At most 1 / ``least`` sources are read back from the counts.
    """
    name = F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE))
    counts = rows.groupBy(name.alias("source")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return Targets({}, {})
    large = {r["source"]: r["n"] for r in counts.where(F.col("n") >= p.least * total).collect()}
    if total > sum(large.values()):
        large[POOLED] = large.get(POOLED, 0) + total - sum(large.values())
    # Over-full sources are cut to the cap, which the others then fill in proportion.
    held, share, capped = dict(large), {s: n / total for s, n in large.items()}, set()
    while len(large) * p.most >= 1 and (over := {s for s, x in share.items() if x > p.most + 1e-12 and s not in capped}):
        capped |= over
        rest = sum(n for s, n in large.items() if s not in capped)
        left = 1 - p.most * len(capped)
        share = {s: p.most if s in capped else n / rest * left for s, n in large.items()}
        held = {s: min(n, int(p.most * rest / left + 1e-9)) if s in capped else n for s, n in large.items()}
    mixed = sum(held.values())
    weights = {s: n * p.period // mixed for s, n in held.items()}
    some = [s for s, w in weights.items() if w] or list(weights)
    for _ in range(p.period - sum(weights.values())):
        weights[max(some, key=lambda s: (held[s] / (weights[s] + 1), s))] += 1
    return Targets({s: w for s, w in weights.items() if w}, held)


def schedule(spark: SparkSession, weights: dict[str, int]) -> DataFrame:
    """One period: (source, k, slot, release, deadline), the k-th block of a source from 0 on.

    A fold over the slots of one period, which is as long as the weights' sum whatever the data.
    Ties in the deadline go to the source that sorts first.
    """
    names = sorted(weights)
    period = sum(weights.values())
    if period <= 0 or min(weights.values()) < 1:
        raise ValueError("weights must be positive whole numbers")
    w = F.array(*(F.lit(weights[s]).cast("long") for s in names))
    total = F.lit(period).cast("long")

    def first_due(done: Column, slot: Column) -> Column:
        def due(k: Column, i: Column) -> Column:
            share = F.get(w, i)
            start = F.floor(k * total / share)  # exact: the quotients are small
            end = F.ceil((k + 1) * total / share)
            return F.when((k < share) & (start <= slot), F.struct(end.alias("deadline"), i.alias("i"), k.alias("k"), start.alias("release")))

        return F.array_min(F.transform(done, due))

    def step(state: Column, slot: Column) -> Column:
        # The chosen block is bound once: a one-element array is transformed into the next state.
        return F.get(
            F.transform(
                F.array(first_due(state["done"], slot)),
                lambda c: F.struct(
                    F.transform(state["done"], lambda k, i: F.when(i == c["i"], k + 1).otherwise(k)).alias("done"),
                    F.concat(state["plan"], F.array(c)).alias("plan"),
                ),
            ),
            F.lit(0),
        )

    start = F.struct(
        F.array(*(F.lit(0).cast("long") for _ in names)).alias("done"),
        F.expr("cast(array() as array<struct<deadline: bigint, i: int, k: bigint, release: bigint>>)").alias("plan"),
    )
    plan = spark.range(1).select(
        F.posexplode(F.aggregate(F.sequence(F.lit(0).cast("long"), total - 1), start, step, lambda s: s["plan"])).alias("slot", "c")
    )
    label = F.array(*(F.lit(s) for s in names))
    return plan.select(
        F.get(label, F.col("c.i")).alias("source"),
        F.col("c.k").alias("k"),
        F.col("slot").cast("long").alias("slot"),
        F.col("c.release").alias("release"),
        F.col("c.deadline").alias("deadline"),
    )


def _numbers(spark: SparkSession, of: dict[str, int], column: str) -> DataFrame:
    """(mix_source, ``column``). From Arrow, as a list of rows would start a second set of Python workers on the executors."""
    return spark.createDataFrame(pa.table({"mix_source": pa.array(of.keys(), pa.string()), column: pa.array(of.values(), pa.int64())}))


def _whole(a: Column, b: Column | int) -> Column:
    """Whole quotient of whole numbers."""
    return F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)


def _rank(i: Column, own: Column, rests: dict[str, int]) -> Column:
    """Place of row ``i`` of source ``own`` when rows of all ``rests`` are dealt evenly: by (2 i + 1) / rest, then source."""
    size = F.create_map(*(F.lit(x) for s in rests for x in (s, rests[s])))[own].cast("long")
    others = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(n).cast("long").alias("n")) for s, n in rests.items()))

    def before(other: Column) -> Column:
        reach = (2 * i + 1) * other["n"] - F.when(other["s"] < own, 0).otherwise(1)
        return F.least(_whole(_whole(reach, size) + 1, 2), other["n"])

    return F.aggregate(others, F.lit(0).cast("long"), lambda n, o: n + before(o))


def mix(rows: DataFrame, source: str, key: str, weights: dict[str, int], p: Mix = Mix()) -> DataFrame:
    """``rows`` with mix_source, mix_block, mix_slot, mix_release, mix_deadline, mixed added.

    A source's rows are put in the order of the md5 of ``key`` (ties by ``key``; equal keys in any order), cut into
    blocks and scheduled. The mix ends at the first slot whose source has no block left: ``mixed`` tells
    whether the row's slot lies before it. The other rows are surplus and stay in the result. Sources
    that ``weights`` does not name are scheduled as POOLED if it names that, else they are surplus with no
    slot; a null source counts as NO_SOURCE. Added columns replace columns of the same name.

    ``Targets`` also name rows: those that are left when the periods end are dealt evenly between the slots,
    in closed form, so that each source ends with its last row. They move the other slots and windows up.

    No task holds a source: rows are numbered inside ``p.buckets`` parts of each, whose sizes are summed.
    """
    spark = rows.sparkSession
    added = ["mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mixed"]
    rows = rows.drop(*added)
    if not weights:
        kinds = ("string", "long", "long", "long", "long", "boolean")
        return rows.select("*", *(F.lit(None).cast(k).alias(c) for c, k in zip(added, kinds))).withColumn("mixed", F.lit(False))
    period = sum(weights.values())
    targets = weights.rows if isinstance(weights, Targets) else {}
    name = F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE))
    pooled = F.when(name.isin(*(set(weights) | set(targets))), name).otherwise(F.lit(POOLED))
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    bucket = F.pmod(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), F.lit(1 << 16)) * p.buckets / (1 << 16)
    placed = rows.select("*", pooled.alias("mix_source"), digest.alias("__digest"), F.floor(bucket).cast("int").alias("__bucket"))
    sizes = placed.groupBy("mix_source", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("mix_source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("mix_source", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # The first slot without a block: a source of n rows has n / block_rows blocks, and its next one is due then.
    held = {r["mix_source"]: r["n"] for r in sizes.groupBy("mix_source").agg(F.sum("__n").alias("n")).collect()}
    held = {s: -(-min(n, targets.get(s, n)) // p.block_rows) for s, n in held.items()}
    blocks = _numbers(spark, held, "blocks")
    plan = written(schedule(spark, weights), "plan")  # folded once
    units = _numbers(spark, weights, "__w")
    dry = (
        units.join(blocks, "mix_source", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(0)))
        .join(plan.withColumnRenamed("source", "mix_source"), "mix_source")
        .where("k = pmod(blocks, __w)")
        .agg(F.min((F.col("blocks") - F.col("k")) / F.col("__w") * period + F.col("slot")).cast("long").alias("slot"))
    )
    end = dry.first()["slot"]
    # Blocks of the targets that the slots before the end do not hold.
    ahead = {r["source"]: r["n"] for r in plan.where(F.col("slot") < end % period).groupBy("source").agg(F.count("*").alias("n")).collect()}
    done = {s: end // period * w + ahead.get(s, 0) for s, w in weights.items()}
    rests = {s: held[s] - done.get(s, 0) for s in sorted(targets) if held.get(s, 0) > done.get(s, 0)}
    more = sum(rests.values())
    inside = Window.partitionBy("mix_source", "__bucket").orderBy("__digest", key)
    numbered = (
        placed.withColumn("__row", F.row_number().over(inside))
        .join(offsets, ["mix_source", "__bucket"])
        .withColumn("mix_block", F.floor((F.col("__row") - 1 + F.col("__before")) / p.block_rows))
    )
    # Weights are at most 1 / least long, the plan one period: both fit any broadcast.
    numbered = numbered.join(F.broadcast(units), "mix_source", "left").withColumn("__k", F.pmod("mix_block", "__w"))
    plan = F.broadcast(plan.select(F.col("source").alias("mix_source"), F.col("k").alias("__k"), "slot", "release", "deadline"))
    shift = (F.col("mix_block") - F.col("__k")) / F.col("__w") * period
    scheduled = numbered.join(plan, ["mix_source", "__k"], "left").withColumns(
        {f"mix_{c}": (F.col(c) + shift).cast("long") for c in ("slot", "release", "deadline")}
    )
    if more:
        first = F.create_map(*(F.lit(x) for s in rests for x in (s, done.get(s, 0))))[F.col("mix_source")]
        late = (F.col("mix_block") >= first) & (F.col("mix_block") < first + F.create_map(*(F.lit(x) for s in rests for x in (s, rests[s])))[F.col("mix_source")])
        place = F.when(late, _rank((F.col("mix_block") - first).cast("long"), F.col("mix_source"), rests))
        moved = lambda c: c + F.least(_whole(_whole(2 * more * (c + 1) - 1, end) + 1, 2), F.lit(more).cast("long"))
        scheduled = scheduled.withColumn("__place", place)
        rest, every = F.col("__place"), F.lit(end + more).cast("long")
        windows = {
            "slot": rest + _whole((2 * rest + 1) * F.lit(end).cast("long"), 2 * more),
            "release": _whole(rest * every, more),
            "deadline": _whole((rest + 1) * every + more - 1, more),
        }
        scheduled = scheduled.withColumns({f"mix_{c}": F.when(rest.isNull(), moved(F.col(f"mix_{c}"))).otherwise(x) for c, x in windows.items()})
    return scheduled.withColumn("mixed", F.coalesce(F.col("mix_slot") < end + more, F.lit(False))).select(*rows.columns, *added)
