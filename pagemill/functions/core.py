"""Small building blocks for column expressions over arrays."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep a built expression per argument list and JVM.

    A large expression takes thousands of calls into the JVM to put together; plans that share it
    pay for that once. Arguments must be plain values.
    """
    known: dict[tuple, Column] = {}

    @functools.wraps(build)
    def wrapper(*args: object) -> Column:
        key = (id(SparkContext._gateway), *args)
        if key not in known:
            known[key] = build(*args)
        return known[key]

    return wrapper


def let(body: Callable[[Column], Column], /, **values: Column) -> Column:
    """Bind ``values`` once and evaluate ``body`` on the resulting struct.

    Catalyst may inline a projected column into a lambda and so evaluate it once per array
    element. A one-element array keeps the value bound inside the expression itself.
    """
    bound = F.array(F.struct(*[value.alias(name) for name, value in values.items()]))
    return F.get(F.transform(bound, body), F.lit(0))


def derive(df: DataFrame, rows: Column, *keys: str | Column) -> DataFrame:
    """``keys`` plus the fields of a computed ``array<struct>``, one row per element.

    A generator is a barrier for the optimizer: no later filter or projection can pull the
    expression up or down and so evaluate it again. The outer form keeps Spark from adding a size
    test, which would do the same; arrays must not be empty unless NULL rows are wanted.
    """
    return df.select(*keys, F.inline_outer(rows))


def extend(df: DataFrame, **values: Column) -> DataFrame:
    """All columns of ``df`` plus computed ones, behind the same barrier.

    Long derivations are built from several of these: nested lambdas cost analysis time for each
    level, and a barrier ends the nesting.
    """
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    return derive(df, F.array(row), *df.columns)


def indices(array: Column) -> Column:
    """0-based positions of a non-empty array."""
    return F.sequence(F.lit(0), F.size(array) - 1)


def pick(array: Column, index: Column | int) -> Column:
    """Element at a 0-based position, NULL when out of range."""
    return F.get(array, index if isinstance(index, Column) else F.lit(index))


def spans(
    lengths: Column,
    limit: int,
    joiner: int,
    *,
    skip_leading_empty: bool = False,
    solo_over_limit: bool = False,
) -> Column:
    """Greedy forward packing of consecutive items into groups of at most ``limit`` characters.

    ``lengths`` holds the item lengths and ``joiner`` the length of the separator between two
    items of a group. The result is ``array<struct<s,e>>`` with 1-based inclusive bounds, so a
    fold carries integers only and never re-copies text.

    ``skip_leading_empty`` drops empty items in front of a group. ``solo_over_limit`` closes a
    group at once when its only item is longer than the limit.
    """
    span = "struct<s:int,e:int>"
    zero = F.struct(
        F.array().cast(f"array<{span}>").alias("done"),
        F.lit(0).alias("s"),
        F.lit(0).alias("e"),
        F.lit(0).alias("n"),
        F.lit(0).alias("i"),
    )

    def step(acc: Column, length: Column) -> Column:
        i = acc["i"] + 1
        fits = (acc["n"] > 0) & (acc["n"] + joiner + length <= limit)
        opens = (length > 0) if skip_leading_empty else F.lit(True)
        fresh_len = F.when(length > limit, 0).otherwise(length) if solo_over_limit else length
        # A group is open while s > 0; the running length n is 0 when nothing may be added.
        closed = F.when(acc["s"] > 0, F.array_append(acc["done"], _span(acc))).otherwise(acc["done"])
        started = F.struct(
            closed.alias("done"),
            F.when(opens, i).otherwise(0).alias("s"),
            F.when(opens, i).otherwise(0).alias("e"),
            F.when(opens, fresh_len).otherwise(0).alias("n"),
            i.alias("i"),
        )
        grown = F.struct(
            acc["done"].alias("done"),
            acc["s"].alias("s"),
            i.alias("e"),
            (acc["n"] + joiner + length).alias("n"),
            i.alias("i"),
        )
        return F.when(fits, grown).otherwise(started)

    def finish(acc: Column) -> Column:
        return F.when(acc["s"] > 0, F.array_append(acc["done"], _span(acc))).otherwise(acc["done"])

    return F.aggregate(lengths, zero, step, finish)


def _span(acc: Column) -> Column:
    return F.struct(acc["s"].alias("s"), acc["e"].alias("e"))


def take_span(array: Column, span: Column) -> Column:
    return F.slice(array, span["s"], span["e"] - span["s"] + 1)
