"""Loops to a fixpoint over DataFrames: a frontier loop for monotone closures, full rounds for the rest."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable, forget

#: Rounds of a closure after which its tables become one.
COMPACT = 16


class NotSettled(RuntimeError):
    """A loop reached its cap before its result stopped changing."""


def digest(rows: DataFrame) -> tuple:
    """Row count and two sums of row hashes: equal for equal sets of rows, in any order, by one aggregate a table."""
    cols = [*rows.columns, *(F.col(c).isNull() for c in rows.columns)]
    one, two = F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)
    low, high = (lambda c: c.bitwiseAND(0xFFFFFFFF)), (lambda c: F.shiftrightunsigned(c, 32))
    return tuple(rows.agg(F.count(F.lit(1)), *(F.sum(f(c)) for c in (one, two) for f in (low, high))).first())


def closure(seed: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 1000) -> DataFrame:
    """seed and everything that step derives from new rows, each row once (D.23-D.25).

    Only rows found in the last round are stepped on; rows seen before are taken out by an anti-join on all columns, so
    cycles end. Rounds are written, so the plan does not grow; every COMPACT rounds those before become one table.
    """
    columns = seed.columns
    parts = [durable(seed.distinct())]
    for n in range(1, most_rounds + 1):
        seen = reduce(DataFrame.unionByName, parts)
        frontier = durable(step(parts[-1]).select(columns).distinct().join(seen, columns, "left_anti"))
        if frontier.isEmpty():
            return seen
        if n % COMPACT == 0:
            whole = durable(seen)
            for part in parts:
                forget(part)
            parts = [whole]
        parts.append(frontier)
    raise NotSettled(f"no end after {most_rounds} rounds")


def rounds(start: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 128) -> DataFrame:
    """step(step(...start)) until a whole round equals the one before (D.19): for steps that may also take rows away."""
    now = durable(start.distinct())
    now_is = digest(now)
    for _ in range(most_rounds):
        new = durable(step(now).select(now.columns).distinct())
        new_is = digest(new)
        forget(now)
        if now_is == new_is:
            return new
        now, now_is = new, new_is
    raise NotSettled(f"no end after {most_rounds} rounds")
