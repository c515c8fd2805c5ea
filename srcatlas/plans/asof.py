"""As-of lookups without an inequality join: both sides stand in one ordered window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_before(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, payload: list[str], strict: bool = False) -> DataFrame:
    """Each row of left with the payload of right's last row at or before it (strict: before it), null if none.

    One sort per key instead of a join of all earlier rows, so cost is linear in both sides.
    """
    right_first = 1 if strict else 0
    tagged_left = left.select(*[F.col(k) for k in keys], F.col(left_on).alias("_at"), F.lit(1 - right_first).alias("_tag"), F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"))
    tagged_right = right.select(*[F.col(k) for k in keys], F.col(right_on).alias("_at"), F.lit(right_first).alias("_tag"), F.lit(None).alias("_left"), F.struct(*payload).alias("_right"))
    both = tagged_left.unionByName(tagged_right)
    seen = Window.partitionBy(*keys).orderBy("_at", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_right", ignorenulls=True).over(seen)).filter("_left is not null")
    return found.select("_left.*", *[F.col("_found")[p].alias(p) for p in payload])
