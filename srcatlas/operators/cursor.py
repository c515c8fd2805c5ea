"""What is under a cursor (H.6-H.9, H.15, H.16, I.1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.interval import points_in_spans


def symbol_at(cursors: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """I.1: for each cursor (query_id, keys, offset) the narrowest site that touches it; the first in scan order wins ties.

    A bucketed interval join, then one aggregate by query: no window over all candidates.
    """
    found = points_in_spans(cursors, sites, keys)
    best = F.min(F.struct((F.col("span_end") - F.col("span_start")).alias("n"), "scan_order", "span_start", "span_end", "entity_id"))
    return found.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.entity_id", "b.span_start", "b.span_end")


def innermost_body(cursors: DataFrame, bodies: DataFrame, keys: list[str]) -> DataFrame:
    """H.15: the smallest body that contains (half-open) each cursor; the smaller body_id wins ties."""
    found = points_in_spans(cursors, bodies, keys, closed=False)
    best = F.min(F.struct((F.col("span_end") - F.col("span_start")).alias("n"), "body_id"))
    return found.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.body_id")
