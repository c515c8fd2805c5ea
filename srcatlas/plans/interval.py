"""Interval joins with equi-keys: spans are dealt into buckets as wide as they are, so no join is a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bucket widths: a span goes to the first that is no shorter than its sixteenth, so it lies in at most 17 buckets, whatever its length.
WIDTHS = [256 << 4 * k for k in range(7)]


def _width(length: Column) -> Column:
    out = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS[:-1]):
        out = F.when(length < 16 * w, F.lit(w)).otherwise(out)
    return out


def with_width(spans: DataFrame, start: str = "span_start", end: str = "span_end") -> DataFrame:
    return spans.withColumn("_width", _width(F.col(end) - F.col(start)))


def dealt_spans(wide: DataFrame, start: str = "span_start", end: str = "span_end") -> DataFrame:
    """The spans of with_width with _bucket, one row for each bucket that they lie in."""
    return wide.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / F.col("_width")), F.floor(F.col(end) / F.col("_width")))))


def dealt_points(points: DataFrame, at: str, wide: DataFrame) -> DataFrame:
    """points with the bucket that they lie in at each width that a span has, of len(WIDTHS) at most."""
    widths = F.broadcast(wide.select("_width").distinct())
    return points.join(widths).withColumn("_bucket", F.floor(F.col(at) / F.col("_width")))


def points_in_spans(points: DataFrame, spans: DataFrame, keys: list[str], at: str = "offset", closed: bool = True) -> DataFrame:
    """points joined to the spans (span_start, span_end) over them; closed also takes a point at the end (C.6, C.7)."""
    wide = with_width(spans)
    found = dealt_points(points, at, wide).join(dealt_spans(wide), [*keys, "_width", "_bucket"]).drop("_width", "_bucket")
    return found.filter((F.col("span_start") <= F.col(at)) & ((F.col(at) <= F.col("span_end")) if closed else (F.col(at) < F.col("span_end"))))


def smallest_cover(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """children with parent_id: the shortest span of parents that covers the child's and differs from it (C.8); else null.

    children: keys, id, span_start, span_end; parents likewise. Ties go to the smaller id.
    """
    wide = with_width(parents.select(*keys, F.col("id").alias("_pid"), F.col("span_start").alias("_ps"), F.col("span_end").alias("_pe")), "_ps", "_pe")
    over = dealt_points(children, "span_start", wide).join(dealt_spans(wide, "_ps", "_pe"), [*keys, "_width", "_bucket"]).filter("_ps <= span_start and span_end <= _pe and (_ps <> span_start or _pe <> span_end)")
    best = over.groupBy(*keys, "id").agg(F.min(F.struct((F.col("_pe") - F.col("_ps")).alias("n"), F.col("_pid").alias("parent_id"))).alias("best"))
    return children.join(best.select(*keys, "id", F.col("best.parent_id").alias("parent_id")), [*keys, "id"], "left")
