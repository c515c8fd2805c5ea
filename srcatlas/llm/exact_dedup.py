"""Exact duplicates by a 128-bit content hash, with the bytes compared inside groups (DataFrame functions only).

Rows: null text counts as the empty text; all empty texts are one group. A null doc_id sorts before every id.
Rows that repeat both doc_id and text are one document twice: all carry the same keep_id and exactly one is kept.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import known_id, known_text, shown_id, written

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Buckets of the filter before the byte comparison; it is broadcast, and this bounds its rows.
FILTER_BUCKETS = 1 << 20


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, SMALL)


def exact_groups(docs: DataFrame, keep: str = "smallest", lower: bool = True, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: 'smallest' or 'largest' doc_id of a group stays. Counts go through partial aggregation, so a group with
    a third of all rows leaves each task as one row; the join back splits under adaptive skew handling.
    Bytes: min(text) = max(text) holds in a group exactly if all its texts are equal, and both aggregate partially.
    Only rows whose length and first characters occur in a group of two or more are read for it. A group where they
    differ (a hash collision) is divided by the text itself.
    """
    norm = ascii_lower if lower else (lambda c: c)
    pick = F.min if keep == "smallest" else F.max
    text = known_text()
    bucket = F.pmod(F.xxhash64(F.octet_length(text), norm(F.substring(text, 1, 48))), F.lit(FILTER_BUCKETS)).cast("int")
    scan = docs.select(known_id().alias("_id"), text.alias("_text"), bucket.alias("_b"))
    hashed = scan.select("_id", "_b", norm(F.col("_text")).alias("_norm"))
    digests = written(hashed.select("_id", "_b", content_hash(F.col("_norm")).alias("_h"), F.sha2("_norm", 256).alias("text_sha256")), "digests")
    # Written, so that the join back shuffles both sides anew and a hot group's side can be split.
    sizes = written(digests.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), pick("_id").alias("_keep")), "sizes")
    several = F.broadcast(digests.join(sizes.filter("_n > 1"), "_h", "left_semi").select("_b").distinct())
    again = scan.join(several, "_b", "left_semi").select("_id", norm(F.col("_text")).alias("_norm"))
    again = again.select("_id", "_norm", content_hash(F.col("_norm")).alias("_h"))
    collided = written(again.groupBy("_h").agg(F.min("_norm").alias("_lo"), F.max("_norm").alias("_hi")).filter("_lo <> _hi").select("_h"), "collided")
    out = digests.join(sizes, "_h")
    if not collided.isEmpty():
        # The bytes differ: groups by the text itself take the place of groups by its hash.
        apart = (
            again.join(collided, "_h").groupBy("_h", "_norm").agg(F.count(F.lit(1)).alias("_n2"), pick("_id").alias("_keep2"))
            .select("_h", F.sha2("_norm", 256).alias("text_sha256"), "_n2", "_keep2")
        )
        out = out.join(apart, ["_h", "text_sha256"], "left").withColumns({"_keep": F.coalesce("_keep2", "_keep"), "_n": F.coalesce("_n2", "_n")})
    # A repeated (doc_id, text) keeps one of its rows; the window's groups are only such repeats.
    once = F.row_number().over(Window.partitionBy("_id", "text_sha256").orderBy("_h"))
    return out.withColumn("_row", once).select(
        shown_id("_id").alias("doc_id"), shown_id("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        ((F.col("_id") == F.col("_keep")) & (F.col("_row") == 1)).alias("kept"), "text_sha256",
    )
