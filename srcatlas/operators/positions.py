"""Line indexes and positions (H.1-H.5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import utf16_length
from ..plans.asof import last_before


def line_index(files: DataFrame) -> DataFrame:
    """H.4: file_id, line, start, byte_len, utf16_len; lines end with LF or CRLF, and text after the last one is a line.

    Lines explode per file and a running sum inside the file gives their starts.
    """
    lines = files.select("file_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    before = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("raw") + 1).over(before), F.lit(0))
    content = F.regexp_replace("raw", "\r$", "")
    return lines.select("file_id", "line", start.cast("long").alias("start"), F.octet_length(content).cast("long").alias("byte_len"), utf16_length(content).cast("long").alias("utf16_len"))


def utf8_positions(offsets: DataFrame, lines: DataFrame) -> DataFrame:
    """H.1: offsets (file_id, offset) with line and byte column; an as-of lookup of the last line start."""
    found = last_before(offsets, lines, ["file_id"], "offset", "start", ["line", "start"])
    return found.withColumn("column", F.col("offset") - F.col("start")).drop("start")


def words(files: DataFrame) -> DataFrame:
    """Spans of space-separated words: file_id, span_start, span_end, word, by a running sum inside the file."""
    some = files.select("file_id", F.posexplode(F.split("text", "[ \n]")).alias("n", "word"))
    before = Window.partitionBy("file_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("word") + 1).over(before), F.lit(0)).cast("long")
    return some.withColumn("span_start", start).withColumn("span_end", F.col("span_start") + F.octet_length("word")).filter("word <> ''").drop("n")
