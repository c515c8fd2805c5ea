"""Spans are half-open UTF-8 byte ranges, positions zero-based lines and columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters outside the basic plane take two UTF-16 units.
ASTRAL = r"[^\x{10000}-\x{10FFFF}]"


def contains(start: Column, end: Column, at: Column) -> Column:
    """C.6: start <= at < end."""
    return (start <= at) & (at < end)


def touches(start: Column, end: Column, at: Column) -> Column:
    """C.7: start <= at <= end."""
    return (start <= at) & (at <= end)


def covers(p_start: Column, p_end: Column, start: Column, end: Column) -> Column:
    """C.8: the parent covers the child and differs from it."""
    return (p_start <= start) & (end <= p_end) & ((p_start != start) | (p_end != end))


def utf16_length(text: Column) -> Column:
    """H.2: UTF-16 units of a text."""
    return F.length(text) + F.length(F.regexp_replace(text, ASTRAL, ""))


def span_text(text: Column, start: Column, end: Column) -> Column:
    """H.5: the slice of a text's bytes; null for a span outside or through a character."""
    data = F.encode(text, "utf-8")
    inside = (start >= 0) & (start <= end) & (end <= F.octet_length(text))
    return F.when(inside, F.try_validate_utf8(F.substring(data, start.cast("int") + 1, (end - start).cast("int"))))


def utf16_column(line: Column, column: Column) -> Column:
    """H.2: UTF-16 column of a byte column in a line's text; columns past the end count as the end."""
    return utf16_length(F.substring(F.encode(line, "utf-8"), F.lit(1), F.least(column, F.octet_length(line)).cast("int")).cast("string"))


def byte_column(line: Column, utf16: Column) -> Column:
    """H.3: byte column of a UTF-16 column; null inside a surrogate pair, the line's end beyond it."""
    chars = F.filter(F.split(line, ""), lambda c: c != "")
    state = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("units"), F.lit(0).alias("bytes"), F.lit(None).cast("int").alias("found")),
        lambda s, c: F.struct(
            (s["units"] + F.when(F.octet_length(c) == 4, 2).otherwise(1)).alias("units"),
            (s["bytes"] + F.octet_length(c)).alias("bytes"),
            F.coalesce(s["found"], F.when(s["units"] == utf16, s["bytes"])).alias("found"),
        ),
    )
    return F.when(utf16 >= state["units"], F.octet_length(line)).otherwise(state["found"])
