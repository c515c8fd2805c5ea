"""Bracket pairs of code (for B.10, C.1, F.2, F.7, G.4, H.10-H.13, J.1): every token with the bracket around it, and parts.

A closing bracket ends the last open one of its depth, so one window per file and depth pairs them and tells every token
which bracket is around it. Tokens of one bracket are siblings: what ends a statement, an item or a pattern is the next such
sibling, at any distance. Regions (heads, bodies of types) also count angle brackets and number their comma-separated parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPENING, CLOSING = ("{", "(", "["), ("}", ")", "]")


def structure(toks: DataFrame) -> DataFrame:
    """Significant tokens in order, with their neighbours (prev.., next..; gap: something stands between), depth before and
    after, for opening brackets where the partner is (close_n, close_start, close_end, after_close: the token after it), and
    the bracket around each (open_n, open_start, open_token, open_prev; null outside). A closing bracket is inside its own pair.

    A table that has these columns is given back as it is, so it can be written once and passed to all operators.
    """
    if "open_n" in toks.columns:
        return toks
    some = toks.filter(~F.col("kind").isin("whitespace", "comment")).select("file_id", "n", "token", "kind", "span_start", "span_end")
    order = Window.partitionBy("file_id").orderBy("n")
    opens, closes = F.col("token").isin(*OPENING), F.col("token").isin(*CLOSING)
    after = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    near = some.withColumns({
        "depth_after": after, "prev": F.lag("token").over(order), "prev2": F.lag("token", 2).over(order), "prev3": F.lag("token", 3).over(order), "next": F.lead("token").over(order),
        "next2": F.lead("token", 2).over(order), "next_start": F.lead("span_start").over(order), "gap": F.coalesce(F.col("span_start") > F.lag("span_end").over(order), F.lit(False)),
    }).withColumn("depth", F.col("depth_after") - F.when(opens, 1).when(closes, -1).otherwise(0))
    inner = F.when(opens, F.col("depth_after")).when(closes, F.col("depth"))
    partner = F.lead(F.struct("n", "span_start", "span_end", "next")).over(Window.partitionBy("file_id", "_inner").orderBy("n"))
    paired = near.withColumn("_inner", inner).withColumn("_p", F.when(opens, partner)).withColumns({"close_n": F.col("_p.n"), "close_start": F.col("_p.span_start"), "close_end": F.col("_p.span_end"), "after_close": F.col("_p.next")}).drop("_p")
    # Each opening bracket also stands among the tokens that it holds, to be the last one before them.
    place = lambda level, mark: F.struct(level.alias("level"), F.lit(mark).alias("mark"))
    both = paired.withColumn("_r", F.explode(F.when(opens, F.array(place(F.col("depth"), False), place(F.col("depth_after"), True))).otherwise(F.array(place(F.col("depth"), False)))))
    around = F.last(F.when(F.col("_r.mark"), F.struct("n", "span_start", "token", "prev", "close_start")), ignorenulls=True)
    held = both.withColumn("_o", around.over(Window.partitionBy("file_id", "_r.level").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))).filter("not _r.mark")
    return held.withColumns({"open_n": F.col("_o.n"), "open_start": F.col("_o.span_start"), "open_token": F.col("_o.token"), "open_prev": F.col("_o.prev"), "open_close": F.col("_o.close_start")}).drop("_o", "_r", "_inner")


def siblings(*more: str) -> Window:
    """Tokens of one bracket, in order."""
    return Window.partitionBy("file_id", "open_n", *more).orderBy("n")


def ahead(*keys: str, order: str = "n") -> Window:
    """Rows after a row, the farthest first: F.last over it is the next one. Such a frame grows by one row at a time, while
    one that begins at the row and runs to the end is read anew for every row."""
    return Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)


def following(condition: Column, value: Column, *keys: str, order: str = "n") -> Column:
    """value at the next row of the same keys for which the condition holds."""
    return F.last(F.when(condition, value), ignorenulls=True).over(ahead(*keys, order=order))


def next_sibling(condition: Column, value: Column) -> Column:
    """value at the next token of the same bracket for which the condition holds."""
    return following(condition, value, "file_id", "open_n")


def single(mark: str) -> Column:
    """The token is that mark and no part of a doubled one or of an arrow or comparison."""
    near = [mark, *"=!<>+-*/%&|^"] if mark == "=" else [mark]
    return (F.col("token") == mark) & ~(F.col("prev").isin(*near) & ~F.col("gap")) & ~(F.col("next").isin(mark, ">") & (F.col("next_start") == F.col("span_end")))


def as_written(condition: Column | None = None) -> Column:
    """Aggregate: a group's tokens for which the condition holds, as written, one space for whatever stands between two."""
    some = F.struct("n", "gap", "token") if condition is None else F.when(condition, F.struct("n", "gap", "token"))
    return F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(some)), lambda x: F.concat(F.when(x["gap"], " ").otherwise(""), x["token"])), ""))


def in_order(condition: Column) -> Column:
    """Aggregate: a group's tokens for which the condition holds."""
    return F.transform(F.sort_array(F.collect_list(F.when(condition, F.struct("n", "token")))), lambda x: x["token"])


def regions(near: DataFrame, starts: DataFrame) -> DataFrame:
    """Tokens of regions in which `<` and `>` are brackets (types, heads). starts: file_id, region, from_n, to_n (exclusive),
    none inside another one. Adds region, base (the depth at its first token) and angle (angle brackets open before).

    The region of a token is the last one that begins before it, so no interval join is made.
    """
    begun = near.join(starts.select("file_id", F.col("from_n").alias("n"), F.struct("region", "to_n").alias("_s")), ["file_id", "n"], "left")
    order = Window.partitionBy("file_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_s").isNotNull(), F.struct("_s.region", "_s.to_n", "depth")), ignorenulls=True)
    inside = begun.withColumn("_l", last.over(order)).filter("n < _l.to_n").withColumns({"region": F.col("_l.region"), "base": F.col("_l.depth")}).drop("_s", "_l")
    arrow = F.col("prev").isin("-", "=") & ~F.col("gap")
    step = F.when(F.col("token") == "<", 1).when((F.col("token") == ">") & ~arrow, -1).otherwise(0)
    return inside.withColumn("angle", F.sum(step).over(Window.partitionBy("file_id", "region").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - F.when(step == 1, 1).otherwise(0))


def parts(inside: DataFrame, level: int = 1) -> DataFrame:
    """Tokens of a region's bracket, whose inside is `level` deeper than the region's base, with part, the number of commas before at that
    level, and colon: the first single colon of the part there (its n), which parts a pattern or a name from its type."""
    here = (F.col("depth") == F.col("base") + level) & (F.col("angle") == 0)
    comma = (F.col("token") == ",") & here
    numbered = inside.withColumn("part", F.coalesce(F.sum(comma.cast("int")).over(Window.partitionBy("file_id", "region").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    colon = single(":") & here
    whole = Window.partitionBy("file_id", "region", "part")
    return numbered.filter(~comma).withColumn("colon", F.min(F.when(colon, F.col("n"))).over(whole))
