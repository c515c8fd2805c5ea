"""Symbol search, container paths, outlines (C.8, C.14, I.22-I.25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import rank_of, symbol_matches
from ..plans.durable import durable
from ..plans.interval import smallest_cover


def workspace_symbols(defs: DataFrame, needle: str) -> DataFrame:
    """I.24: definitions whose name contains the needle, in the observable order."""
    found = defs.filter(symbol_matches(F.col("name"), F.lit(needle))).withColumn("kind_rank", rank_of(F.col("kind")))
    return found.orderBy(F.lower("name"), "kind_rank", F.col("container").asc_nulls_first(), "package_slot", "start", "def_id")


def workspace_symbols_batch(defs: DataFrame, needles: DataFrame) -> DataFrame:
    """I.24 for many searches (query_id, needle): one pass over defs; needles are broadcast only after their count.

    Above 32 searches, the first three letters of each needle meet the names' trigrams in an equi-join; needles of one
    or two letters meet one- and two-letter grams. An empty needle asks for all of defs, so its rows are the whole answer.
    """
    if needles.limit(33).count() <= 32:
        return defs.join(F.broadcast(needles), symbol_matches(F.col("name"), F.col("needle")))
    out = defs.join(needles.filter("needle = ''"))
    for n in (1, 2, 3):
        asked = needles.filter(F.length("needle") == n if n < 3 else F.length("needle") >= 3).withColumn("_gram", F.substring(F.lower("needle"), 1, n))
        named = defs.filter(F.length("name") >= n).withColumn("_gram", F.explode(F.array_distinct(_grams(F.col("name"), n))))
        found = named.join(asked, "_gram").drop("_gram").filter(symbol_matches(F.col("name"), F.col("needle")))
        out = out.unionByName(found)
    return out


def _grams(name: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substr(F.lower(name), i, F.lit(n)))


def container_paths(modules: DataFrame, separator: str = "::", most_depth: int = 100) -> DataFrame:
    """I.25: module_id, depth, path. Levels join downwards, one shuffle join a level of the tree."""
    level = durable(modules.filter("parent_id is null").select("module_id", F.lit(0).alias("depth"), F.col("name").alias("path")))
    out = level
    for _ in range(most_depth):
        up = level.select(F.col("module_id").alias("parent_id"), "depth", "path")
        level = durable(modules.join(up, "parent_id").select("module_id", (F.col("depth") + 1).alias("depth"), F.concat_ws(separator, "path", "name").alias("path")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise RuntimeError("modules form a cycle or a deeper tree than most_depth")


def document_outline(items: DataFrame, modules: DataFrame) -> DataFrame:
    """I.22: items nested under the smallest module span of their file that covers them."""
    return smallest_cover(items, modules, ["file_id"])
