"""Counters, roll-ups and fingerprints (K.1-K.7, J.10, L.13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fingerprint


def counters(tables: dict[str, DataFrame]) -> DataFrame:
    """K.1-K.4: one row of counts per table, each from its own partial aggregate."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def counts_by_kind(items: DataFrame) -> DataFrame:
    """K.3: items by kind."""
    return items.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def memory_rollup(rows: DataFrame, levels: list[str], size: Column) -> DataFrame:
    """K.5: sums and counts over all prefixes of the levels; level tells how many levels a row keeps."""
    depth = sum(((F.grouping(c) == 0).cast("int") for c in levels), F.lit(0))
    return rows.rollup(*levels).agg(F.sum(size).cast("long").alias("bytes"), F.count(F.lit(1)).alias("n"), depth.alias("level"))


def package_fingerprints(files: DataFrame) -> DataFrame:
    """J.10: package, files, fingerprint over its files' digests in order of file_id.

    Only 64 hex digits a file are gathered; packages with very many files hash bands of files first.
    """
    per_file = files.select("package", "file_id", F.concat(F.col("file_id").cast("string"), F.lit(":"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("d"))
    band = F.floor(F.col("file_id") / 4096)
    banded = per_file.groupBy("package", band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_id", "d"))), lambda x: x["d"]), "\n"), 256).alias("h"))
    return banded.groupBy("package").agg(F.sum("n").alias("files"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("band", "h"))), lambda x: x["h"]), "\n"), 256).alias("fingerprint"))


def artifact_identity(files: DataFrame, policy: str) -> DataFrame:
    """L.5, L.13, J.10: file_id, identity: one digest over path, text and body policy, each tagged by its length."""
    return files.select("file_id", fingerprint("artifact", F.col("path"), F.col("text"), F.lit(policy)).alias("identity"))


def stale_artifacts(current: DataFrame, cached: DataFrame) -> DataFrame:
    """L.13: files whose cached hash is missing or differs: an anti-join on key and hash."""
    return current.join(cached.select("file_id", "hash"), ["file_id", "hash"], "left_anti")


def cache_probe(current: DataFrame, cached: DataFrame) -> DataFrame:
    """K.7: how many files hit, miss or changed."""
    c = cached.select("file_id", F.col("hash").alias("_old"))
    reason = F.when(F.col("_old").isNull(), "missing").when(F.col("_old") != F.col("hash"), "changed").otherwise("hit")
    return current.join(c, "file_id", "left").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
