"""Document state, overlays, debounce, diagnostics, rebuild plans (A.14, L.1-L.14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_documents(events: DataFrame) -> DataFrame:
    """L.1, L.2: state of each path after all events: version, op of the highest version; closed paths are gone.

    An event with a lower version than one before it never wins, so the state is a max_by and needs no order of arrival.
    """
    moves = events.filter(F.col("op") != "failed_save")
    last = moves.groupBy("path").agg(F.max(F.struct("version", "op")).alias("last"), F.max(F.when(F.col("op") == "save", F.col("version"))).alias("saved_version"), F.max(F.when(F.col("op").isin("open", "change"), F.col("version"))).alias("live_version"))
    open_ = last.filter("last.op <> 'close'")
    return open_.select("path", F.col("last.version").alias("version"), "saved_version", F.coalesce(F.col("live_version") > F.coalesce("saved_version", F.lit(-1)), F.lit(False)).alias("is_dirty"))


def late_events(events: DataFrame) -> DataFrame:
    """L.2: events that arrive (ts) after one of a higher version of their path."""
    before = Window.partitionBy("path").orderBy("ts", "version").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_top", F.max("version").over(before)).filter(F.col("version") < F.col("_top")).drop("_top")


def debounced(events: DataFrame, quiet_seconds: float) -> DataFrame:
    """L.7: triggers after which their path is quiet for so long, or for good."""
    order = Window.partitionBy("path").orderBy("ts", "version")
    gap = F.unix_micros(F.lead("ts").over(order).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return events.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") >= int(quiet_seconds * 1_000_000))).drop("_gap")


def debounced_with_flush(events: DataFrame, quiet_seconds: float) -> DataFrame:
    """L.7, L.8: path, op, ts, fired_at of what fires: each flush at once, and each trigger after a quiet time without another
    event of its path, or for good; several triggers of one moment are one. op: flush, anything else is a trigger."""
    quiet = int(quiet_seconds * 1_000_000)
    flush = F.coalesce(F.col("op") == "flush", F.lit(False)).alias("_flush")
    rows = events.filter("path is not null and ts is not null").select("path", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"), flush)
    gap = F.lead("_at").over(Window.partitionBy("path").orderBy("_at", "_flush")) - F.col("_at")
    some = rows.withColumn("_gap", gap).filter(F.col("_flush") | F.col("_gap").isNull() | (F.col("_gap") >= quiet))
    fired_at = F.col("_at") + F.when(F.col("_flush"), 0).otherwise(quiet)
    return some.select("path", F.when(F.col("_flush"), "flush").otherwise("trigger").alias("op"), F.timestamp_micros("_at").alias("ts"), F.timestamp_micros(fired_at).alias("fired_at"))


def overlay(files: DataFrame, dirty: DataFrame) -> DataFrame:
    """L.4: files with the dirty ones (file_id, text) in their place."""
    kept = files.join(dirty.select("file_id"), "file_id", "left_anti").select("file_id", "text", F.lit(False).alias("is_dirty"))
    return kept.unionByName(dirty.select("file_id", "text", F.lit(True).alias("is_dirty")))


def still_current(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """L.6: queries whose (path, version) is still the document's."""
    return queries.join(documents.select("path", "version"), ["path", "version"], "left_semi")


def publication_plan(previous: DataFrame, current: DataFrame, dirty: DataFrame) -> DataFrame:
    """A.14: per path publish, clear (no longer mentioned) or hold (dirty); previous and current: path, n."""
    both = previous.select("path", F.col("n").alias("_old")).join(current.select("path", "n"), "path", "full_outer")
    held = both.join(dirty.select("path", F.lit(True).alias("_dirty")).distinct(), "path", "left")
    action = F.when(F.col("_dirty"), "hold").when(F.col("n").isNull(), "clear").otherwise("publish")
    return held.select("path", action.alias("action"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def latest_generation(runs: DataFrame) -> DataFrame:
    """L.14: rows of each path's newest run."""
    top = runs.groupBy("path").agg(F.max("run").alias("run"))
    return runs.join(top, ["path", "run"], "left_semi")


def rebuild_set(changed: DataFrame, reverse: DataFrame) -> DataFrame:
    """L.9, L.12: packages to rebuild: the changed ones and all that depend on them (reverse: root, package_slot)."""
    up = reverse.join(changed.select(F.col("package_slot").alias("root")), "root", "left_semi").select("package_slot")
    return up.unionByName(changed.select("package_slot")).distinct()


def graph_changed(saved: DataFrame, manifests: DataFrame, roots: DataFrame) -> DataFrame:
    """L.10: saved paths that ask for a full rebuild: lockfile, a known or new member manifest, a target root."""
    name = F.element_at(F.split("path", "/"), -1)
    known = saved.join(manifests.select("path", F.lit("manifest").alias("_a")), "path", "left").join(roots.select("path", F.lit("root").alias("_b")), "path", "left")
    reason = F.when(name == "Cargo.lock", "lockfile").when(F.col("_a").isNotNull(), "manifest").when(name == "Cargo.toml", "new_manifest").when(F.col("_b").isNotNull(), "target_root")
    return known.select("path", reason.alias("reason")).filter("reason is not null")
