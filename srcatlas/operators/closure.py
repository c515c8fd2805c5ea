"""Dependency closures, subsets and file contexts (C.11-C.13, D.23-D.28, M.3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import closure


def reverse_dependency_closure(roots: DataFrame, dependencies: DataFrame) -> DataFrame:
    """D.23: (root, package_slot) for the roots and all packages that transitively depend on them."""
    edges = dependencies.select(F.col("dep_slot").alias("_at"), F.col("package_slot").alias("_next")).distinct()
    seed = roots.select(F.col("package_slot").alias("root"), "package_slot")
    return closure(seed, lambda now: now.join(edges, F.col("package_slot") == F.col("_at")).select("root", F.col("_next").alias("package_slot")))


def dependency_applies(target_kind: Column) -> Column:
    """C.12: which dependencies a target uses: build scripts build ones, examples, tests and benches normal or dev ones."""
    return F.when(target_kind == "build", F.col("is_build")).when(target_kind.isin("example", "test", "bench"), F.col("is_normal") | F.col("is_dev")).otherwise(F.col("is_normal"))


def visible_dependency_closure(targets: DataFrame, dependencies: DataFrame) -> DataFrame:
    """D.24: (package_slot, kind, visible): the first hop goes by the target's kind, later hops by normal dependencies."""
    first = targets.join(dependencies, "package_slot").filter(dependency_applies(F.col("kind"))).select("package_slot", "kind", F.col("dep_slot").alias("visible"))
    own = targets.select("package_slot", "kind", F.col("package_slot").alias("visible"))
    normal = dependencies.filter("is_normal").select(F.col("package_slot").alias("_at"), F.col("dep_slot").alias("_next")).distinct()
    reached = closure(first, lambda now: now.join(normal, F.col("visible") == F.col("_at")).select("package_slot", "kind", F.col("_next").alias("visible")))
    return own.unionByName(reached).distinct()


def ancestors(modules: DataFrame) -> DataFrame:
    """C.11: (module_id, ancestor_id), every module being its own ancestor."""
    up = modules.filter("parent_id is not null").select(F.col("module_id").alias("_at"), F.col("parent_id").alias("_next"))
    seed = modules.select("module_id", F.col("module_id").alias("ancestor_id"))
    return closure(seed, lambda now: now.join(up, F.col("ancestor_id") == F.col("_at")).select("module_id", F.col("_next").alias("ancestor_id")))


def targets_for_file(module_files: DataFrame, files: DataFrame) -> DataFrame:
    """D.27: targets whose module tree (package_slot, target_id, file_id) touches a file."""
    return module_files.join(files.select("file_id"), "file_id", "left_semi").select("package_slot", "target_id", "file_id").distinct()


def exact_subset(rows: DataFrame, packages: DataFrame) -> DataFrame:
    """D.26, M.3: rows of the listed packages; the semi-join prunes partitions of a table laid out by package."""
    return rows.join(packages.select("package_slot"), "package_slot", "left_semi")
