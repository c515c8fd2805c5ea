"""References and their scopes (I.3, I.10-I.12, N.4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def references(subjects: DataFrame, sites: DataFrame, include_declarations: bool = False, scope: DataFrame | None = None) -> DataFrame:
    """I.10: sites whose entity is a subject (entity_id), sorted by place, each once.

    The entity join is a semi-join on one key; scope (any of package_slot, file_id) prunes sites before it.
    """
    some = sites if include_declarations else sites.filter("not is_declaration")
    if scope is not None:
        some = some.join(scope, scope.columns, "left_semi")
    found = some.join(subjects.select("entity_id"), "entity_id", "left_semi")
    place = ["package_slot", "file_id", "span_start", "span_end"]
    return found.select(*place, "entity_id").distinct().orderBy(*place, "entity_id")


def search_surface(packages: DataFrame, origin: str, declaring: DataFrame, reverse: DataFrame) -> DataFrame:
    """I.12: packages to search. From workspace files: all workspace members; from dependencies: the declaring packages
    and all that depend on them (reverse: root, package_slot)."""
    if origin == "workspace":
        return packages.filter("is_workspace_member").select("package_slot")
    up = reverse.join(declaring.select(F.col("package_slot").alias("root")), "root", "left_semi").select("package_slot")
    return up.unionByName(declaring.select("package_slot")).distinct()
