"""Scopes, visibility, imports and path resolution (C.9-C.11, D.9-D.22).

Bindings: module_id, name, ns (t, v or m), def_id, visibility (public, crate, private, super, restricted), owner (the
module that the visibility is relative to), origin (own or import). Imports: import_id, module_id, kind (named, self,
glob), source (module the path leads to), item (name taken, null for globs), binding (new name, '_' hides it), visibility.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import rounds

BINDING = ["module_id", "name", "ns", "def_id", "visibility", "owner", "origin"]


def visible_to(pairs: DataFrame, module_info: DataFrame, ancestors: DataFrame) -> DataFrame:
    """C.9: rows of pairs (importer plus a binding's visibility and owner) that the importer may see.

    module_info: module_id, target_id, parent_id. One left join finds whether the importer lies inside the anchor.
    """
    info = module_info.select(F.col("module_id").alias("_m"), "target_id", "parent_id")
    p = pairs.join(info.select(F.col("_m").alias("importer"), F.col("target_id").alias("_it")), "importer")
    p = p.join(info.select(F.col("_m").alias("owner"), F.col("target_id").alias("_ot"), F.col("parent_id").alias("_op")), "owner", "left")
    anchor = F.when(F.col("visibility").isin("private", "self", "restricted"), F.col("owner")).when(F.col("visibility") == "super", F.col("_op"))
    p = p.withColumn("_anchor", anchor)
    inside = ancestors.select(F.col("module_id").alias("importer"), F.col("ancestor_id").alias("_anchor"), F.lit(True).alias("_in"))
    p = p.join(inside, ["importer", "_anchor"], "left")
    same = F.col("_it") == F.col("_ot")
    seen = (F.col("visibility") == "public") | (same & ((F.col("visibility") == "crate") | F.coalesce("_in", F.lit(False))))
    return p.filter(seen).select(*pairs.columns)


def import_round(bindings: DataFrame, base: DataFrame, imports: DataFrame, module_info: DataFrame, ancestors: DataFrame) -> DataFrame:
    """D.16-D.18, D.22: base scopes and what every import binds when sources look as in bindings.

    A named import keeps its own visibility and module as owner; a glob copies all visible names; `_` adds none; a self
    import is a named one of the module. Glob copies never hide a name that the module has otherwise.
    """
    source = bindings.select(F.col("module_id").alias("source"), F.col("name").alias("item"), "ns", "def_id", "visibility", "owner")
    imp = imports.select("import_id", F.col("module_id").alias("importer"), "kind", "source", F.col("item").alias("_item"), "binding", F.col("visibility").alias("_vis"))
    joined = imp.join(source, "source").filter(F.col("kind").isin("glob") | (F.col("_item") == F.col("item")))
    seen = visible_to(joined, module_info, ancestors).filter("binding is null or binding <> '_'")
    made = seen.select(
        F.col("importer").alias("module_id"), F.when(F.col("kind") == "glob", F.col("item")).otherwise(F.coalesce("binding", "item")).alias("name"), "ns", "def_id",
        F.col("_vis").alias("visibility"), F.col("importer").alias("owner"), F.when(F.col("kind") == "glob", "glob").otherwise("import").alias("origin"),
    )
    direct = base.unionByName(made.filter("origin = 'import'"))
    globs = made.filter("origin = 'glob'").join(direct.select("module_id", "name", "ns"), ["module_id", "name", "ns"], "left_anti")
    return direct.unionByName(globs).select(BINDING).distinct()


def import_fixpoint(base: DataFrame, imports: DataFrame, module_info: DataFrame, ancestors: DataFrame, most_rounds: int = 128) -> DataFrame:
    """D.19: scopes derived anew from base and imports until a round changes nothing; a later import may undo an earlier one."""
    return rounds(base.select(BINDING), lambda now: import_round(now, base.select(BINDING), imports, module_info, ancestors), most_rounds)


def unresolved_imports(imports: DataFrame, bindings: DataFrame) -> DataFrame:
    """D.20: named imports whose item the source module lacks, and globs of modules that do not exist as a source."""
    named = imports.filter("kind <> 'glob'").join(bindings.select(F.col("module_id").alias("source"), F.col("name").alias("item")), ["source", "item"], "left_anti")
    globs = imports.filter("kind = 'glob'").join(bindings.select(F.col("module_id").alias("source")).distinct(), "source", "left_anti")
    return named.select("import_id").unionByName(globs.select("import_id"))


def first_segment(uses: DataFrame, scopes: DataFrame, extern_roots: DataFrame, prelude: DataFrame) -> DataFrame:
    """D.10: module scope hides extern roots, which hide the prelude; several definitions of the winning place stay.

    uses: use_id, module_id, target_id, name, absolute. Absolute paths look at extern roots only. The winning place is found
    by the names alone; only then a use meets its definitions, whose rows are not shuffled again. Rows of one use_id count as
    its alternatives; of those alone the definitions are made distinct.
    """
    places = [(scopes, "module_id"), (extern_roots, "target_id"), (prelude, "target_id")]
    asked = uses.select("use_id", "module_id", "target_id", "name", "absolute")
    for k, (defs, at) in enumerate(places):
        asked = asked.join(defs.select(at, "name").distinct().withColumn(f"_has{k}", F.lit(True)), [at, "name"], "left")
    place = F.when(F.col("_has0") & ~F.col("absolute"), 0).when(F.col("_has1"), 1).when(F.col("_has2") & ~F.col("absolute"), 2)
    one = Window.partitionBy("use_id")
    won = asked.withColumn("priority", place).filter("priority is not null").withColumns({"_first": F.min("priority").over(one), "_n": F.count(F.lit(1)).over(one)}).filter("priority = _first")

    def met(some: DataFrame) -> DataFrame:
        each = [some.filter(F.col("priority") == k).join(defs.select(at, "name", "def_id").distinct(), [at, "name"]) for k, (defs, at) in enumerate(places)]
        return reduce(DataFrame.unionByName, (e.select("use_id", "def_id", "priority") for e in each))

    return met(won.filter("_n = 1")).unionByName(met(won.filter("_n > 1")).distinct())


def resolve_paths(paths: DataFrame, bindings: DataFrame, module_defs: DataFrame, most_segments: int = 32, longest: int | None = None) -> DataFrame:
    """D.9, D.11: paths (path_id, module_id, segments) walked left to right; one join a segment for all paths at once.

    Prefix segments go through modules only (module_defs: def_id, module); the last one takes any namespace. Returns
    path_id, def_id (null if unresolved) and unresolved_at, the first segment that led nowhere; a path of more than
    most_segments is unresolved there. Rows of one path_id count as its alternatives: those that lead somewhere are kept,
    if none does the one that came farthest. longest: a bound of the number of segments, counted if not given.
    """
    n = F.size("segments")
    if longest is None:
        longest = paths.agg(F.max(n)).first()[0] or 0
    at = F.when(n > most_segments, F.lit(most_segments)).when(n == 0, F.lit(0))
    now = paths.select("path_id", "module_id", "segments", F.lit(None).cast(bindings.schema["def_id"].dataType).alias("def_id"), at.alias("unresolved_at"))
    to = module_defs.select(F.col("def_id").alias("_hit"), F.col("module").alias("_m"))
    scope = bindings.select(F.col("module_id").alias("_in"), F.col("name").alias("_name"), (F.col("ns") == "t").alias("_t"), F.col("def_id").alias("_hit")).distinct().join(to, "_hit", "left")
    for k in range(min(longest, most_segments)):
        # Paths that ended keep their module and ask for no name, so they stay spread over the tasks of the join.
        here = now.withColumn("_want", F.when((n > k) & F.col("unresolved_at").isNull(), F.get("segments", F.lit(k))))
        last = n == k + 1
        met = here.join(scope, (F.col("module_id") == F.col("_in")) & (F.col("_want") == F.col("_name")) & (last | F.col("_t")), "left")
        lost = F.when(F.col("_want").isNull(), F.col("unresolved_at")).when(F.col("_hit").isNull(), F.lit(k)).when(~last & F.col("_m").isNull(), F.lit(k + 1))
        now = met.select("path_id", F.coalesce("_m", "module_id").alias("module_id"), "segments", F.when(F.col("_want").isNotNull() & last, F.col("_hit")).otherwise(F.col("def_id")).alias("def_id"), lost.alias("unresolved_at"))
    ends = now.groupBy("path_id").agg(F.collect_set("def_id").alias("_defs"), F.max("unresolved_at").alias("_at"))
    return ends.select("path_id", F.explode_outer("_defs").alias("def_id"), "_at").withColumn("unresolved_at", F.when(F.col("def_id").isNull(), F.col("_at"))).drop("_at")
