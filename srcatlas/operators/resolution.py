"""What names of real code mean (D.4-D.6, D.13, D.15, D.19, F.2, F.5, F.6, G.8-G.12, H.17-H.19): joins over the code tables.

Ids are strings: `file:item` for an item or an inline module, `file:` for the module that a file is, `file:place` for fields,
variants, parameters and let bindings. Types act as modules of their variants and associated items, so one path walk serves
`a::b`, `E::A` and `T::new`. A name that the rules cannot follow (generic arguments inside a path, results of calls, macros)
has no definition; none is guessed by spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import durable
from ..plans.fixpoint import rounds
from ..plans.interval import points_in_spans
from . import binders, brackets, imports, lexing, scopes
from .closure import ancestors

# How a written visibility is called in scopes.
VISIBILITY = {"pub": "public", "crate": "crate", "pub(crate)": "crate", "pub(incrate)": "crate", "pub(super)": "super", "pub(insuper)": "super"}
TYPES = ["struct", "enum", "union", "trait", "type_alias"]
#: Kinds whose names in a pattern are values to compare with, not binders.
CONSTANTS = ["const", "static", "enum_variant", "struct"]


def key(file: str, place: str | None = None) -> Column:
    return F.concat(F.col(file).cast("string"), F.lit(":"), F.col(place).cast("string") if place else F.lit(""))


def modules(files: DataFrame, items: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D.4: module_id, parent_id, target_id (the module at the root), file_id, span_start, span_end of files and
    inline modules; and each module's ancestors."""
    whole = files.select("file_id", key("file_id").alias("module_id"), F.lit(0).cast("long").alias("span_start"), F.octet_length("text").cast("long").alias("span_end"))
    inline = items.filter("kind = 'module' and is_inline").select("file_id", key("file_id", "item_id").alias("module_id"), "span_start", "span_end")
    spans = whole.unionByName(inline)
    # A module's place is its first byte; what is around that is its parent. Linked files lie where they are declared.
    places = inline.select("module_id", "file_id", F.col("span_start").alias("at")).unionByName(links.select(key("module_file").alias("module_id"), "file_id", F.col("item_id").alias("at")))
    up = points_in_spans(places, spans.withColumnRenamed("module_id", "_around"), ["file_id"], at="at", closed=False).filter("_around <> module_id").groupBy("module_id").agg(F.max_by("_around", F.struct("span_start", -F.col("span_end"))).alias("parent_id"))
    tree = durable(spans.join(up, "module_id", "left"), "modules")
    over = durable(ancestors(tree), "ancestors")
    roots = over.join(tree.filter("parent_id is null").select(F.col("module_id").alias("ancestor_id")), "ancestor_id").select("module_id", F.col("ancestor_id").alias("target_id"))
    return tree.join(roots, "module_id"), over


def in_module(points: DataFrame, mods: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """C.6, F.6: points (keys name one) with the innermost module around them."""
    spans = mods.select("file_id", F.col("module_id").alias("_m"), "span_start", "span_end")
    named = points.select("file_id", F.struct(*keys).alias("_k"), F.col(at).alias("_at"))
    best = points_in_spans(named, spans, ["file_id"], at="_at", closed=False).groupBy("_k").agg(F.max_by("_m", F.struct("span_start", -F.col("span_end"))).alias("module_id"))
    return points.join(best.select("_k.*", "module_id"), keys)


def owners(points: DataFrame, items: DataFrame, at: str) -> DataFrame:
    """F.6: file_id, at, owner: the innermost function around each place."""
    spans = items.filter("kind = 'function'").select("file_id", F.col("item_id").alias("_f"), "span_start", "span_end")
    inside = points_in_spans(points.select("file_id", F.col(at).alias("_at")).distinct(), spans, ["file_id"], at="_at", closed=False)
    return inside.groupBy("file_id", F.col("_at").alias(at)).agg(F.max_by("_f", "span_start").alias("owner"))


def locals_of(names: DataFrame, lets: DataFrame, pieces: DataFrame, items: DataFrame) -> DataFrame:
    """G.4, G.5, G.8, H.17: file_id, name, name_start, kind, def_id, ty, type_path, owner, span_start, span_end: names that
    patterns bind and items of bodies, with the span in which they can be named. owner: the function that a binder belongs to;
    an item, which functions inside can name too, has none."""
    first = names.filter("at = first_at").withColumn("name_start", F.col("at"))
    seeds = lets.select("file_id", F.col("span_start").alias("name_start"), F.col("ty").alias("_let"))
    whole = (F.col("at") + F.octet_length("name") == F.col("to_at")) & (F.startswith("text", F.col("name")) | F.startswith("text", F.lit("mut ")))
    given = pieces.filter("ordinal is not null").select("file_id", "from_at", "to_at", "text", F.col("ty").alias("_ty"), F.col("type_path").alias("_path"))
    typed = first.filter("source = 'parameter'").join(given, ["file_id", "from_at"]).filter(whole).select("file_id", "name_start", "_ty", "_path")
    both = first.join(seeds, ["file_id", "name_start"], "left").join(typed, ["file_id", "name_start"], "left")
    word = F.when(F.rlike("_let", F.lit(r"^(?:r#)?[\p{L}_][\p{L}\p{N}_]*+$")), F.array("_let"))
    bound = both.select(
        "file_id", "name", "name_start", F.when(F.col("source") == "parameter", "parameter").otherwise("local").alias("kind"), F.coalesce("_ty", "_let", F.lit("unknown")).alias("ty"),
        F.coalesce("_path", F.when(F.col("_let") != "unknown", word)).alias("type_path"), F.col("scope_start").alias("span_start"), F.col("scope_end").alias("span_end"),
    )
    # Later alternatives of a pattern name what the first one binds.
    later = names.filter("at <> first_at").select("file_id", "name", F.col("first_at").alias("name_start"), F.lit("alternative").alias("kind"), F.lit(None).cast("string").alias("ty"), F.lit(None).cast("array<string>").alias("type_path"), F.col("at").alias("span_start"), (F.col("at") + 1).alias("span_end"))
    every = bound.unionByName(later).withColumn("def_id", key("file_id", "name_start"))
    every = every.join(owners(every, items, "name_start"), ["file_id", "name_start"], "left")
    around = items.filter("kind = 'function'").select("file_id", F.col("item_id").alias("parent_id"), F.col("span_start").alias("_s"), F.col("span_end").alias("_e"))
    inner = items.filter("parent_kind = 'function' and name is not null").join(around, ["file_id", "parent_id"]).select("file_id", "name", "name_start", "kind", F.col("_s").alias("span_start"), F.col("_e").alias("span_end"), key("file_id", "item_id").alias("def_id"))
    return every.unionByName(inner, allowMissingColumns=True)


def path_sites(toks: DataFrame) -> DataFrame:
    """H.6-H.9: file_id, span_start, span_end, name, segments (the path up to here), absolute, receiver and ns_hint of every
    identifier. receiver is null unless a dot stands before, and empty when what is before the dot is no plain name."""
    order = Window.partitionBy("file_id").orderBy("n")
    near = brackets.structure(toks).withColumns({f"p{k}": F.lag("token", k).over(order) for k in (1, 2, 3)} | {f"k{k}": F.lag("kind", k).over(order) for k in (2, 3)})
    two = (F.col("p1") == ":") & (F.col("p2") == ":")
    joined = F.coalesce(two & (F.col("k3") == "ident"), F.lit(False))
    label = (F.col("next") == ":") & (F.col("next2") != ":") & F.col("p1").isin("{", ",")
    # Fields of tuples are numbers after a dot.
    some = near.filter("kind = 'ident' or (kind = 'number' and p1 = '.' and token not like '%.%')").withColumns({"_two": F.coalesce(two, F.lit(False)), "_joined": joined, "name": F.regexp_replace("token", "^r#", ""), "is_label": F.coalesce(label, F.lit(False))})
    some = some.withColumn("_chain", F.sum((~joined).cast("int")).over(order))
    chain = Window.partitionBy("file_id", "_chain").orderBy("n")
    dot = (F.col("p1") == ".") & (F.coalesce("p2", F.lit("")) != ".")
    plain = (F.col("k2") == "ident") & ~F.coalesce("p3", F.lit("")).isin(".", ":")
    hint = F.when(F.col("next") == "!", "m").when((F.col("next") == ":") & (F.col("next2") == ":"), "t").when(F.col("next") == "(", "v")
    some = some.withColumns({"segments": F.collect_list("name").over(chain), "absolute": F.first("_two").over(chain), "_odd": F.first(F.col("_two") & (F.col("p3") == ">")).over(chain), "receiver": F.when(dot, F.when(plain, F.col("p2")).otherwise("")), "ns_hint": hint})
    return some.filter("not coalesce(_odd, false)").select("file_id", "span_start", "span_end", "name", "segments", "absolute", "receiver", "ns_hint", "is_label")


class Names:
    """The resolved names of one revision; every table is written once and joined by what asks."""

    def __init__(self, files: DataFrame, toks: DataFrame, items: DataFrame, links: DataFrame, lets: DataFrame, impls: DataFrame, extern_roots: DataFrame | None = None):
        """extern_roots: file_id, name, root_file: in the crate whose root is file_id, name leads to the crate of root_file (D.6, D.7)."""
        self.toks, self.items, self.has_extern = toks, items, extern_roots is not None
        mods, self.ancestors = modules(files, items, links)
        self.modules = durable(mods, "modules")
        self.pieces = durable(binders.function_parts(toks, items), "pieces")
        self.heads = binders.heads_of(self.pieces)
        self.sites = durable(path_sites(toks), "sites")
        named = items.filter("name is not null")
        variants = scopes.enum_variants(toks, items).withColumn("kind", F.lit("enum_variant"))
        fields = scopes.struct_fields(toks, items).withColumn("kind", F.lit("field"))
        owned = variants.drop("index").unionByName(fields.drop("ordinal", "ty", "type_path"))
        whole = self.modules.filter("module_id like '%:'").select(F.col("module_id").alias("def_id"), "file_id", F.lit(None).cast("long").alias("item_id"), F.lit("module").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("name_start"))
        own = named.select(key("file_id", "item_id").alias("def_id"), "file_id", "item_id", "kind", "name", "name_start")
        small = owned.select(key("file_id", "name_start").alias("def_id"), "file_id", F.col("name_start").alias("item_id"), "kind", "name", "name_start")
        self.definitions = durable(own.unionByName(small).unionByName(whole), "definitions")
        self.owned = durable(owned.select(key("file_id", "type_id").alias("module_id"), "name", key("file_id", "name_start").alias("def_id"), "kind"), "owned")
        self._scopes(extern_roots, links)
        self.locals = durable(locals_of(self._binders(), lets, self.pieces, items), "locals")
        bound = self.locals.filter("kind in ('local', 'parameter')").select("def_id", "file_id", F.col("name_start").alias("item_id"), "kind", "name", "name_start")
        self.definitions = durable(self.definitions.unionByName(bound.distinct()), "definitions")
        self._members(impls)

    def _binders(self) -> DataFrame:
        """G.3: names in patterns that bind: not those that the module's scope knows as constants, unit types or variants,
        nor unknown ones in capitals."""
        names = binders.pattern_names(self.toks, binders.patterns(self.toks, self.pieces, self.items))
        placed = in_module(names, self.modules, "at", ["file_id", "at"])
        values = self.scopes.filter("ns = 'v'").join(self.definitions.filter(F.col("kind").isin(*CONSTANTS)).select("def_id"), "def_id", "left_semi").select("module_id", "name").distinct()
        return placed.join(values, ["module_id", "name"], "left_anti").filter(~binders.constant(F.col("name")))

    def _scopes(self, extern_roots: DataFrame | None, links: DataFrame) -> None:
        """D.1-D.6, D.15-D.19, D.21: the scopes of all modules after every import; a written table, so they are frozen."""
        mods, items = self.modules, self.items
        known = F.create_map(*[F.lit(x) for pair in VISIBILITY.items() for x in pair])
        shown = lambda c: F.coalesce(known[c], F.when(F.startswith(c, F.lit("pub(in")), "restricted"), F.lit("private"))
        base = scopes.base_bindings(items).select(F.when(F.col("module_id").isNull(), key("file_id")).otherwise(key("file_id", "module_id")).alias("module_id"), "name", "ns", key("file_id", "def_id").alias("def_id"), shown(F.col("visibility")).alias("visibility"), F.col("visibility").alias("_written"))
        variants = self.owned.filter("kind = 'enum_variant'").select("module_id", "name", F.explode(F.array(F.lit("t"), F.lit("v"))).alias("ns"), "def_id", F.lit("public").alias("visibility"), F.lit(None).cast("string").alias("_written"))
        extern = mods.sparkSession.createDataFrame([], "module_id string, name string, ns string, def_id string")
        if extern_roots is not None:
            extern = extern_roots.select(F.concat(F.lit("extern:"), key("file_id")).alias("module_id"), "name", F.lit("t").alias("ns"), key("root_file").alias("def_id"))
        extern = extern.withColumns({"visibility": F.lit("public"), "_written": F.lit(None).cast("string")})
        base = base.unionByName(variants).unionByName(extern).withColumns({"owner": F.col("module_id"), "origin": F.lit("own")})
        word = lambda name, to: mods.filter(F.col(to).isNotNull()).select("module_id", F.lit(name).alias("name"), F.lit("t").alias("ns"), F.col(to).alias("def_id"))
        self.words = durable(word("self", "module_id").unionByName(word("super", "parent_id")).unionByName(word("crate", "target_id")), "words")
        linked = links.select(key("file_id", "item_id").alias("def_id"), key("module_file").alias("module"))
        types = self.definitions.filter(F.col("kind").isin(*TYPES)).select("def_id", F.col("def_id").alias("module"))
        self.module_defs = durable(mods.select(F.col("module_id").alias("def_id"), F.col("module_id").alias("module")).unionByName(linked).unionByName(types), "module_defs")
        # pub(in path): the module that the path leads to owns the visibility.
        inside = base.filter("visibility = 'restricted'").select("module_id", "_written").distinct()
        inside = inside.select(F.concat_ws("|", "module_id", "_written").alias("path_id"), "module_id", "_written", F.split(F.regexp_extract("_written", r"^pub\(in(.*)\)$", 1), "::").alias("segments"))
        led = self.walked(inside.withColumn("absolute", F.lit(False)), base).join(self.module_defs, "def_id").join(inside.select("path_id", "module_id", "_written"), "path_id").groupBy("module_id", "_written").agg(F.min("module").alias("_anchor"))
        self.base = durable(base.join(led, ["module_id", "_written"], "left").withColumn("owner", F.coalesce("_anchor", "owner")).select(imports.BINDING), "base")
        leaves = lexing.use_leaves(items, self.toks).withColumn("_leaf", F.concat_ws("|", F.array_join("segments", "::"), F.coalesce("binding", F.lit("")), "import_kind"))
        placed = in_module(leaves, mods, "item_id", ["file_id", "item_id", "_leaf"])
        glob = F.col("import_kind") == "glob"
        last = F.get("segments", F.size("segments") - 1)
        n = F.size("segments") - F.when(glob, 0).otherwise(1)
        self.leaves = durable(placed.select(
            F.concat_ws("|", key("file_id", "item_id"), "_leaf").alias("import_id"), "file_id", "item_id", "module_id", F.col("import_kind").alias("kind"), "segments", "absolute", F.slice("segments", F.lit(1), n).alias("source_path"),
            F.when(~glob, last).alias("item"), F.when(~glob, F.coalesce("binding", last)).alias("binding"), shown(F.col("visibility")).alias("visibility"),
        ).distinct(), "leaves")
        info = mods.select("module_id", "target_id", "parent_id")
        self.deepest = self.leaves.agg(F.max(F.size("source_path"))).first()[0] or 0
        self.scopes = rounds(self.base, lambda now: imports.import_round(now, self.base, self.imports(now), info, self.ancestors))

    def imports(self, now: DataFrame) -> DataFrame:
        """D.5, D.16: the imports with the module that each one's path leads to when scopes are as in now."""
        paths = self.leaves.select(F.col("import_id").alias("path_id"), "module_id", F.col("source_path").alias("segments"), "absolute", F.col("item").alias("_first"))
        led = self.walked(paths.filter(F.size("segments") > 0), now, self.deepest).join(self.module_defs, "def_id").select(F.col("path_id").alias("import_id"), F.col("module").alias("source"))
        # use name; : the crate of that name, or what the module itself has.
        bare = self.started(paths.filter(F.size("segments") == 0).withColumn("segments", F.array("_first")), now).select(F.col("path_id").alias("import_id"), F.col("module_id").alias("source"))
        return self.leaves.join(led.unionByName(bare).distinct(), "import_id").select("import_id", "module_id", "kind", "source", "item", "binding", "visibility")

    def started(self, paths: DataFrame, now: DataFrame) -> DataFrame:
        """D.10: paths with the module to begin in: their own if it has the first name, else the crates beside theirs."""
        if not self.has_extern:
            return paths.filter("not absolute")
        has = now.select("module_id", "name").unionByName(self.words.select("module_id", "name")).distinct().select("module_id", F.col("name").alias("_n"), F.lit(True).alias("_has"))
        first = paths.withColumn("_n", F.get("segments", F.lit(0))).join(has, ["module_id", "_n"], "left").join(self.modules.select("module_id", "target_id"), "module_id", "left")
        begin = F.when((F.col("_has") & ~F.col("absolute")) | F.col("target_id").isNull(), F.col("module_id")).otherwise(F.concat(F.lit("extern:"), "target_id"))
        return first.withColumn("module_id", begin).drop("_n", "_has", "target_id")

    def walked(self, paths: DataFrame, now: DataFrame, longest: int | None = None) -> DataFrame:
        """D.9-D.13: path_id, def_id of the paths (path_id, module_id, segments, absolute) that lead somewhere."""
        scope = now.select("module_id", "name", "ns", "def_id").unionByName(self.words)
        return imports.resolve_paths(self.started(paths, now), scope, self.module_defs, longest=longest).filter("def_id is not null").select("path_id", "def_id")

    def _members(self, impls: DataFrame) -> None:
        """F.2, F.9-F.13, G.10, G.12: implementations with the types and traits they name, and the members of every type:
        fields, own functions, and those of its traits that no implementation of it gives."""
        heads = in_module(impls, self.modules, "impl_id", ["file_id", "impl_id"])
        side = lambda which: heads.filter(F.size(f"{which}_path") > 0).select(F.concat_ws("|", key("file_id", "impl_id"), F.lit(which)).alias("path_id"), "module_id", F.col(f"{which}_path").alias("segments"), F.lit(False).alias("absolute"))
        led = self.walked(side("self").unionByName(side("trait")), self.scopes).groupBy("path_id").agg(F.min("def_id").alias("d"))
        of = lambda which: led.select("path_id", F.col("d").alias(f"{which}_def"))
        with_ids = heads.withColumns({w: F.concat_ws("|", key("file_id", "impl_id"), F.lit(w)) for w in ("self", "trait")})
        self.impls = durable(with_ids.join(of("self").withColumnRenamed("path_id", "self"), "self", "left").join(of("trait").withColumnRenamed("path_id", "trait"), "trait", "left").select("file_id", "impl_id", "self_def", "trait_def", "is_negative"), "impls")
        ns = F.when(F.col("kind") == "type_alias", "t").otherwise("v")
        inner = self.items.filter("parent_kind in ('impl', 'trait') and name is not null").select("file_id", "parent_id", "parent_kind", "name", "kind", ns.alias("ns"), key("file_id", "item_id").alias("def_id"))
        own = inner.filter("parent_kind = 'impl'").join(self.impls.select("file_id", F.col("impl_id").alias("parent_id"), F.col("self_def").alias("module_id")), ["file_id", "parent_id"]).filter("module_id is not null").select("module_id", "name", "ns", "def_id", "kind")
        of_trait = inner.filter("parent_kind = 'trait'").select(key("file_id", "parent_id").alias("module_id"), "name", "ns", "def_id", "kind")
        links = self.impls.filter("self_def is not null and trait_def is not null and not is_negative").select(F.col("self_def").alias("_type"), F.col("trait_def").alias("module_id")).distinct()
        given = of_trait.join(links, "module_id").select(F.col("_type").alias("module_id"), "name", "ns", "def_id", "kind").join(own.select("module_id", "name"), ["module_id", "name"], "left_anti")
        self.associated = durable(own.unionByName(of_trait).unionByName(given).distinct(), "associated")
        self.members = durable(self.associated.drop("ns").unionByName(self.owned.select("module_id", "name", "def_id", "kind")).distinct(), "members")

    def _self_types(self, points: DataFrame) -> DataFrame:
        """file_id, span_start, _self: the type or trait whose implementation or body is around each point (file_id, span_start)."""
        spans = self.items.filter("kind in ('impl', 'trait')").select("file_id", F.col("item_id").alias("impl_id"), F.col("span_start").alias("_s"), "span_end", "kind")
        spans = spans.join(self.impls.select("file_id", "impl_id", "self_def"), ["file_id", "impl_id"], "left").select("file_id", F.col("_s").alias("span_start"), "span_end", F.when(F.col("kind") == "trait", key("file_id", "impl_id")).otherwise(F.col("self_def")).alias("_self"))
        return points_in_spans(points.select("file_id", F.col("span_start").alias("_at")), spans, ["file_id"], at="_at", closed=False).groupBy("file_id", "_at").agg(F.max_by("_self", "span_start").alias("_self")).withColumnRenamed("_at", "span_start")

    def local_at(self, points: DataFrame, name: str) -> DataFrame:
        """G.8: file_id, span_start with def_id, ty, type_path of the innermost local of that name whose scope holds the place."""
        found = points_in_spans(points.select("file_id", F.col("span_start").alias("_at"), F.col(name).alias("name")), self.locals.drop("kind"), ["file_id", "name"], at="_at", closed=False)
        # A function inside another one doesn't see that one's binders.
        near = owners(found, self.items, "_at").withColumnRenamed("owner", "_own")
        found = found.join(near, ["file_id", "_at"], "left").filter("owner is null or owner = _own")
        return found.groupBy("file_id", "_at").agg(F.max_by(F.struct("def_id", "ty", "type_path"), F.struct("span_start", "name_start")).alias("b")).select("file_id", F.col("_at").alias("span_start"), "b.*")

    def receiver_types(self, points: DataFrame, name: str) -> DataFrame:
        """H.18: file_id, span_start, type_def of the plain name (self or a local with a known type) at each place."""
        at = ["file_id", "span_start"]
        own = self._self_types(points.filter(F.col(name) == "self")).filter("_self is not null").select(*at, F.col("_self").alias("type_def"))
        typed = self.local_at(points.filter(F.col(name) != "self"), name).filter("type_path is not null")
        mine = typed.filter("get(type_path, 0) = 'Self'")
        in_impl = self._self_types(mine).filter("_self is not null").select(*at, F.col("_self").alias("type_def"))
        paths = in_module(typed.filter("get(type_path, 0) <> 'Self'"), self.modules, "span_start", at).select(F.struct(*at).alias("path_id"), "module_id", F.col("type_path").alias("segments"), F.lit(False).alias("absolute"))
        led = self.walked(paths, self.scopes).select("path_id.*", F.col("def_id").alias("type_def"))
        kinds = self.definitions.filter(F.col("kind").isin(*TYPES)).select(F.col("def_id").alias("type_def"))
        return own.unionByName(in_impl).unionByName(led).join(kinds, "type_def", "left_semi").distinct()

    def resolve(self, sites: DataFrame) -> DataFrame:
        """I.2, I.3: file_id, span_start, def_id of the sites (rows of path_sites): the definition that stands there, else the
        member after a dot, the local in scope, the leaf of a use item, or what the path leads to."""
        at = ["file_id", "span_start"]
        here = sites.join(self.definitions.filter("name is not null").select("file_id", F.col("name_start").alias("span_start"), "def_id"), at).select(*at, "def_id")
        dots = sites.filter("receiver is not null")
        member = self.receiver_types(dots.filter("receiver <> ''"), "receiver").join(dots.select(*at, "name", "ns_hint"), at).join(self.members.withColumnRenamed("module_id", "type_def"), ["type_def", "name"])
        member = member.filter((F.coalesce("ns_hint", F.lit("")) == "v") == (F.col("kind") == "function")).select(*at, "def_id")
        free = sites.filter("receiver is null and not is_label")
        local = self.local_at(free.filter(F.size("segments") == 1).filter("not absolute and not coalesce(ns_hint = 'm', false)"), "name").select(*at, "def_id")
        # use items: the name's place among a leaf's segments gives the path; a new name stands for all of it.
        uses = self.items.filter("kind = 'use'").select("file_id", "item_id", F.col("span_start").alias("_s"), "span_end").withColumnRenamed("_s", "span_start")
        in_use = points_in_spans(free.select("file_id", F.col("span_start").alias("_at"), "name"), uses, ["file_id"], at="_at").select("file_id", "item_id", F.col("_at").alias("span_start"), "name").join(self.leaves.select("file_id", "item_id", "module_id", "segments", "absolute", "binding"), ["file_id", "item_id"])
        place = F.when(F.array_contains("segments", F.col("name")), F.array_position("segments", F.col("name")).cast("int")).when(F.col("binding") == F.col("name"), F.size("segments"))
        led_use = in_use.withColumn("_n", place).filter("_n is not null").withColumn("segments", F.slice("segments", F.lit(1), F.col("_n"))).select(*at, "module_id", "segments", "absolute").distinct()
        led = in_module(free, self.modules, "span_start", at)
        mine = led.filter("get(segments, 0) = 'Self'")
        mine = mine.join(self._self_types(mine), at).filter("_self is not null")
        alone = mine.filter(F.size("segments") == 1).select(*at, F.col("_self").alias("def_id"))
        rest = mine.filter(F.size("segments") > 1).select(*at, F.col("_self").alias("module_id"), F.slice("segments", F.lit(2), F.size("segments") - 1).alias("segments"), F.lit(False).alias("absolute"))
        paths = led.filter("get(segments, 0) <> 'Self'").select(*at, "module_id", "segments", "absolute").unionByName(rest)
        reach = self.scopes.select("module_id", "name", "ns", "def_id").unionByName(self.associated.select("module_id", "name", "ns", "def_id"))
        both = durable(paths.withColumn("_use", F.lit(False)).unionByName(led_use.withColumn("_use", F.lit(True))).withColumn("path_id", F.struct(*at, "_use")), "paths")
        ends = self.walked(both, reach).select("path_id.*", "def_id")
        out = here.withColumn("_place", F.lit(0))
        for place, branch in enumerate((member, local, alone), 1):
            out = out.unionByName(branch.withColumn("_place", F.lit(place)))
        out = out.unionByName(ends.select(*at, "def_id", F.when(F.col("_use"), 4).otherwise(5).alias("_place")))
        out = out.withColumn("_first", F.min("_place").over(Window.partitionBy(*at))).filter("_place = _first").select(*at, "def_id").distinct()
        # A call, a path's prefix or a macro call picks the namespace where several definitions have the name.
        kinds = out.join(self.definitions.select("def_id", "kind"), "def_id").join(sites.select(*at, "ns_hint"), at)
        space = F.when(F.col("kind") == "macro", "m").when(F.col("kind").isin("module", "extern_crate", *TYPES[1:]), "t").otherwise("v")
        ranked = kinds.withColumn("_fits", F.when(F.col("ns_hint").isNull(), F.col("kind") != "macro").otherwise((space == F.col("ns_hint")) | ((F.col("kind") == "struct") & (F.col("ns_hint") != "m"))).cast("int"))
        best = F.max("_fits").over(Window.partitionBy(*at))
        return ranked.withColumn("_best", best).filter("_fits = _best and (ns_hint is null or (ns_hint = 'm') = (kind = 'macro'))").select(*at, "def_id")
