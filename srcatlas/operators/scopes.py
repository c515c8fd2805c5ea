"""Scopes, headers, members and cursor sites of real code tables (D.1-D.8, D.12-D.15, E.5-E.10, F.1-F.8, F.14, G.5, H.10-H.14, I.8).

Input are the token and item tables of lexing.py. Everything is windows over tokens and equi- or interval joins; what the
rules do not recognise is left out or unknown, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.asof import last_before
from ..plans.interval import points_in_spans
from ..plans.priority import first_of
from .brackets import as_written, in_order, next_sibling, parts, regions, structure
from .semantic import unique_or_unknown

# Namespaces that a definition of a kind enters.
NAMESPACES = {
    "struct": ["t", "v"], "union": ["t"], "enum": ["t"], "trait": ["t"], "type_alias": ["t"], "module": ["t"], "function": ["v"], "const": ["v"], "static": ["v"], "macro": ["m"], "extern_crate": ["t"],
}
# What happens to calls of built-in macros.
BUILTINS = {"include": "handle", "cfg_select": "handle", "concat_idents": "unsupported"} | dict.fromkeys("println print eprintln eprint format write writeln vec assert assert_eq assert_ne debug_assert panic todo unimplemented unreachable matches dbg env option_env concat stringify line column file module_path include_str include_bytes compile_error cfg".split(), "ignore")
# Types of literals.
LITERALS = [(r"^b\"|^br", "&[u8]"), (r"^c?r?#*\"", "&str"), (r"^b'", "u8"), (r"^'", "char"), (r"^(true|false)$", "bool"), (r"^[0-9].*(f32|f64)$", ""), (r"^[0-9][0-9_]*\.[0-9]", "f64"), (r"^[0-9].*(?:[iu](?:8|16|32|64|128|size))$", ""), (r"^[0-9]", "i32")]


def base_bindings(items: DataFrame) -> DataFrame:
    """D.1-D.3: direct bindings of named items: file_id, module_id (the inline module around, else null), name, ns, def_id, visibility.

    Members of impls, traits and bodies are no bindings; exported macros also enter the root scope as public ones.
    """
    ns = F.create_map(*[x for k, v in NAMESPACES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    top = items.filter("name is not null and (parent_kind is null or parent_kind = 'module')")
    return top.select("file_id", F.col("parent_id").alias("module_id"), "name", F.explode(F.coalesce(ns[F.col("kind")], F.array().cast("array<string>"))).alias("ns"), F.col("item_id").alias("def_id"), "visibility")


def implicit_extern_roots(targets: DataFrame, dependencies: DataFrame, applies: Column) -> DataFrame:
    """D.7: package_slot, target_id, name, root_slot: a package's own library for its other targets, then applicable
    dependencies; a later row of a name (dep_order) overwrites an earlier one."""
    lib = targets.filter("kind = 'lib'").select("package_slot", F.col("name").alias("_lib"))
    own = targets.filter("kind <> 'lib'").join(lib, "package_slot").select("package_slot", "target_id", F.regexp_replace("_lib", "-", "_").alias("name"), F.col("package_slot").alias("root_slot"), F.lit(-1).alias("dep_order"))
    deps = targets.join(dependencies, "package_slot").filter(applies).select("package_slot", "target_id", F.regexp_replace(dependencies["name"], "-", "_").alias("name"), F.col("dep_slot").alias("root_slot"), "dep_order")
    return own.unionByName(deps).groupBy("package_slot", "target_id", "name").agg(F.max_by("root_slot", "dep_order").alias("root_slot"))


def prelude_paths(targets: DataFrame) -> DataFrame:
    """D.8: the path of each target's prelude by its edition."""
    return targets.select("package_slot", "target_id", F.array(F.lit("std"), F.lit("prelude"), F.concat(F.lit("rust_"), F.coalesce("edition", F.lit("2015")))).alias("segments"), F.lit(True).alias("absolute"))


def only(resolved: DataFrame, defs: DataFrame, kinds: list[str]) -> DataFrame:
    """D.12-D.14, F.4: resolved paths (path_id, def_id) whose definition is of the kinds: types, modules, macros, traits."""
    return resolved.join(defs.filter(F.col("kind").isin(*kinds)).select("def_id", "kind"), "def_id")


def macro_definitions_for_calls(calls: DataFrame, textual: DataFrame, module_macros: DataFrame, extern_macros: DataFrame) -> DataFrame:
    """E.5, E.8, E.9: call_id, def_id: the last textual definition before the call, else the module's macros if they agree
    on one, else those of `macro_use` crates if they do. calls: call_id, file_id, module_id, target_id, name, n."""
    before = last_before(calls.select("call_id", "file_id", "name", "n"), textual.select("file_id", "name", F.col("n").alias("at"), "def_id"), ["file_id", "name"], "n", "at", ["def_id"], strict=True)
    first = before.filter("def_id is not null").select("call_id", "def_id")
    second = unique_or_unknown(calls.join(module_macros, ["module_id", "name"]).select("call_id", "def_id"), ["call_id"], "def_id").filter("is_known").drop("is_known")
    third = unique_or_unknown(calls.join(extern_macros, ["target_id", "name"]).select("call_id", "def_id"), ["call_id"], "def_id").filter("is_known").drop("is_known")
    return first_of([first, second, third], ["call_id"])


def macro_calls(toks: DataFrame) -> DataFrame:
    """E.10, E.11: calls name!(...) with what is done about them: ignore, handle, unsupported or expand."""
    known = F.create_map(*[F.lit(x) for pair in BUILTINS.items() for x in pair])
    near = structure(toks)
    called = near.filter((F.col("kind") == "ident") & (F.col("next") == "!") & F.col("next2").isin("(", "[", "{") & (F.col("token") != "macro_rules"))
    return called.select("file_id", "n", F.col("token").alias("name"), "span_start", F.coalesce(known[F.col("token")], F.lit("expand")).alias("disposition"))


def path_of(tokens: Column) -> Column:
    """The path that a type's tokens are (without those in brackets of any kind), after references and the like; else null."""
    bare = F.filter(tokens, lambda t: ~t.isin("&", "*", "mut", "dyn", "const", "impl") & ~F.startswith(t, F.lit("'")))
    names = F.filter(bare, lambda t: F.rlike(t, F.lit(r"^(?:r#)?[\p{L}_]")))
    joints = F.size(bare) - F.size(names)
    fits = (F.size(names) > 0) & ((joints == 2 * F.size(names) - 2) | (joints == 2 * F.size(names))) & F.forall(bare, lambda t: (t == ":") | F.rlike(t, F.lit(r"^(?:r#)?[\p{L}_]")))
    return F.when(fits, F.transform(names, lambda t: F.regexp_replace(t, "^r#", "")))


def impl_headers(items: DataFrame, toks: DataFrame) -> DataFrame:
    """F.2: file_id, impl_id, self_name, trait_name (null for inherent ones), is_negative, self_path, trait_path, from
    `impl<..> Trait for Type where ..`; generic arguments may nest as deep as they like."""
    near = structure(toks)
    starts = head_starts(near, items.filter("kind = 'impl'"), ("{", ";"))
    inside = regions(near, starts).filter("n > region.from_n")
    # Sides: before and after `for`; a where clause belongs to neither.
    order = Window.partitionBy("file_id", "region").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    flat = (F.col("angle") == 0) & (F.col("depth") == F.col("base"))
    for_ = (F.col("token") == "for") & flat & (F.col("next") != "<")
    side = F.sum(F.when((F.col("token") == "where") & flat, 2).when(for_, 1).otherwise(0)).over(order)
    split = inside.withColumn("_side", side).filter("_side < 2 and token <> 'for' and token <> 'where'")
    plain = flat & ~F.col("token").isin("<", ">")
    sides = split.groupBy("file_id", "region").agg(in_order(plain & (F.col("_side") == 0)).alias("a"), in_order(plain & (F.col("_side") == 1)).alias("b"), F.max("_side").alias("two"))
    sides = starts.select("file_id", "region").join(sides, ["file_id", "region"], "left")
    two = F.coalesce(F.col("two"), F.lit(0)) > 0
    a = F.filter("a", lambda t: t != "!")
    self_path, trait_path = path_of(F.when(two, F.col("b")).otherwise(a)), F.when(two, path_of(a))
    last = lambda c: F.when(c.isNotNull(), F.get(c, F.size(c) - 1)).otherwise("")
    trait_name = F.when(two, last(trait_path))
    return sides.select("file_id", F.col("region.item_id").alias("impl_id"), last(self_path).alias("self_name"), trait_name.alias("trait_name"), F.coalesce(F.get("a", F.lit(0)) == "!", F.lit(False)).alias("is_negative"), self_path.alias("self_path"), trait_path.alias("trait_path"))


def head_starts(near: DataFrame, items: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    """Regions from each item's word to the first of the tokens `ends` beside it: file_id, region (item_id, from_n), from_n, to_n, head_end."""
    stop = next_sibling(F.col("token").isin(*ends), F.struct("n", "span_start"))
    marked = near.select("file_id", "n", "open_n", "token", "span_start").withColumn("_stop", stop)
    found = marked.join(items.select("file_id", F.col("item_id").alias("span_start")), ["file_id", "span_start"])
    to = F.coalesce("_stop.n", F.col("n"))
    return found.select("file_id", F.struct(F.col("span_start").alias("item_id"), F.col("n").alias("from_n")).alias("region"), F.col("n").alias("from_n"), to.alias("to_n"), F.coalesce("_stop.span_start", "span_start").alias("head_end"))


def members(toks: DataFrame, items: DataFrame) -> DataFrame:
    """Parts of the bodies of structs, unions and enums: file_id, type_id, type_kind, ordinal, name, name_start, ty (as
    written), type_path. Fields of tuple structs are named by their places."""
    near = structure(toks)
    bodies = items.filter("kind in ('struct', 'union', 'enum')").select("file_id", F.col("item_id").alias("span_start"), F.col("kind").alias("type_kind"))
    # The head's first ( or { outside of generic arguments opens the body.
    heads = head_starts(near, items.filter("kind in ('struct', 'union', 'enum')"), ("{", ";"))
    in_head = regions(near, heads.withColumn("to_n", F.col("to_n") + 1))
    body = in_head.filter("angle = 0 and depth = base and token in ('(', '{')").groupBy("file_id", "region").agg(F.min(F.struct("n", "close_n", "token")).alias("_b"))
    starts = body.select("file_id", F.struct("region.item_id", F.col("_b.token").alias("open"), F.col("_b.n").alias("at")).alias("region"), F.col("_b.n").alias("from_n"), F.col("_b.close_n").alias("to_n")).filter("to_n is not null")
    inside = parts(regions(near, starts).filter("n > region.at"))
    # What stands before a field: attributes and visibility.
    deep = F.col("depth") - F.col("base")
    outer = (deep == 1) & (F.col("angle") == 0)
    limited = (F.col("token") == "(") & (F.col("prev") == "pub") & F.col("next").isin("crate", "super", "self", "in")
    attr = F.col("token").isin("#", "[") & ((F.col("token") == "#") | (F.col("prev") == "#"))
    mine = outer & ~attr & ~limited & (F.col("token") != "pub") & ~((F.col("token") == "crate") & (F.col("next") != ":"))
    first = F.min(F.when(mine, F.struct("n", "span_start", "token", "kind"))).over(Window.partitionBy("file_id", "region", "part"))
    told = inside.withColumn("_first", first).filter("n >= _first.n")
    of_type = (F.col("region.open") == "(") | (F.col("n") > F.col("colon"))
    plain = of_type & outer & ~F.col("token").isin("<", ">")
    ty = as_written(of_type)
    found = told.groupBy("file_id", "region", "part", "_first", "colon").agg(F.when(ty != "", ty).alias("ty"), path_of(in_order(plain)).alias("type_path"))
    kinds = bodies.select("file_id", F.col("span_start").alias("type_id"), "type_kind")
    rows = found.select("file_id", F.col("region.item_id").alias("type_id"), F.col("region.open").alias("open"), F.col("part").cast("int").alias("ordinal"), F.col("_first.token").alias("_t"), F.col("_first.kind").alias("_k"), F.col("_first.span_start").alias("name_start"), "colon", "ty", "type_path").join(kinds, ["file_id", "type_id"])
    is_tuple = F.col("open") == "("
    name = F.when(is_tuple, F.col("ordinal").cast("string")).otherwise(F.regexp_replace("_t", "^r#", ""))
    fits = is_tuple | ((F.col("_k") == "ident") & ((F.col("type_kind") == "enum") | F.col("colon").isNotNull()))
    return rows.filter(fits).select("file_id", "type_id", "type_kind", "ordinal", name.alias("name"), "name_start", "ty", "type_path")


def struct_fields(toks: DataFrame, items: DataFrame) -> DataFrame:
    """F.7: file_id, type_id, ordinal, name, name_start, ty, type_path of the fields of structs and unions, by name or place."""
    return members(toks, items).filter("type_kind <> 'enum'").drop("type_kind")


def enum_variants(toks: DataFrame, items: DataFrame) -> DataFrame:
    """F.8: file_id, type_id, index, name, name_start of enum variants."""
    return members(toks, items).filter("type_kind = 'enum'").select("file_id", "type_id", F.col("ordinal").alias("index"), "name", "name_start")


def signature_sites(toks: DataFrame, items: DataFrame) -> DataFrame:
    """F.14, F.15: file_id, item_id, name, span, site_kind: declared names and the type names before an item's body."""
    near = structure(toks).filter("kind = 'ident'").withColumnsRenamed({"span_start": "_from", "span_end": "_to", "kind": "_kind"})
    body = structure(toks).filter("token in ('{', ';', '=')").select("file_id", F.col("n").alias("_n"), F.col("span_start").alias("_body"), F.col("depth").alias("_depth"))
    starts = structure(toks).select("file_id", "span_start", F.col("depth").alias("_d"), F.col("n").alias("_start_n"))
    named = items.filter(F.col("kind").isin("function", "struct", "trait", "impl", "const", "static", "type_alias", "enum")).join(starts, ["file_id", "span_start"])
    first = named.join(body, "file_id").filter((F.col("_n") > F.col("_start_n")) & (F.col("_depth") == F.col("_d")) & (F.col("_body") < F.col("span_end"))).groupBy("file_id", "item_id").agg(F.min("_body").alias("head_end"))
    head = named.join(first, ["file_id", "item_id"], "left").select("file_id", "item_id", "name_start", "span_start", F.coalesce("head_end", "span_end").alias("span_end"))
    found = points_in_spans(near, head, ["file_id"], at="_from", closed=False)
    kind = F.when(F.col("_from") == F.col("name_start"), "declaration").when(F.rlike("token", F.lit(r"^\p{Lu}")), "type")
    return found.withColumn("site_kind", kind).filter("site_kind is not null").select("file_id", "item_id", F.col("token").alias("name"), F.col("_from").alias("span_start"), F.col("_to").alias("span_end"), "site_kind")


def let_bindings(toks: DataFrame) -> DataFrame:
    """G.4, G.5: file_id, name, span, annotated, ty of `let name` statements: the annotation's name, or the type that the
    initialiser shows: a literal's, or that of `Type { .. }`, `Type(..)` and `Type::f(..)`; else unknown."""
    order = Window.partitionBy("file_id").orderBy("n")
    near = structure(toks)
    cols = {f"t{i}": F.lead("token", i).over(order) for i in range(1, 8)} | {f"s{i}": F.lead("span_start", i).over(order) for i in (1, 2)}
    let = near.withColumns(cols).filter("token = 'let'")
    mut = F.col("t1") == "mut"
    at = lambda i: F.when(mut, F.col(f"t{i + 1}")).otherwise(F.col(f"t{i}"))
    value = at(3)
    literal = F.lit(None).cast("string")
    for pattern, ty in reversed(LITERALS):
        shown = F.regexp_extract(value, r"((?:f32|f64|[iu](?:8|16|32|64|128|size)))$", 1) if ty == "" else F.lit(ty)
        literal = F.when(F.rlike(value, F.lit(pattern)), shown).otherwise(literal)
    made = F.when(F.rlike(value, F.lit(r"^\p{Lu}")) & at(4).isin("{", "(", ":", "::"), value)
    ty = F.when(at(2) == ":", at(3)).when((at(2) == "=") & (at(4) == ";") & literal.isNotNull(), literal).when(at(2) == "=", made)
    name = at(1)
    start = F.when(mut, F.col("s2")).otherwise(F.col("s1"))
    out = let.select("file_id", name.alias("name"), start.alias("span_start"), (start + F.octet_length(name)).alias("span_end"), (at(2) == ":").alias("annotated"), F.coalesce(ty, F.lit("unknown")).alias("ty"), F.col("span_start").alias("let_at"))
    return out.filter(F.rlike("name", F.lit(r"^(?:r#)?[\p{Ll}_]")))


def type_hints(bindings: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """I.8: hints of unannotated bindings of known type, sorted by place and label, each once; ranges (file_id, lo, hi) ask
    that a binding's end touches them."""
    some = bindings.filter("not annotated and ty <> 'unknown' and name <> '_'").select("file_id", "span_start", F.col("span_end").alias("at"), F.concat(F.lit(": "), "ty").alias("label"))
    if ranges is not None:
        asked = ranges.select("file_id", F.col("lo").alias("span_start"), F.col("hi").alias("span_end"))
        some = points_in_spans(some.withColumnRenamed("span_start", "_from"), asked, ["file_id"], at="at").select("file_id", F.col("_from").alias("span_start"), "at", "label")
    return some.distinct().orderBy("file_id", "at", "label")


def completion_sites(cursors: DataFrame, toks: DataFrame, items: DataFrame) -> DataFrame:
    """H.10-H.14: query_id, site_kind, prefix, qualifier at each cursor (query_id, file_id, offset).

    The last significant token that starts before the cursor decides: after `.` a dot site with its receiver, after `::` a
    path site with its qualifier, inside a `use` item an import site, after `{` or `,` of a record a field site by its
    type, else an unqualified one.
    """
    near = structure(toks).select("file_id", "span_start", "span_end", "token", "kind", "depth", "prev", "prev2", "prev3", "open_token", "open_prev", "open_start", "close_start")
    found = last_before(cursors, near, ["file_id"], "offset", "span_start", [c for c in near.columns if c not in ("file_id", "span_start")], strict=True)
    typed = (F.col("kind") == "ident") & (F.col("offset") <= F.col("span_end"))
    # The three tokens before the identifier that is being typed, or before the cursor.
    back = [F.when(typed, F.col(a)).otherwise(F.col(b)) for a, b in (("prev", "token"), ("prev2", "prev"), ("prev3", "prev2"))]
    size = (F.col("offset") - F.col("span_end") + F.octet_length("token")).cast("int")
    prefix = F.when(typed, F.substring("token", F.lit(1), size)).otherwise("")
    name = lambda c: F.when(F.rlike(c, F.lit(r"^(?:r#)?[\p{L}_]")), c)
    uses = points_in_spans(cursors, items.filter("kind = 'use'").select("file_id", "span_start", "span_end"), ["file_id"]).select("query_id", F.lit(True).alias("_use")).distinct()
    both = found.withColumns({"_b1": back[0], "_b2": back[1], "_b3": back[2], "prefix": prefix}).join(uses, "query_id", "left")
    # The bracket around the cursor: what the last token opens, or what is around it; a name before a brace makes a record.
    opens = ~typed & (F.col("token") == "{")
    record = F.when(opens, F.col("prev")).when(F.col("open_token") == "{", F.col("open_prev"))
    record = F.when(F.col("_b1").isin("{", ","), name(record))
    path = (F.col("_b1") == ":") & (F.col("_b2") == ":")
    kind = (
        F.when(F.col("_use"), F.when(path, "use_path").otherwise("use_root")).when(F.col("_b1") == ".", "dot").when(path, "path")
        .when(F.rlike(record, F.lit(r"^\p{Lu}")), "record_field").otherwise("unqualified")
    )
    qualifier = F.when(kind == "dot", name(F.col("_b2"))).when(kind.isin("path", "use_path"), name(F.col("_b3"))).when(kind == "record_field", record)
    return both.select("query_id", kind.alias("site_kind"), "prefix", qualifier.alias("qualifier"))


def routed(documents: DataFrame, open_files: DataFrame, roots: DataFrame, last_active: str | None) -> DataFrame:
    """N.5: path, engine: the engine that has the file open, else that of the deepest workspace root above it, else the last active."""
    known = documents.join(open_files, "path").select("path", "engine")
    parts = F.split("path", "/")
    up = documents.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    by_root = up.join(roots, "root").groupBy("path").agg(F.max_by("engine", F.length("root")).alias("engine"))
    rest = documents.select("path", F.lit(last_active).alias("engine")).filter("engine is not null")
    return first_of([known, by_root, rest], ["path"], ties=False).select("path", "engine")


def lowest_common_items(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """B.8: for two offsets of a file (pair_id, file_id, left, right) the narrowest item around both."""
    spans = items.select("file_id", "item_id", "span_start", "span_end")
    at = points_in_spans(pairs, spans, ["file_id"], at="left").filter("span_start <= right and right <= span_end")
    return at.groupBy("pair_id").agg(F.min(F.struct((F.col("span_end") - F.col("span_start")).alias("n"), "item_id")).alias("b")).select("pair_id", "b.item_id")


def unbalanced(toks: DataFrame) -> DataFrame:
    """B.6: files whose brackets do not close, with the depth left at their end and the lowest depth."""
    near = structure(toks)
    return near.groupBy("file_id").agg(F.max_by("depth_after", "n").alias("left_open"), F.min("depth_after").alias("lowest")).filter("left_open <> 0 or lowest < 0")
