"""The public queries, each over a batch of cursors or searches (§2 I): one plan answers them all.

An Analysis holds engine tables of real code: files (file_id, path, text, package_slot). Tables are built by operators and
written once per revision; every query is a join against them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.names import rank_of, signature
from .operators import brackets, cursor, gates as gates_, lexing, positions, resolution, scopes, symbols
from .plans.durable import durable
from .plans.interval import points_in_spans


class Analysis:
    def __init__(self, files: DataFrame, extern_roots: DataFrame | None = None, cfg: DataFrame | None = None):
        """extern_roots: file_id, name, root_file: names that lead from the crate of file_id to that of root_file.
        cfg: one row of atoms, pairs and is_test; names then are those of the items that it enables. Without it, of all."""
        self.files, self.extern_roots, self.cfg = files, extern_roots, cfg

    @cached_property
    def tokens(self) -> DataFrame:
        return durable(lexing.tokens(self.files.select("file_id", "text")), "tokens")

    @cached_property
    def near(self) -> DataFrame:
        """Significant tokens with their neighbours and brackets."""
        return durable(brackets.structure(self.tokens), "structure")

    @cached_property
    def items(self) -> DataFrame:
        return durable(lexing.items(self.near), "items")

    @cached_property
    def lines(self) -> DataFrame:
        return durable(positions.line_index(self.files.select("file_id", "text")), "lines")

    @cached_property
    def module_links(self) -> DataFrame:
        return durable(lexing.module_files(self.items, self.files, lexing.path_attributes(self.near, self.items)), "modules")

    @cached_property
    def active(self) -> tuple[DataFrame, DataFrame]:
        """C.2: items and module links that the cfg leaves, for crates whose roots are the files that no module links to."""
        if self.cfg is None:
            return self.items, self.module_links
        roots = self.files.select("file_id").join(self.module_links.select(F.col("module_file").alias("file_id")), "file_id", "left_anti")
        targets = roots.select(F.col("file_id").alias("target_id"), F.col("file_id").alias("root_file")).crossJoin(F.broadcast(self.cfg.limit(1)))
        gates = lexing.cfg_gates(self.near, self.items)
        some = durable(gates_.enabled_items(self.items, gates, self.module_links, targets).select("file_id", "item_id").distinct(), "enabled")
        return self.items.join(some, ["file_id", "item_id"], "left_semi"), self.module_links.join(some, ["file_id", "item_id"], "left_semi")

    @cached_property
    def definitions(self) -> DataFrame:
        """Named items with the file, name span and container (the nearest module, trait, impl or function)."""
        own = self.items.filter("name is not null")
        up = self.items.select("file_id", F.col("item_id").alias("parent_id"), F.col("name").alias("container"))
        return own.join(up, ["file_id", "parent_id"], "left").withColumn("name_end", F.col("name_start") + F.octet_length("name"))

    def document_symbols(self, files: DataFrame) -> DataFrame:
        """I.22, I.23: outline rows of the asked files (file_id): parent_id nests them; in order of start, end, kind, name."""
        some = self.items.join(files.select("file_id"), "file_id", "left_semi").filter("kind <> 'use'")
        return some.select("file_id", "item_id", "parent_id", "kind", "name", "visibility", "span_start", "span_end").orderBy("file_id", "span_start", "span_end", rank_of(F.col("kind")), "name")

    def workspace_symbols(self, needles: DataFrame) -> DataFrame:
        """I.24: (query_id, needle) to definitions, in the observable order."""
        defs = self.definitions.select("file_id", "item_id", "name", "kind", "container", F.col("span_start").alias("start"))
        found = symbols.workspace_symbols_batch(defs, needles)
        return found.orderBy("query_id", F.lower("name"), rank_of(F.col("kind")), F.col("container").asc_nulls_first(), "file_id", "start")

    def symbol_at(self, cursors: DataFrame) -> DataFrame:
        """I.1: (query_id, file_id, offset) to the narrowest identifier, or tuple field, that touches the cursor."""
        named = "kind in ('ident', 'lifetime') or (kind = 'number' and prev = '.' and token not like '%.%')"
        ids = self.near.filter(named).select("file_id", "span_start", "span_end", F.col("n").alias("scan_order"), F.col("token").alias("entity_id"))
        return cursor.symbol_at(cursors, ids, ["file_id"]).withColumnRenamed("entity_id", "name")

    def enclosing_items(self, cursors: DataFrame) -> DataFrame:
        """B.7, H.15: items around each cursor, the narrowest first."""
        spans = self.items.select("file_id", "item_id", "kind", "name", "span_start", "span_end")
        return points_in_spans(cursors, spans, ["file_id"]).withColumn("length", F.col("span_end") - F.col("span_start")).orderBy("query_id", "length")

    @cached_property
    def names(self) -> resolution.Names:
        """Scopes after imports, members, and what each name means."""
        items, links = self.active
        impls = self.impls.join(items.select("file_id", F.col("item_id").alias("impl_id")), ["file_id", "impl_id"], "left_semi")
        return resolution.Names(self.files, self.near, items, links, self.lets, impls, self.extern_roots)

    def _sites_at(self, cursors: DataFrame) -> DataFrame:
        return self.symbol_at(cursors).join(cursors.select("query_id", "file_id"), "query_id").select("query_id", "file_id", "span_start", "name")

    def _resolved(self, cursors: DataFrame) -> DataFrame:
        """query_id, def_id of the symbols under the cursors."""
        at = self._sites_at(cursors)
        sites = self.names.sites.join(at.select("file_id", "span_start"), ["file_id", "span_start"], "left_semi")
        return at.join(self.names.resolve(sites), ["file_id", "span_start"]).select("query_id", "def_id").distinct()

    def goto_definition(self, cursors: DataFrame) -> DataFrame:
        """I.2, I.4: definitions of the symbol under each cursor, by scopes, imports and receiver types; none if they do not tell.
        A module that is a whole file has no item_id."""
        defs = self.names.definitions.withColumnRenamed("file_id", "def_file").withColumn("name_end", F.col("name_start") + F.coalesce(F.octet_length("name"), F.lit(0)))
        return self._resolved(cursors).join(defs, "def_id").select("query_id", "def_file", "item_id", "kind", "name", "name_start", "name_end")

    def occurrences(self, names: DataFrame, include_declarations: bool = False) -> DataFrame:
        """(query_id, name) to identifiers of that spelling, whatever they mean; sorted, each once."""
        sites = self.tokens.filter("kind = 'ident'").select("file_id", "span_start", "span_end", F.col("token").alias("name"))
        found = sites.join(names.select("query_id", "name").distinct(), "name")
        if not include_declarations:
            found = found.join(self.definitions.select("file_id", F.col("name_start").alias("span_start"), "name"), ["file_id", "span_start", "name"], "left_anti")
        return found.select("query_id", "file_id", "span_start", "span_end").distinct().orderBy("query_id", "file_id", "span_start")

    def references(self, cursors: DataFrame, include_declarations: bool = False) -> DataFrame:
        """I.10: sites that mean what the symbol under each cursor means, declarations only if asked for; sorted, each once.

        Only identifiers that a subject can be called by are resolved: its own name and the names imports give it.
        """
        subjects = durable(self._resolved(cursors), "subjects")
        defs = self.names.definitions.join(subjects, "def_id", "left_semi")
        called = defs.select("name").unionByName(self.names.scopes.join(subjects, "def_id", "left_semi").select("name")).distinct()
        found = self.names.resolve(self.names.sites.join(called, "name", "left_semi")).join(subjects, "def_id")
        if not include_declarations:
            found = found.join(defs.select("file_id", F.col("name_start").alias("span_start"), "def_id"), ["file_id", "span_start", "def_id"], "left_anti")
        ends = self.names.sites.select("file_id", "span_start", "span_end")
        return found.join(ends, ["file_id", "span_start"]).select("query_id", "file_id", "span_start", "span_end").distinct().orderBy("query_id", "file_id", "span_start")

    def hover(self, cursors: DataFrame) -> DataFrame:
        """I.9: signature, with parameters and result, and docs of the definitions under each cursor."""
        defs = self.goto_definition(cursors)
        docs = lexing.item_docs(self.tokens, self.items).select(F.col("file_id").alias("def_file"), "item_id", "docs")
        vis = self.items.select(F.col("file_id").alias("def_file"), "item_id", "visibility")
        heads = self.names.heads.select(F.col("file_id").alias("def_file"), "item_id", "params", "result")
        text = signature(F.col("kind"), F.col("name"), F.col("visibility"), F.coalesce("params", F.array().cast("array<string>")), F.col("result"))
        keys = ["def_file", "item_id"]
        return defs.join(vis, keys).join(docs, keys, "left").join(heads, keys, "left").select("query_id", "def_file", "item_id", text.alias("signature"), "docs")

    def completions_at(self, cursors: DataFrame) -> DataFrame:
        """I.13, I.16, H.17: locals in scope and names of the cursor's module, imported ones too, that begin with the identifier
        before the cursor."""
        prefix = points_in_spans(cursors, self.tokens.filter("kind = 'ident'").select("file_id", "span_start", "span_end", "token"), ["file_id"])
        typed = prefix.filter("span_start < offset").select("query_id", "file_id", "offset", F.expr("substring(token, 1, cast(offset - span_start as int))").alias("typed"))
        near = points_in_spans(typed, self.names.locals.select("file_id", "name", "kind", "span_start", "span_end"), ["file_id"]).select("query_id", "typed", "name", "kind")
        scope = self.names.scopes.join(self.names.definitions.select("def_id", "kind"), "def_id").select("module_id", "name", "kind")
        far = resolution.in_module(typed, self.names.modules, "offset", ["query_id"]).join(scope, "module_id").select("query_id", "typed", "name", "kind")
        found = near.unionByName(far).filter(F.startswith("name", F.col("typed"))).select("query_id", F.col("name").alias("label"), "kind").distinct()
        return found.orderBy("query_id", F.lower("label"), "kind")

    @cached_property
    def impls(self) -> DataFrame:
        return durable(scopes.impl_headers(self.items, self.near), "impls")

    @cached_property
    def lets(self) -> DataFrame:
        return durable(scopes.let_bindings(self.near), "lets")

    def type_hints(self, ranges: DataFrame | None = None) -> DataFrame:
        """I.8: hints of let bindings whose type shows, optionally within ranges (file_id, lo, hi)."""
        return scopes.type_hints(self.lets, ranges)

    def type_at(self, cursors: DataFrame) -> DataFrame:
        """I.7, G.8: the type, as written, of the local in scope that is under each cursor, or unknown."""
        at = self._sites_at(cursors)
        known = self.names.local_at(at, "name").select("file_id", "span_start", "ty")
        return at.join(known, ["file_id", "span_start"], "left").select("query_id", "name", F.coalesce("ty", F.lit("unknown")).alias("ty"))

    def goto_type_definition(self, cursors: DataFrame) -> DataFrame:
        """I.5: the types that the names under the cursors have, to their declarations."""
        at = self._sites_at(cursors)
        types = self.names.definitions.select(F.col("def_id").alias("type_def"), F.col("name").alias("ty"), F.col("file_id").alias("def_file"), "item_id")
        return at.join(self.names.receiver_types(at, "name"), ["file_id", "span_start"]).join(types, "type_def").select("query_id", "ty", "def_file", "item_id")

    def goto_implementation(self, cursors: DataFrame) -> DataFrame:
        """I.6: implementations of the type or trait that is under each cursor."""
        of = self.names.impls.select("file_id", "impl_id", F.explode(F.array_compact(F.array("self_def", "trait_def"))).alias("def_id"))
        return self._resolved(cursors).join(of, "def_id").select("query_id", "file_id", "impl_id").distinct()

    def member_completions(self, cursors: DataFrame) -> DataFrame:
        """I.14, I.15, I.17: at dot sites members of the receiver's type, at path sites those of the qualifier (a type or a
        module), in records its fields, all with the typed prefix."""
        n = self.names
        sites = scopes.completion_sites(cursors, self.near, self.items).join(cursors.select("query_id", "file_id", "offset"), "query_id").withColumnRenamed("offset", "span_start")
        dots = sites.filter("site_kind = 'dot' and qualifier is not null")
        typed = dots.join(n.receiver_types(dots, "qualifier"), ["file_id", "span_start"]).select("query_id", "site_kind", "prefix", F.col("type_def").alias("module_id"))
        led = resolution.in_module(sites.filter("site_kind in ('path', 'record_field')"), n.modules, "span_start", ["query_id"])
        paths = led.select(F.col("query_id").alias("path_id"), "module_id", F.array("qualifier").alias("segments"), F.lit(False).alias("absolute"))
        to = n.walked(paths, n.scopes).join(n.module_defs, "def_id").select(F.col("path_id").alias("query_id"), F.col("module").alias("module_id")).distinct()
        both = typed.unionByName(led.drop("module_id").join(to, "query_id").select("query_id", "site_kind", "prefix", "module_id"))
        named = n.scopes.join(n.definitions.select("def_id", "kind"), "def_id").select("module_id", F.col("name").alias("label"), "kind")
        members = n.members.select("module_id", F.col("name").alias("label"), "kind").unionByName(named)
        fits = F.when(F.col("site_kind") == "record_field", F.col("kind") == "field").when(F.col("site_kind") == "path", F.col("kind") != "field").otherwise(F.col("kind").isin("field", "function"))
        found = both.join(members, "module_id").filter(fits & F.startswith("label", F.col("prefix")))
        return found.select("query_id", "label", "kind").distinct().orderBy("query_id", "kind", "label")

    def updated(self, changed: DataFrame) -> Analysis:
        """L.4, L.9, L.12: an analysis with the changed files (file_id, path, text) in place. Tokens, brackets, items and lines of other
        files are kept as they are; only changed files are read anew."""
        ids = changed.select("file_id")
        kept = self.files.join(ids, "file_id", "left_anti")
        out = Analysis(kept.unionByName(changed.select(*kept.columns)), self.extern_roots, self.cfg)
        new = Analysis(changed)
        for name in ("tokens", "near", "items", "lines"):
            old = getattr(self, name)
            out.__dict__[name] = old.join(ids, "file_id", "left_anti").unionByName(getattr(new, name).select(*old.columns))
        return out

    def locations(self, spans: DataFrame) -> DataFrame:
        """J.9: spans (file_id, span_start) with path, line and UTF-8 column."""
        at = positions.utf8_positions(spans.withColumn("offset", F.col("span_start")), self.lines.select("file_id", "line", "start"))
        return at.drop("offset").join(self.files.select("file_id", "path"), "file_id")
