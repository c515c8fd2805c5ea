"""Operators on small hand-computed tables: cycles, ties, empty inputs, limits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from srcatlas.functions.names import call_snippet, capped_list, doc_markdown, fingerprint, type_label
from srcatlas.operators import closure, completion, cursor, imports, incremental, references, semantic, stats, symbols
from srcatlas.plans.asof import last_before
from srcatlas.plans.fixpoint import NotSettled, rounds
from srcatlas.plans.fixpoint import closure as fix
from srcatlas.plans.interval import points_in_spans, smallest_cover
from srcatlas.plans.priority import first_of


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=str)


def table(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_closure_on_cycles_and_empty(spark):
    edges = table(spark, "a int, b int", (1, 2), (2, 3), (3, 1), (4, 4))
    step = lambda now: now.join(edges.select(F.col("a").alias("at"), F.col("b").alias("to")), F.col("x") == F.col("at")).select(F.col("to").alias("x"))
    assert rows(fix(table(spark, "x int", (1,)), step)) == [(1,), (2,), (3,)]
    assert rows(fix(table(spark, "x int", (4,)), step)) == [(4,)]
    assert rows(fix(table(spark, "x int"), step)) == []
    with pytest.raises(NotSettled):
        fix(table(spark, "x int", (1,)), lambda now: now.select((F.col("x") + 1).alias("x")), most_rounds=5)


def test_rounds_may_take_rows_away(spark):
    out = rounds(table(spark, "x int", (1,), (2,), (9,)), lambda now: now.filter("x < 5"))
    assert rows(out) == [(1,), (2,)]
    with pytest.raises(NotSettled):
        rounds(table(spark, "x int", (0,)), lambda now: now.select((1 - F.col("x")).alias("x")), most_rounds=4)


def test_intervals(spark):
    spans = table(spark, "f int, s int, span_start long, span_end long", (1, 1, 0, 1000), (1, 2, 100, 110), (1, 3, 110, 110), (2, 4, 0, 5))
    at = table(spark, "f int, offset long", (1, 110), (1, 100), (2, 5), (3, 0))
    assert rows(points_in_spans(at, spans, ["f"]), "f", "offset", "s") == [(1, 100, 1), (1, 100, 2), (1, 110, 1), (1, 110, 2), (1, 110, 3), (2, 5, 4)]
    assert rows(points_in_spans(at, spans, ["f"], closed=False), "f", "offset", "s") == [(1, 100, 1), (1, 100, 2), (1, 110, 1)]
    kids = table(spark, "f int, id long, span_start long, span_end long", (1, 7, 101, 105), (1, 8, 100, 110), (1, 9, 2000, 2001))
    parents = spans.select("f", F.col("s").cast("long").alias("id"), "span_start", "span_end")
    assert rows(smallest_cover(kids, parents, ["f"]), "id", "parent_id") == [(7, 2), (8, 1), (9, None)]
    wide = [(1, k, k * 7919 % 300_000, k * 7919 % 300_000 + (1 << k % 28)) for k in range(200)]
    points = [(1, p) for p in range(0, 400_000, 3_001)]
    want = sorted(((1, p, k) for _, p in points for _, k, a, b in wide if a <= p <= b), key=str)
    assert rows(points_in_spans(table(spark, "f int, offset long", *points), table(spark, "f int, s int, span_start long, span_end long", *wide), ["f"]), "f", "offset", "s") == want


def test_asof_strict_and_ties(spark):
    left = table(spark, "k int, t int", (1, 5), (1, 4), (2, 1))
    right = table(spark, "k int, u int, v string", (1, 4, "a"), (1, 5, "b"))
    assert rows(last_before(left, right, ["k"], "t", "u", ["v"])) == [(1, 4, "a"), (1, 5, "b"), (2, 1, None)]
    assert rows(last_before(left, right, ["k"], "t", "u", ["v"], strict=True)) == [(1, 4, None), (1, 5, "a"), (2, 1, None)]


def test_priority_union(spark):
    a, b = table(spark, "k int, v int", (1, 10), (1, 11)), table(spark, "k int, v int", (1, 12), (2, 20))
    assert rows(first_of([a, b], ["k"]), "k", "v") == [(1, 10), (1, 11), (2, 20)]
    assert rows(first_of([a, b], ["k"], ties=False), "k", "v") == [(1, 10), (2, 20)]


def test_narrowest_symbol_keeps_the_first_of_equals(spark):
    sites = table(spark, "f int, span_start long, span_end long, scan_order int, entity_id string", (1, 0, 9, 1, "wide"), (1, 4, 6, 3, "late"), (1, 4, 6, 2, "early"), (1, 6, 8, 1, "right"))
    cursors = table(spark, "query_id int, f int, offset long", (1, 1, 5), (2, 1, 6), (3, 1, 9), (4, 1, 10))
    assert rows(cursor.symbol_at(cursors, sites, ["f"]), "query_id", "entity_id") == [(1, "early"), (2, "right"), (3, "wide")]


def test_module_cycle_is_an_error(spark):
    with pytest.raises(RuntimeError):
        symbols.container_paths(table(spark, "module_id long, parent_id long, name string", (0, None, "root"), (1, 0, "a"), (1, 1, "a")), most_depth=5)


def test_batched_symbol_search_beyond_the_broadcast(spark):
    defs = table(spark, "def_id int, name string", (1, "Alpha"), (2, "beta"), (3, "ab"))
    needles = spark.range(10_050).select(F.col("id").cast("int").alias("query_id"), F.when(F.col("id") < 3, F.element_at(F.array(F.lit("LPH"), F.lit("b"), F.lit("")), (F.col("id") + 1).cast("int"))).otherwise(F.concat(F.lit("none"), F.col("id").cast("string"))).alias("needle"))
    assert rows(symbols.workspace_symbols_batch(defs, needles), "query_id", "def_id") == [(0, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]


def test_visibility(spark):
    info = table(spark, "module_id long, target_id long, parent_id long", (1, 1, None), (2, 1, 1), (3, 1, 2), (4, 1, 1), (9, 2, None))
    anc = closure.ancestors(info.select("module_id", "parent_id"))
    pairs = [(i, 2, v) for i in (1, 2, 3, 4, 9) for v in ("public", "crate", "private", "super", "unknown")]
    got = rows(imports.visible_to(table(spark, "importer long, owner long, visibility string", *pairs), info, anc), "visibility", "importer")
    assert got == sorted([("public", i) for i in (1, 2, 3, 4, 9)] + [("crate", i) for i in (1, 2, 3, 4)] + [("private", 2), ("private", 3)] + [("super", i) for i in (1, 2, 3, 4)], key=str)


def test_imports_settle_on_a_glob_cycle(spark):
    info = table(spark, "module_id long, target_id long, parent_id long", (1, 1, None), (2, 1, 1), (3, 1, 1))
    anc = closure.ancestors(info.select("module_id", "parent_id"))
    base = table(spark, "module_id long, name string, ns string, def_id long, visibility string, owner long, origin string", (1, "a", "t", 10, "public", 1, "own"), (2, "b", "t", 20, "public", 2, "own"), (2, "p", "t", 21, "private", 2, "own"), (3, "a", "t", 30, "public", 3, "own"))
    imp = table(
        spark, "import_id long, module_id long, kind string, source long, item string, binding string, visibility string", (1, 1, "glob", 2, None, None, "public"), (2, 2, "glob", 3, None, None, "public"), (3, 3, "glob", 1, None, None, "public"),
        (4, 3, "named", 2, "b", "c", "private"), (5, 3, "named", 2, "b", "_", "public"), (6, 1, "named", 2, "gone", None, "public"),
    )
    scopes = imports.import_fixpoint(base, imp, info, anc)
    # Own names hide glob ones; the private p stays; c is 3's private import and does not travel.
    assert rows(scopes, "module_id", "name", "def_id") == [(1, "a", 10), (1, "b", 20), (2, "a", 30), (2, "b", 20), (2, "p", 21), (3, "a", 30), (3, "b", 20), (3, "c", 20)]
    assert rows(imports.unresolved_imports(imp, scopes)) == [(6,)]


def test_paths(spark):
    scope = table(spark, "module_id long, name string, ns string, def_id long", (1, "m", "t", 100), (2, "f", "v", 200), (2, "f", "t", 201), (1, "m", "v", 101))
    mods = table(spark, "def_id long, module long", (100, 2))
    paths = table(spark, "path_id int, module_id long, segments array<string>", (1, 1, ["m", "f"]), (2, 1, ["m", "x"]), (3, 1, ["y", "f"]), (4, 1, ["m"]), (5, 2, ["f", "f"]))
    assert rows(imports.resolve_paths(paths, scope, mods)) == [(1, 200, None), (1, 201, None), (2, None, 1), (3, None, 0), (4, 100, None), (4, 101, None), (5, None, 1)]


def test_lattice_and_unknown(spark):
    v = table(spark, "receiver int, function_id int, verdict int", (1, 1, 2), (1, 1, 1), (1, 2, 2), (2, 1, 0))
    assert rows(semantic.best_applicability(v)) == [(1, 1, 1), (2, 1, 0)]
    t = table(spark, "e int, ty string", (1, "A"), (1, "A"), (2, "A"), (2, "B"))
    assert rows(semantic.unique_or_unknown(t, ["e"])) == [(1, "A", True), (2, None, False)]
    args = table(spark, "r array<string>, i array<string>", (["A"], ["A"]), (["A"], [None]), (["A"], ["B"]), (["A"], []), ([], []))
    assert [r[0] for r in args.select(semantic.inherent_applicability(F.col("r"), F.col("i"))).collect()] == [0, 0, 2, 2, 0]
    assert [r[0] for r in args.select(semantic.substitute(F.col("r"), F.array(F.lit("A")), F.array(F.lit("u8")))).collect()][:1] == [["u8"]]


def test_references_once_in_order(spark):
    sites = table(spark, "package_slot int, file_id long, span_start long, span_end long, entity_id long, is_declaration boolean", (1, 2, 5, 6, 7, False), (1, 2, 5, 6, 7, False), (1, 1, 9, 10, 7, True), (1, 1, 3, 4, 8, False))
    subject = table(spark, "entity_id long", (7,))
    assert [tuple(r)[:3] for r in references.references(subject, sites).collect()] == [(1, 2, 5)]
    assert [tuple(r)[:3] for r in references.references(subject, sites, True).collect()] == [(1, 1, 9), (1, 2, 5)]


def test_documents_and_publication(spark):
    e = table(spark, "path int, version long, op string, ts timestamp, value double").schema
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    events = spark.createDataFrame([(1, 1, "open", at(0), 0.0), (1, 3, "change", at(1), 0.0), (1, 2, "save", at(2), 0.0), (2, 1, "open", at(0), 0.0), (2, 2, "close", at(9), 0.0)], e)
    assert rows(incremental.latest_documents(events)) == [(1, 3, 2, True)]
    assert rows(incremental.late_events(events), "path", "version") == [(1, 2)]
    assert rows(incremental.debounced(events, 5), "path", "version") == [(1, 2), (2, 1), (2, 2)]
    old, new, dirty = table(spark, "path int, n long", (1, 1), (2, 2)), table(spark, "path int, n long", (2, 5), (3, 1)), table(spark, "path int", (3,))
    assert rows(incremental.publication_plan(old, new, dirty)) == [(1, "clear", 0), (2, "publish", 5), (3, "hold", 1)]
    saved = table(spark, "path string", ("a/Cargo.lock",), ("a/Cargo.toml",), ("n/Cargo.toml",), ("a/src/lib.rs",), ("a/src/x.rs",))
    reasons = incremental.graph_changed(saved, table(spark, "path string", ("a/Cargo.toml",)), table(spark, "path string", ("a/src/lib.rs",)))
    assert rows(reasons) == [("a/Cargo.lock", "lockfile"), ("a/Cargo.toml", "manifest"), ("a/src/lib.rs", "target_root"), ("n/Cargo.toml", "new_manifest")]


def test_rendering(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(call_snippet(F.lit("f"), F.array(F.lit("&self"), F.lit("a$")), F.lit(False))) == r"f(${1:a\$})"
    assert get(type_label(F.lit("nominal"), F.lit("Vec"), F.array(F.lit("u8")))) == "Vec<u8>" and get(type_label(F.lit("unknown"), F.lit("x"), F.array())) is None
    assert get(capped_list(F.array(*map(F.lit, "abcd")), 2)) == ["a", "b", "/* … 2 more */"] and get(capped_list(F.array(F.lit("a")), 2)) == ["a"]
    assert get(doc_markdown(F.lit("x\n```no_run\n# hidden\nlet a;\n```"))) == "x\n```rust\nlet a;\n```"
    assert get(fingerprint("d", F.lit("ab"), F.lit("c"))) != get(fingerprint("d", F.lit("a"), F.lit("bc"))) and get(fingerprint("d", F.lit(None))) != get(fingerprint("d", F.lit("")))


def test_completions(spark):
    sites = table(spark, "site int, context string", (1, "type"), (2, "item"))
    got = rows(completion.static_completions(sites), "site", "label")
    assert (1, "i32") in got and (2, "fn") in got and (1, "fn") not in [g for g in got if g[0] == 2 and g[1] == "i32"]
    names = lambda *x: table(spark, "site int, label string, ns string, def_id int", *x)
    shown = completion.unqualified(names((1, "a", "v", 1)), names((1, "a", "v", 2), (1, "a", "t", 3)), names((1, "b", "t", 4)), names((1, "b", "t", 5)))
    assert rows(shown, "label", "ns", "def_id") == [("a", "t", 3), ("a", "v", 1), ("b", "t", 4)]


def test_empty_tables(spark):
    files = table(spark, "package string, file_id long, text string")
    assert stats.package_fingerprints(files).count() == 0
    assert closure.reverse_dependency_closure(table(spark, "package_slot int"), table(spark, "package_slot int, dep_slot int")).count() == 0
    assert imports.resolve_paths(table(spark, "path_id int, module_id long, segments array<string>"), table(spark, "module_id long, name string, ns string, def_id long"), table(spark, "def_id long, module long")).count() == 0


def above_joins(df) -> str:
    """The optimized plan from its root down to the first join: what is done with the joined rows."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]


def test_trait_functions_come_once_without_a_distinct(spark):
    impls = table(spark, "self_type long, trait long, impl_id long", (1, 10, 100), (1, 11, 101), (2, 11, 102), (2, None, 103), (3, 12, 104), (1, 10, 105), (1, 10, 105))
    functions = table(spark, "trait long, function_id long", (10, 7), (11, 7), (11, 8), (11, 8), (12, 9), (13, 6))
    own = table(spark, "impl_id long, function_id long", (100, 7), (101, 5), (102, 5), (102, 4), (105, 5), (103, 3), (104, 9), (105, 2), (100, 2))
    found = semantic.trait_functions(semantic.traits_for_types(impls), functions, own, impls)
    assert rows(found) == [(1, 2), (1, 5), (1, 7), (1, 8), (2, 4), (2, 5), (2, 7), (2, 8), (3, 9)]
    assert "Aggregate" not in above_joins(found)


def test_first_segment_picks_the_place_before_definitions(spark):
    uses = table(spark, "use_id long, module_id long, target_id long, name string, absolute boolean", (1, 1, 5, "a", False), (2, 1, 5, "a", True), (3, 2, 5, "p", False), (4, 2, 5, "p", True), (5, 2, 5, "b", False), (6, 1, 5, "p", False), (6, 1, 5, "b", False), (6, 2, 5, "b", False), (7, 1, 6, "z", False))
    scopes = table(spark, "module_id long, name string, def_id long", (1, "a", 10), (1, "a", 11), (1, "a", 11), (9, "b", 12))
    roots = table(spark, "target_id long, name string, def_id long", (5, "a", 20), (5, "b", 21), (5, "b", 22))
    prelude = table(spark, "target_id long, name string, def_id long", (5, "p", 30), (5, "a", 31))
    found = imports.first_segment(uses, scopes, roots, prelude)
    assert rows(found, "use_id", "def_id", "priority") == [(1, 10, 0), (1, 11, 0), (2, 20, 1), (3, 30, 2), (5, 21, 1), (5, 22, 1), (6, 21, 1), (6, 22, 1)]
    assert "Window" not in above_joins(found) and "Aggregate" not in above_joins(found)


def test_points_go_to_the_widths_that_spans_have(spark):
    from srcatlas.plans.interval import dealt_points, with_width

    points = table(spark, "f int, offset long", *[(1, 10 * k) for k in range(100)])
    one = table(spark, "f int, span_start long, span_end long", (1, 0, 450), (1, 150, 380))
    assert dealt_points(points, "offset", with_width(one)).count() == 100
    two = one.union(table(spark, "f int, span_start long, span_end long", (1, 0, 9000)))
    assert dealt_points(points, "offset", with_width(two)).count() == 200
    assert points_in_spans(points, two.filter("f = 3"), ["f"]).count() == 0


def test_durable_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    from srcatlas.plans import durable as module

    monkeypatch.setattr(module, "MOST_ROWS", 50)
    few, many = module.durable(spark.range(40)), module.durable(spark.range(60))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    derived = many.filter("id > 3").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).groupBy("id").count()
    assert "Broadcast" not in plan(spark.range(1000).join(derived, "id")) and spark.range(1000).join(derived, "id").count() == 56
    assert "Broadcast" in plan(spark.range(1000).join(few, "id"))


def test_implementations_come_once_without_a_last_distinct(spark):
    impls = table(spark, "self_type long, trait long, impl_id long", (1, 10, 100), (1, 10, 100), (1, None, 100), (2, 10, 101))
    asked = table(spark, "entity_id long, entity_kind string", (1, "type"), (1, "type"), (10, "trait"), (2, "trait"))
    found = semantic.goto_implementation(asked, impls)
    assert rows(found) == [(1, "type", 100, 1), (10, "trait", 100, 1), (10, "trait", 101, 2)]
    assert "Aggregate" not in above_joins(found)
