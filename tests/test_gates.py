"""cfg applied to items and files, module files by path attributes, docs of every form."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from srcatlas.operators import brackets, gates, lexing

ROOT = """#[cfg(unix)] mod os { pub fn f() {} #[cfg(test)] fn g() {} }
#[cfg(windows)] mod os { pub fn f() {} }
#[cfg_attr(unix, cfg(test))] fn only() {}
#[cfg_attr(unix, derive(Debug), doc = "a, (b")] struct S;
#[cfg(unix)] mod a;
#[cfg(windows)] #[path = "win/../w.rs"] mod a;
mod b;
fn k() {}
"""
FILES = [(1, "/p/src/lib.rs", ROOT), (2, "/p/src/a.rs", "fn in_a() {}\nmod c;\nmod b2;"), (3, "/p/src/w.rs", "fn in_w() {}"), (4, "/p/src/b.rs", '#[cfg(feature = "x")] fn in_b() {}'), (5, "/p/src/a/c.rs", "fn in_c() {}"), (6, "/p/other.rs", "fn apart() {}")]


def test_enabled_items_of_two_targets(spark):
    files = spark.createDataFrame(FILES, "file_id long, path string, text string")
    near = brackets.structure(lexing.tokens(files)).cache()
    items = lexing.items(near).cache()
    links = lexing.module_files(items, files, lexing.path_attributes(near, items)).cache()
    assert {(r.file_id, r.item_id, r.module_file) for r in links.collect()} == {(1, ROOT.index("mod a;"), 2), (1, ROOT.rindex("mod a;"), 3), (1, ROOT.index("mod b;"), 4), (2, FILES[1][2].index("mod c"), 5)}
    trees = {(r.item_id, json.dumps(json.loads(r.gate))) for r in lexing.cfg_gates(near, items).filter("file_id = 1").collect()}
    assert (ROOT.index("fn only"), '{"op": "any", "args": [{"op": "not", "args": [{"op": "atom", "key": "unix"}]}, {"op": "atom", "key": "test"}]}') in trees and ROOT.index("struct S") not in {i for i, _ in trees}
    targets = spark.createDataFrame([(1, 1, ["unix"], ["feature=x"], False), (2, 1, ["windows"], [], True)], "target_id int, root_file long, atoms array<string>, pairs array<string>, is_test boolean")
    on = gates.enabled_items(items, lexing.cfg_gates(near, items), links, targets).join(items, ["file_id", "item_id"])
    got = {(r.target_id, r.name, r.item_id if r.name == "f" else None) for r in on.collect()}
    unix = {("os", None), ("f", ROOT.index("fn f")), ("S", None), ("a", None), ("in_a", None), ("c", None), ("b2", None), ("in_c", None), ("b", None), ("in_b", None), ("k", None)}
    windows = {("os", None), ("f", ROOT.rindex("fn f")), ("only", None), ("S", None), ("a", None), ("in_w", None), ("b", None), ("k", None)}
    assert got == {(1, *x) for x in unix} | {(2, *x) for x in windows}


def test_links_that_form_a_cycle(spark):
    rows = [(1, "/p/lib.rs", "mod a;"), (2, "/p/a.rs", '#[path = "lib.rs"] mod back;\n#[path = "/q/far.rs"] mod far;\nmod inline { #[path = "x.rs"] mod x; mod y; }\n#[path = "../gone.rs"] mod gone;'), (3, "/q/far.rs", ""), (4, "/p/a/inline/x.rs", ""), (5, "/p/a/inline/y.rs", "")]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    near = brackets.structure(lexing.tokens(files)).cache()
    items = lexing.items(near).cache()
    links = lexing.module_files(items, files, lexing.path_attributes(near, items)).cache()
    assert {(r.file_id, r.name, r.module_file) for r in links.collect()} == {(1, "a", 2), (2, "back", 1), (2, "far", 3), (2, "x", 4), (2, "y", 5)}
    targets = spark.createDataFrame([(1, 1, [], [], False)], "target_id int, root_file long, atoms array<string>, pairs array<string>, is_test boolean")
    on = gates.enabled_items(items, lexing.cfg_gates(near, items), links, targets)
    assert {(r.file_id, r.item_id) for r in on.collect()} == {(r.file_id, r.item_id) for r in items.collect()}
    assert gates.enabled_items(items, lexing.cfg_gates(near, items), links, targets.limit(0)).count() == 0


def test_docs_of_every_form(spark):
    text = '//! Of the file.\n/*! Too. */\n/** One\n * two */\n#[doc = " three"]\n/// four\nfn a() { //! Inside.\n let x = 1; //! no\n}\n//// none\n/*** none */\nfn b() {}\n/**/ fn c() {}\n'
    toks = lexing.tokens(spark.createDataFrame([(1, text)], "file_id long, text string"))
    got = {(r.item_id, r.docs) for r in lexing.item_docs(toks, lexing.items(toks)).select("item_id", F.col("docs")).collect()}
    assert got == {(None, "Of the file.\nToo."), (text.index("fn a"), "One\ntwo\nthree\nfour\nInside.")}
