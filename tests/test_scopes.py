"""Scopes, headers, members and cursor sites over a small text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from srcatlas.operators import lexing, scopes
from srcatlas.operators.closure import dependency_applies

TEXT = '''struct Point { pub x: f64, pub(crate) y: [i32; 4], #[a] z: Vec<(u8, u8)> }
enum E { A, B(i32), C { q: i32 }, D = 4 }
impl<T: Clone> fmt::Display for Wrapper<Vec<T>> where T: X { fn f(&self) -> Point { let p = Point { x: 1.0 }; let mut n = 5u8; let s = "a"; let w: Vec<u8> = make(); let q = Point::new(); p. } }
impl Point { fn new() -> Self { println!("x"); my!{a}; foo::ba } }
use std::io::Re;
fn rec() { Point { x: 1, y }  }
mod m { fn deep() {} }
'''


@pytest.fixture(scope="module")
def code(spark):
    files = spark.createDataFrame([(1, TEXT), (2, "fn f( { }"), (3, "")], "file_id long, text string")
    toks = lexing.tokens(files)
    return files, toks, lexing.items(toks)


def values(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_bindings(code):
    got = values(scopes.base_bindings(code[2]).filter("file_id = 1"), "name", "ns", "module_id")
    m = TEXT.index("mod m")
    assert got == sorted([("Point", "t", None), ("Point", "v", None), ("E", "t", None), ("rec", "v", None), ("m", "t", None), ("deep", "v", m)], key=str)


def test_headers_and_members(code):
    files, toks, items = code
    assert values(scopes.impl_headers(items, toks), "self_name", "trait_name", "is_negative") == [("Point", None, False), ("Wrapper", "Display", False)]
    assert values(scopes.struct_fields(toks, items), "ordinal", "name") == [(0, "x"), (1, "y"), (2, "z")]
    assert values(scopes.enum_variants(toks, items), "index", "name") == [(0, "A"), (1, "B"), (2, "C"), (3, "D")]
    sites = values(scopes.signature_sites(toks, items).filter("site_kind = 'declaration'"), "name")
    assert sites == [(n,) for n in ("E", "Point", "deep", "f", "new", "rec")]


def test_bindings_and_hints(spark, code):
    lets = scopes.let_bindings(code[1])
    assert values(lets, "name", "annotated", "ty") == [("n", False, "u8"), ("p", False, "Point"), ("q", False, "Point"), ("s", False, "&str"), ("w", True, "Vec")]
    assert [r.label for r in scopes.type_hints(lets).collect()] == [": Point", ": u8", ": &str", ": Point"]
    end = TEXT.index("n = 5u8") + 1
    asked = spark.createDataFrame([(1, end, end)], "file_id long, lo long, hi long")
    assert [r.label for r in scopes.type_hints(lets, asked).collect()] == [": u8"]


def test_completion_sites(spark, code):
    marks = [("p. }", 2), ("foo::ba", 7), ("io::Re", 6), ("1, y", 4), ("make", 2), ("std::io", 1)]
    cursors = spark.createDataFrame([(k, 1, TEXT.index(s) + o) for k, (s, o) in enumerate(marks)], "query_id int, file_id long, offset long")
    got = values(scopes.completion_sites(cursors, code[1], code[2]), "query_id", "site_kind", "prefix", "qualifier")
    assert got == [(0, "dot", "", "p"), (1, "path", "ba", "foo"), (2, "use_path", "Re", "io"), (3, "record_field", "y", "Point"), (4, "unqualified", "ma", None), (5, "use_root", "s", None)]


def test_macros(spark, code):
    assert values(scopes.macro_calls(code[1]), "name", "disposition") == [("my", "expand"), ("println", "ignore")]
    calls = spark.createDataFrame([(k, 1, 7, 9, name, n) for k, (name, n) in enumerate([("a", 5), ("a", 1), ("b", 5), ("c", 5), ("d", 5)])], "call_id int, file_id long, module_id long, target_id long, name string, n int")
    textual = spark.createDataFrame([(1, "a", 1, 10), (1, "a", 3, 11)], "file_id long, name string, n int, def_id long")
    module = spark.createDataFrame([(7, "a", 20), (7, "b", 21), (7, "c", 22), (7, "c", 23)], "module_id long, name string, def_id long")
    extern = spark.createDataFrame([(9, "c", 30), (9, "d", 31)], "target_id long, name string, def_id long")
    assert values(scopes.macro_definitions_for_calls(calls, textual, module, extern), "call_id", "def_id") == [(0, 11), (1, 20), (2, 21), (3, 30), (4, 31)]


def test_extern_roots_and_preludes(spark):
    targets = spark.createDataFrame([(1, 0, "my-lib", "lib", "2021"), (1, 1, "tool", "bin", "2021"), (1, 2, "b", "build", None)], "package_slot int, target_id int, name string, kind string, edition string")
    deps = spark.createDataFrame([(1, 5, "x-y", True, False, False, 0), (1, 6, "x_y", True, False, False, 1), (1, 7, "cc", False, True, False, 2)], "package_slot int, dep_slot int, name string, is_normal boolean, is_build boolean, is_dev boolean, dep_order int")
    got = values(scopes.implicit_extern_roots(targets, deps, dependency_applies(F.col("kind"))), "target_id", "name", "root_slot")
    assert got == sorted([(0, "x_y", 6), (1, "my_lib", 1), (1, "x_y", 6), (2, "my_lib", 1), (2, "cc", 7)], key=str)
    assert values(scopes.prelude_paths(targets), "target_id", "segments")[2] == (2, ["std", "prelude", "rust_2015"])


def test_routing_and_common_items(spark, code):
    docs = spark.createDataFrame([("/w/a/src/x.rs",), ("/w/b.rs",), ("/z.rs",)], "path string")
    opened = spark.createDataFrame([("/w/b.rs", "one")], "path string, engine string")
    roots = spark.createDataFrame([("/w", "w"), ("/w/a", "wa")], "root string, engine string")
    assert values(scopes.routed(docs, opened, roots, "last"), "path", "engine") == [("/w/a/src/x.rs", "wa"), ("/w/b.rs", "one"), ("/z.rs", "last")]
    pairs = spark.createDataFrame([(1, 1, TEXT.index("let p"), TEXT.index("let q")), (2, 1, TEXT.index("fn f"), TEXT.index("where"))], "pair_id int, file_id long, left long, right long")
    assert values(scopes.lowest_common_items(pairs, code[2]), "pair_id", "item_id") == [(1, TEXT.index("fn f(&self")), (2, TEXT.index("impl<T"))]
    assert values(scopes.unbalanced(code[1]), "file_id") == [(2,)]
