"""Real code tables: lexer, items, sources, the public queries, streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from srcatlas.api import Analysis
from srcatlas.functions.cfg import evaluate
from srcatlas.functions.spans import byte_column, span_text, utf16_column
from srcatlas.operators import lexing
from srcatlas.sources import artifacts, code
from srcatlas.streaming import documents

LIB = '''//! crate docs
use std::{fmt::{self, Display as D}, io::*};
/// A point.
/// Second line.
#[derive(Debug)]
pub struct Point { pub x: f64, y: [i32; 4] }
#[cfg(all(test, feature = "a"))]
mod inner { pub(crate) fn deep() -> char { '}' } }
mod other;
impl Point { pub const N: usize = 3; pub async fn len(&self) -> f64 { let s = "{;"; /* { */ self.x } }
pub trait Shape { type Out; fn area(&self) -> f64; }
pub unsafe extern "C" fn raw<'a>(p: &'a str) -> u8 { b'x' }
macro_rules! m { () => {}; }
const fn k() -> i32 { 1 }
static S: &str = r#"a "quoted" }"#;
enum E { A, B(i32) }
fn user() -> Point { let p: Point = make(); p }
'''


@pytest.fixture(scope="module")
def files(spark):
    rows = [(1, "/w/src/lib.rs", LIB), (2, "/w/src/other.rs", "pub fn o() {}\nmod sub;"), (3, "/w/src/other/sub.rs", "use super::o as _;\r\nfn é() {}"), (4, "/w/src/e.rs", ""), (5, "/w/src/bad.rs", 'fn f() { "never shut')]
    return spark.createDataFrame(rows, "file_id long, path string, text string")


@pytest.fixture(scope="module")
def analysis(files):
    return Analysis(files)


def test_tokens_are_the_text(analysis, files):
    texts = {r.file_id: r.text for r in files.collect()}
    got = {}
    for r in analysis.tokens.orderBy("file_id", "n").collect():
        assert r.span_start == len(got.get(r.file_id, "").encode())
        got[r.file_id] = got.get(r.file_id, "") + r.token
    assert got == {i: t for i, t in texts.items() if t}
    kinds = {r.token: r.kind for r in analysis.tokens.collect()}
    assert {kinds[t] for t in ("'a", "'}'", "b'x'", 'r#"a "quoted" }"#', '"{;"', "3", "/* { */", "Point", "{", "\n")} == {"lifetime", "char", "string", "number", "comment", "ident", "punct", "whitespace"}
    assert [(r.file_id, r.error) for r in lexing.lexical_errors(analysis.tokens).collect()] == [(5, "unterminated")]


def nested(op: str, levels: int) -> str:
    return "{" + f'"op":"{op}","args":[' + (nested(op, levels - 1) if levels else '{"op":"atom","key":"windows"}') + "]}"


def test_very_long_tokens(spark):
    """Literals and comments of 1 MB, and nested comments, are one token each."""
    mb = 1 << 20
    parts = ['"' + 'x\\"' * (mb // 3) + '"', "r##\"" + 'y"# ' * (mb // 4) + '"##', "/*" + "z*" * (mb // 2) + "*/", "//" + "w" * mb, "/* a /* b /* c /* d */ c */ b */ a */", "v" * mb, " " * mb, "'a'"]
    files = spark.createDataFrame([(1, "\n".join(parts)), (2, '"' + "x" * mb), (3, "/* /* */")], "file_id long, text string")
    toks = lexing.tokens(files)
    got = [r.token for r in toks.filter("file_id = 1").orderBy("n").collect()]
    assert "".join(got) == "\n".join(parts) and [t for t in got if t.strip(" ") != "\n" and not t.isspace()] == [p for p in parts if not p.isspace()]
    assert {r.file_id for r in lexing.lexical_errors(toks).collect()} >= {2}


def test_long_and_deep_gates(spark):
    long = "any(" + ", ".join(f'feature = "f{k}"' for k in range(2000)) + ")"
    deep = "all(" * 9 + "unix" + ")" * 9
    text = f"#[cfg({long})]\nfn a() {{}}\n#[cfg({deep})]\nmod b {{ fn c() {{}} }}\n"
    toks = lexing.tokens(spark.createDataFrame([(1, text)], "file_id long, text string"))
    found = lexing.items(toks)
    gates = {r.item_id: json.loads(r.gate) for r in lexing.cfg_gates(toks, found).collect()}
    assert set(gates) == {text.index("fn a"), text.index("mod b")} and len(gates[text.index("fn a")]["args"]) == 2000
    d = spark.createDataFrame([(nested("all", 8), False), (nested("not", 8), True), (nested("not", 9), False)], "gate string, want boolean")
    got = d.select("want", evaluate(F.parse_json("gate"), F.array(F.lit("unix")), F.array(F.lit("x")), F.lit(True)).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_items(analysis):
    got = [(r.kind, r.name, r.visibility, r.is_inline, r.parent_kind) for r in analysis.items.filter("file_id = 1").orderBy("span_start").collect()]
    assert got == [
        ("use", None, "private", False, None), ("struct", "Point", "pub", True, None), ("module", "inner", "private", True, None), ("function", "deep", "pub(crate)", True, "module"),
        ("module", "other", "private", False, None), ("impl", None, "private", True, None), ("const", "N", "pub", False, "impl"), ("function", "len", "pub", True, "impl"),
        ("trait", "Shape", "pub", True, None), ("type_alias", "Out", "private", False, "trait"), ("function", "area", "private", False, "trait"), ("function", "raw", "pub", True, None),
        ("macro", "m", "private", True, None), ("function", "k", "private", True, None), ("static", "S", "private", False, None), ("enum", "E", "private", True, None), ("function", "user", "private", True, None),
    ]


def test_docs_modules_uses_gates(analysis, files):
    assert [(r.item_id, r.docs) for r in lexing.item_docs(analysis.tokens, analysis.items).orderBy(F.col("item_id").desc_nulls_last()).collect()] == [(LIB.index("struct Point"), "A point.\nSecond line."), (None, "crate docs")]
    assert {(r.name, r.module_file) for r in analysis.module_links.collect()} == {("other", 2), ("sub", 3)}
    uses = {(tuple(r.segments), r.binding, r.import_kind) for r in lexing.use_leaves(analysis.items, analysis.tokens).collect()}
    assert uses == {(("std", "fmt"), None, "self"), (("std", "fmt", "Display"), "D", "named"), (("std", "io"), None, "glob"), (("super", "o"), "_", "named")}
    (gate,) = lexing.cfg_gates(analysis.tokens, analysis.items).collect()
    assert gate.item_id == LIB.index("mod inner") and json.loads(gate.gate) == {"op": "all", "args": [{"op": "atom", "key": "test"}, {"op": "kv", "key": "feature", "value": "a"}]}


@pytest.mark.parametrize("text, want", [("a::{b, c::*}", [(["a", "b"], None, "named"), (["a", "c"], None, "glob")]), ("use ::x as y;", [(["x"], "y", "named")]), ("{a, b::{self as c}}", [(["a"], None, "named"), (["b"], "c", "self")]), ("*", [([], None, "glob")])])
def test_use_trees(text, want):
    assert list(lexing.flatten_use(text)) == want


def test_cfg_truth(spark):
    cases = [
        ('{"op":"atom","key":"unix"}', True), ('{"op":"atom","key":"windows"}', False), ('{"op":"atom","key":"test"}', True), ('{"op":"kv","key":"os","value":"linux"}', True),
        ('{"op":"not","args":[{"op":"atom","key":"unix"}]}', False), ('{"op":"not","args":[]}', True), ('{"op":"all","args":[]}', True), ('{"op":"any","args":[]}', False), ('{"op":"odd"}', True), ("{}", True),
        ('{"op":"all","args":[{"op":"atom","key":"unix"},{"op":"not","args":[{"op":"any","args":[{"op":"atom","key":"windows"},{"op":"false"}]}]}]}', True),
    ]
    d = spark.createDataFrame(cases, "gate string, want boolean")
    got = d.select("gate", "want", evaluate(F.parse_json("gate"), F.array(F.lit("unix")), F.array(F.lit("os=linux")), F.lit(True)).alias("got")).collect()
    assert [(r.gate, r.got) for r in got] == cases


def test_utf16(spark):
    d = spark.createDataFrame([("a𝄞é", 0, 0), ("a𝄞é", 1, 1), ("a𝄞é", 5, 3), ("a𝄞é", 7, 4), ("a𝄞é", 99, 4)], "line string, byte int, units int")
    assert [r.u for r in d.select(utf16_column(F.col("line"), F.col("byte")).alias("u")).collect()] == [0, 1, 3, 4, 4]
    back = spark.createDataFrame([("a𝄞é", u) for u in (0, 1, 2, 3, 4, 9)], "line string, u int")
    assert [r.b for r in back.select(byte_column(F.col("line"), F.col("u")).alias("b")).collect()] == [0, 1, None, 5, 7, 7]
    spans = spark.createDataFrame([("aéb", 0, 1), ("aéb", 1, 3), ("aéb", 1, 2), ("aéb", 3, 9)], "t string, a int, b int")
    assert [r.s for r in spans.select(span_text(F.col("t"), F.col("a"), F.col("b")).alias("s")).collect()] == ["a", "é", None, None]


def test_queries(spark, analysis):
    at = LIB.index("Point = make")
    cursors = spark.createDataFrame([(1, 1, at + 2), (2, 1, at + 5), (3, 2, 8)], "query_id int, file_id long, offset long")
    assert {r.query_id: r.name for r in analysis.symbol_at(cursors).collect()} == {1: "Point", 2: "Point", 3: "o"}
    assert {(r.query_id, r.def_file, r.item_id) for r in analysis.goto_definition(cursors).collect()} == {(1, 1, LIB.index("struct Point")), (2, 1, LIB.index("struct Point")), (3, 2, 4)}
    assert {(r.query_id, r.signature, r.docs) for r in analysis.hover(cursors).collect()} >= {(1, "pub struct Point", "A point.\nSecond line.")}
    names = spark.createDataFrame([(7, "Point")], "query_id int, name string")
    spelled = [r.span_start for r in analysis.occurrences(names).collect()]
    assert spelled == [LIB.index("impl Point") + 5, LIB.index("-> Point") + 3, at] and len(analysis.occurrences(names, True).collect()) == 4
    one = cursors.filter("query_id = 1")
    assert [r.span_start for r in analysis.references(one).collect()] == spelled and len(analysis.references(one, True).collect()) == 4
    found = [r.name for r in analysis.workspace_symbols(spark.createDataFrame([(1, "E")], "query_id int, needle string")).collect()]
    assert found == ["area", "deep", "E", "inner", "len", "other", "Shape", "user"]
    outline = analysis.document_symbols(spark.createDataFrame([(2,)], "file_id long")).collect()
    assert [(r.kind, r.name) for r in outline] == [("function", "o"), ("module", "sub")]
    c = spark.createDataFrame([(1, 1, at + 2)], "query_id int, file_id long, offset long")
    assert [r.label for r in analysis.completions_at(c).collect()] == ["Point"]
    where = analysis.locations(spark.createDataFrame([(3, 20), (3, 23)], "file_id long, span_start long")).orderBy("span_start").collect()
    assert [(r.line, r["column"], r.path) for r in where] == [(1, 0, "/w/src/other/sub.rs"), (1, 3, "/w/src/other/sub.rs")]
    assert [r.kind for r in analysis.enclosing_items(spark.createDataFrame([(1, 1, LIB.index("'}'"))], "query_id int, file_id long, offset long")).collect()] == ["function", "module"]


def test_types_members_and_updates(spark):
    text = "struct Point { pub x: f64, y: i32 }\nenum E { Aa, Bb }\nimpl Point { fn len(&self) {} fn new() -> Self { Point { x: 1.0, y } } }\nimpl Shape for Point {}\ntrait Shape { fn area(&self); }\nfn user() { let p = Point::new(); p.l; E::A; let q = p; }\n"
    files = spark.createDataFrame([(1, "a.rs", text), (2, "b.rs", "fn other() {}")], "file_id long, path string, text string")
    a = Analysis(files)
    cursor = lambda *offs: spark.createDataFrame([(k, 1, o) for k, o in enumerate(offs)], "query_id int, file_id long, offset long")
    at = text.index("p.l")
    assert [(r.name, r.ty) for r in a.type_at(cursor(at)).collect()] == [("p", "Point")]
    assert [(r.ty, r.item_id) for r in a.goto_type_definition(cursor(at)).collect()] == [("Point", 0)]
    shape, point = text.index("Shape for"), text.index("Point {")
    assert {(r.query_id, r.impl_id) for r in a.goto_implementation(cursor(shape, point)).collect()} == {(0, text.index("impl Shape")), (1, text.index("impl Point")), (1, text.index("impl Shape"))}
    got = {}
    for r in a.member_completions(cursor(at + 3, text.index("E::A") + 4, text.index(", y }") + 2, at + 2)).collect():
        got.setdefault(r.query_id, []).append((r.kind, r.label))
    assert got == {0: [("function", "len")], 1: [("enum_variant", "Aa")], 2: [("field", "x"), ("field", "y")], 3: [("field", "x"), ("field", "y"), ("function", "area"), ("function", "len"), ("function", "new")]}
    b = a.updated(spark.createDataFrame([(2, "b.rs", "fn changed() {}")], "file_id long, path string, text string"))
    names = lambda x: {r.name for r in x.items.filter("file_id = 2").collect()}
    assert names(a) == {"other"} and names(b) == {"changed"} and b.tokens.filter("file_id = 1").count() == a.tokens.filter("file_id = 1").count()


def test_artifacts(spark, tmp_path):
    store = artifacts.ArtifactStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "package_slot int, name string")
    store.write("items", rows, "r1")
    changed = spark.createDataFrame([(2,), (3,)], "package_slot int")
    store.write("items", store.carried_over("items", "r1", "r2", changed).select("package_slot", "name").unionByName(spark.createDataFrame([(2, "d")], "package_slot int, name string")), "r2")
    read = lambda rev, p=None: sorted((r.package_slot, r.name) for r in store.read("items", rev, p).collect())
    assert read("r1") == [(1, "a"), (1, "b"), (2, "c")] and read("r2") == [(1, "a"), (1, "b"), (2, "d")] and read("r2", changed) == [(2, "d")]
    assert [r.package_slot for r in store.missing("items", "r2", changed).collect()] == [3]
    assert len(store.clean(["r2"])) == 1 and read("r2") == [(1, "a"), (1, "b"), (2, "d")] and read("r1") == []


def test_workspace_source(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/lib.rs").write_text("pub fn a() {}")
    (tmp_path / "src/skip.txt").write_text("x")
    meta = {
        "packages": [
            {"id": "a 1", "name": "a", "edition": "2021", "source": None, "manifest_path": f"{tmp_path}/Cargo.toml", "targets": [{"name": "a", "kind": ["lib"], "src_path": f"{tmp_path}/src/lib.rs"}, {"name": "build", "kind": ["custom-build"], "src_path": "b.rs"}], "dependencies": []},
            {"id": "b 1", "name": "b", "edition": "2018", "source": "registry", "manifest_path": "/r/b/Cargo.toml", "targets": [], "dependencies": []},
        ],
        "workspace_members": ["a 1"], "workspace_root": str(tmp_path),
        "resolve": {"nodes": [{"id": "a 1", "deps": [{"name": "b", "pkg": "b 1", "dep_kinds": [{"kind": None}, {"kind": "dev"}]}]}, {"id": "b 1", "deps": []}]},
    }
    (tmp_path / "m.json").write_text(json.dumps(meta, indent=1))
    w = code.Workspace(spark, str(tmp_path / "m.json"))
    assert [(r.name, r.origin) for r in w.packages().orderBy("package_slot").collect()] == [("a", "workspace"), ("b", "dependency")]
    assert [(r.name, r.kind) for r in w.targets().orderBy("target_id").collect()] == [("a", "lib"), ("build", "build")]
    assert [tuple(r) for r in w.dependencies().collect()] == [(0, 1, "b", True, False, True)]
    got = code.source_files(spark, str(tmp_path)).collect()
    assert [r.text for r in got] == ["pub fn a() {}"] and got[0].path.endswith("/src/lib.rs")
    sysroot = spark.createDataFrame([(9, "core")], "package_slot int, name string")
    packages, edges = code.with_sysroot(w.packages(), w.dependencies(), sysroot)
    assert packages.count() == 3 and {(r.package_slot, r.dep_slot) for r in edges.collect()} == {(0, 1), (0, 9), (1, 9)}
    files = spark.createDataFrame([(1, f"{tmp_path}/src/lib.rs"), (2, "/r/b/src/x.rs"), (3, "/else/y.rs")], "file_id long, path string")
    assert {(r.file_id, r.package_slot) for r in code.owning_package(files, w.packages()).collect()} == {(1, 0), (2, 1)}


def test_diagnostics_source(spark, tmp_path):
    span = lambda p, primary: {"file_name": p, "byte_start": 1, "byte_end": 2, "line_start": 1, "is_primary": primary}
    rows = [{"reason": "compiler-message", "message": {"message": "bad", "level": "error", "code": {"code": "E1"}, "spans": [span("a.rs", True), span("b.rs", False)]}}, {"reason": "build-finished"}]
    (tmp_path / "d.json").write_text("\n".join(json.dumps(r) for r in [*rows, rows[0]]))
    assert [tuple(r) for r in code.diagnostics(spark, str(tmp_path / "d.json")).collect()] == [("a.rs", "bad", "error", "E1", 1, 2)]


def test_document_stream(spark, tmp_path):
    events = [
        ("a", 1, "open", 1, "h1"), ("a", 2, "change", 3, "h3"), ("a", 3, "change", 2, "h2"), ("a", 4, "save", None, "h3"), ("b", 5, "open", 1, "x"), ("b", 6, "change", 2, None),
        ("c", 7, "change", 1, "x"), ("d", 8, "open", 1, "y"), ("d", 9, "close", None, None), ("a", 10, "change", 4, "h4"),
    ]
    for k in range(2):  # two files, two micro-batches
        part = spark.createDataFrame(events[k * 5 : k * 5 + 5], documents.EVENT)
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(documents.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = documents.document_states(stream).writeStream.outputMode("update").format("memory").queryName("docs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.sql("select * from docs").collect():
        last[r.path] = max(last.get(r.path, r), r, key=lambda x: (x.version or 0, x.is_dirty)) if r.is_tracked else r
    assert (last["a"].version, last["a"].is_dirty) == (4, True) and last["b"].is_dirty and not last["c"].is_tracked and not last["d"].is_tracked
    assert sum(r.dropped for r in spark.sql("select * from docs").collect()) == 2


def test_debounce_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00.000"), ("a", "2024-01-01 00:00:00.100"), ("a", "2024-01-01 00:00:01.000"), ("b", "2024-01-01 00:00:00.050"), ("z", "2024-01-01 01:00:00.000")]
    spark.createDataFrame(rows, "path string, ts string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, ts timestamp").json(str(tmp_path / "in"))
    q = documents.debounced(stream).writeStream.outputMode("append").format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.path, r.triggers) for r in spark.sql("select * from quiet").collect()} >= {("a", 2), ("a", 1), ("b", 1)}
