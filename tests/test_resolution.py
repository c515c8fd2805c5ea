"""What names of real code mean: modules over files, imports, shadowing, members; each cursor has one answer."""

from __future__ import annotations

import pytest

from srcatlas.api import Analysis

LIB = '''mod shapes;
mod util { pub fn helper(n: u8) -> u8 { n } pub fn both() {} pub(in crate::util) fn hid() {} pub mod deep { pub fn leaf() { super::helper(1); } } }
pub mod prelude { pub use crate::shapes::Point as Dot; pub use crate::util::*; }
use prelude::{Dot, helper as help, deep};
use shapes::Kind::{self, Round};
use outer::Thing;
fn both() {}
fn user(d: Dot, k: &mut Kind) -> Result<Vec<u8>, ()> {
    let x = 1; let x = x;
    { let x = "s"; x; }
    x; both(); util::both(); help(2); d.len(); d.x; k.name(); Kind::Square; Round; deep::leaf(); Thing::new(); Dot::zero(); self::both();
    outer::Thing; missing(); d.area(); local(); util::hid();
    fn local() {}
}
fn other(x: u8) { x; both(); }
'''
SHAPES = '''pub struct Point { pub x: f64 }
impl Point { pub fn len(&self) -> f64 { self.x } pub fn zero() -> Self { Self::zero() } }
pub enum Kind { Round, Square }
impl Kind { fn name(&self) -> &str { "" } }
pub trait Area { fn area(&self) -> f64 { 0.0 } fn all(&self) {} }
impl Area for super::shapes::Point { fn all(&self) { self.len(); } }
fn x() {}
'''
OUTER = "pub struct Thing; impl Thing { pub fn new() -> Thing { Thing } }\n"
PATTERNS = '''fn count() {} fn item() {} fn other() {}
const LIMIT: u8 = 3;
pub(in crate::deep::er) fn limited() {}
enum Kind { Round, Square(u8), Named { n: u8 } }
use Kind::Round;
struct Pair(pub u8, pub(crate) Vec<(u8, String)>);
struct Point { x: u8, y: u8 }
impl Other for Holder<A<B<C<D<u8>>>>> { fn held(&self) { self.inside; } }
struct Holder<T> { inside: T }
trait Other {}
fn loops(v: Vec<u8>, pair: Pair, (left, right): (u8, u8), Point { x, y: why }: Point) {
    for count in v { count /*1*/; }
    if let Some(item) = item /*2*/ { item /*3*/; } else { item /*4*/ (); }
    v.map(|item| item /*5*/ + left /*6*/);
    let (count, other) = pair; count /*7*/; other /*8*/;
    pair.0 /*9*/; pair.1 /*10*/; why /*11*/; x /*12*/; right /*13*/;
    while let Some(Kind::Square(w)) = next() { w /*14*/; }
    let Some(late) = late /*15*/ else { return; }; late /*16*/;
    match v { Round /*17*/ => count /*18*/, Kind::Square(s) | Kind::Named { n: s /*19*/ } if s /*20*/ > 1 => s /*21*/, LIMIT /*22*/ => 1, other @ 1..=4 => { other /*23*/ } _ => other /*24*/ };
    let fold = v.fold(0, move |acc, (a, b): (u8, u8)| { let acc = acc /*25*/ + a; acc /*26*/ + b /*27*/ }); acc /*28*/;
    a || b; if let Kind::Named { n } = k && n /*29*/ > 1 { n /*30*/; }
    fn nested(p: u8) { count /*31*/; p /*32*/; other /*33*/; limited /*34*/ (); }
}
'''
TEXTS = {1: LIB, 2: SHAPES, 3: OUTER, 4: PATTERNS}


@pytest.fixture(scope="module")
def code(spark):
    rows = [(1, "/a/src/lib.rs", LIB), (2, "/a/src/shapes.rs", SHAPES), (3, "/b/src/lib.rs", OUTER), (4, "/c/src/lib.rs", PATTERNS)]
    extern = spark.createDataFrame([(1, "outer", 3)], "file_id long, name string, root_file long")
    return Analysis(spark.createDataFrame(rows, "file_id long, path string, text string"), extern)


def place(file: int, text: str, word: str) -> int:
    """Where the word stands inside the only occurrence of text in a file."""
    assert TEXTS[file].count(text) == 1, text
    return TEXTS[file].index(text) + text.index(word)


def ask(spark, cursors):
    return spark.createDataFrame([(k, f, at) for k, (f, at) in enumerate(cursors)], "query_id int, file_id long, offset long")


def test_goto_definition(spark, code):
    cases = [
        ((1, " x;\n    { let", "x"), (1, "{\n    let x = 1", "x")), ((1, '"s"; x;', "x"), (1, 'let x = "s"', "x")), ((1, "    x; both()", "x"), (1, "1; let x", "x")),
        ((1, "x; both(); util", "both"), (1, "\nfn both", "both")), ((1, "util::both", "both"), (1, "} pub fn both", "both")), ((1, "help(2)", "help"), (1, "pub fn helper", "helper")),
        ((1, "d.len", "len"), (2, "pub fn len", "len")), ((1, "d.x", "x"), (2, "pub x: f64", "x")), ((1, "k.name", "name"), (2, "fn name", "name")),
        ((1, "Kind::Square", "Square"), (2, "Square }", "Square")), ((1, "Square; Round", "Round"), (2, "{ Round", "Round")), ((1, "deep::leaf", "leaf"), (1, "pub fn leaf", "leaf")),
        ((1, "deep::leaf", "deep"), (1, "pub mod deep", "deep")), ((1, "Thing::new", "new"), (3, "pub fn new", "new")), ((1, "Thing::new", "Thing"), (3, "struct Thing", "Thing")),
        ((1, "Dot::zero", "zero"), (2, "pub fn zero", "zero")), ((1, "self::both", "both"), (1, "\nfn both", "both")), ((1, "outer::Thing; m", "Thing"), (3, "struct Thing", "Thing")),
        ((1, "missing", "missing"), None), ((1, "d.area", "area"), (2, "fn area", "area")), ((1, " local(); util", "local"), (1, "fn local", "local")), ((1, "{ x; both", "x"), (1, "other(x", "x")),
        ((1, "super::helper", "helper"), (1, "pub fn helper", "helper")), ((1, "user(d: Dot", "Dot"), (2, "struct Point", "Point")), ((1, "Point as Dot", "Dot"), (2, "struct Point", "Point")),
        ((1, "helper as", "helper"), (1, "pub fn helper", "helper")), ((2, "self.x", "x"), (2, "pub x: f64", "x")), ((2, "Self::zero", "zero"), (2, "pub fn zero", "zero")),
        ((2, "self.len", "len"), (2, "pub fn len", "len")), ((2, "shapes::Point", "Point"), (2, "struct Point", "Point")), ((1, "Kind::{self", "Kind"), (2, "enum Kind", "Kind")), ((2, "fn x()", "x"), (2, "fn x()", "x")),
    ]
    got = {}
    for r in code.goto_definition(ask(spark, [(c[0], place(*c)) for c, _ in cases])).collect():
        got.setdefault(r.query_id, []).append((r.def_file, r.name_start))
    want = {k: [(d[0], place(*d))] for k, (_, d) in enumerate(cases) if d}
    assert {cases[k][0]: (got.get(k), want.get(k)) for k in range(len(cases)) if got.get(k) != want.get(k)} == {}


#: Marks of PATTERNS and what stands right before the definition's name; None: no definition.
BOUND = {
    1: "for count", 2: "} fn item", 3: "Some(item", 4: "} fn item", 5: "map(|item", 6: "(left", 7: "let (count", 8: "let (count, other", 9: "Pair(pub u8", 10: "pub(crate) Vec", 11: "y: why", 12: "(left, right): (u8, u8), Point { x",
    13: "(left, right", 14: "Square(w", 15: None, 16: "let Some(late", 17: "Kind { Round", 18: "let (count", 19: "Square(s", 20: "Square(s", 21: "Square(s", 22: "const LIMIT", 23: "1, other", 24: "let (count, other", 25: "|acc", 26: "let acc",
    27: "|acc, (a, b", 28: None, 29: "Named { n } = k", 30: "Named { n } = k", 31: "fn count", 32: "nested(p", 33: "fn other", 34: "fn limited",
}


def test_names_bound_by_patterns(spark, code):
    at = {k: PATTERNS.index(f"/*{k}*/") - 2 for k in BOUND}
    got = {r.query_id: (r.def_file, r.name_start) for r in code.goto_definition(spark.createDataFrame([(k, 4, o) for k, o in at.items()], "query_id int, file_id long, offset long")).collect()}

    def name_at(before: str) -> int:
        assert PATTERNS.count(before) == 1, before
        end = PATTERNS.index(before) + len(before.removesuffix(" } = k"))
        start = end
        while PATTERNS[start - 1].isalnum():
            start -= 1
        return start

    want = {k: (4, name_at(b)) for k, b in BOUND.items() if b}
    assert {k: (got.get(k), want.get(k)) for k in BOUND if got.get(k) != want.get(k)} == {}


def test_headers_of_any_depth(code):
    inside = PATTERNS.index("self.inside") + 5
    spark = code.files.sparkSession
    (r,) = code.goto_definition(spark.createDataFrame([(1, 4, inside)], "query_id int, file_id long, offset long")).collect()
    assert r.name_start == PATTERNS.index("inside: T")


def test_references_hover_types(spark, code):
    at = ask(spark, [(2, place(2, "struct Point", "Point")), (1, place(1, "\nfn both", "both"))])
    got = {(r.query_id, r.file_id, r.span_start) for r in code.references(at).collect()}
    spots = [(1, "Point as Dot", "Point"), (1, "Point as Dot", "Dot"), (1, "{Dot", "Dot"), (1, "d: Dot", "Dot"), (1, "Dot::zero", "Dot"), (2, "impl Point", "Point"), (2, "shapes::Point", "Point")]
    calls = [(1, "x; both(); util", "both"), (1, "self::both", "both"), (1, "x; both(); }", "both")]
    assert got == {(0, s[0], place(*s)) for s in spots} | {(1, s[0], place(*s)) for s in calls}
    assert code.references(at, True).count() == len(got) + 2
    hover = {r.query_id: r.signature for r in code.hover(ask(spark, [(1, place(1, "help(2)", "help")), (1, place(1, "fn user", "user")), (2, place(2, "pub fn len", "len"))])).collect()}
    assert hover == {0: "pub fn helper(n: u8) -> u8", 1: "fn user(d: Dot, k: &mut Kind) -> Result<Vec<u8>, ()>", 2: "pub fn len(&self) -> f64"}
    marks = ask(spark, [(1, place(1, '"s"; x;', "x")), (1, place(1, "    x; both()", "x")), (1, place(1, "{ x; both", "x")), (1, place(1, "d.len", "d"))])
    assert {r.query_id: r.ty for r in code.type_at(marks).collect()} == {0: "&str", 1: "unknown", 2: "u8", 3: "Dot"}
    assert [(r.query_id, r.ty) for r in code.goto_type_definition(marks).collect()] == [(3, "Point")]
    assert {(r.query_id, r.impl_id) for r in code.goto_implementation(ask(spark, [(1, place(1, "d: Dot", "Dot")), (2, place(2, "trait Area", "Area"))])).collect()} == {(0, place(2, "impl Point", "impl")), (0, place(2, "impl Area", "impl")), (1, place(2, "impl Area", "impl"))}


def test_scopes_are_visible_ones(code):
    rows = {(r.module_id, r.name) for r in code.names.scopes.collect()}
    prelude = f"1:{place(1, 'pub mod prelude', 'mod')}"
    assert {n for m, n in rows if m == prelude} == {"Dot", "helper", "both", "deep"}
    assert {n for m, n in rows if m == "1:"} >= {"Dot", "help", "deep", "Kind", "Round", "Thing", "both", "user"} and ("1:", "hid") not in rows


def test_completions(spark, code):
    c = ask(spark, [(1, place(1, "help(2)", "help") + 3), (1, place(1, "d.len", "len") + 1), (1, place(1, "Kind::Square", "Square") + 1)])
    assert [(r.label, r.kind) for r in code.completions_at(c).collect() if r.query_id == 0] == [("help", "function")]
    assert {(r.query_id, r.label) for r in code.member_completions(c).collect() if r.query_id} == {(1, "len"), (2, "Square")}


def test_no_files(spark):
    empty = Analysis(spark.createDataFrame([], "file_id long, path string, text string"))
    assert empty.goto_definition(spark.createDataFrame([], "query_id int, file_id long, offset long")).count() == 0
