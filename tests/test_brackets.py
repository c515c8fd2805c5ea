"""Bracket pairs, heads of any length, visibility of any length, parts."""

from __future__ import annotations

from srcatlas.operators import binders, brackets, lexing, scopes


def table(spark, *texts):
    toks = lexing.tokens(spark.createDataFrame(list(enumerate(texts)), "file_id long, text string"))
    near = brackets.structure(toks).cache()
    return near, lexing.items(near).cache()


def test_partners_and_surroundings(spark):
    text = "a(b[c]{d})) e (f"
    near, _ = table(spark, text)
    rows = {r.span_start: r for r in near.collect()}
    assert {text[k] + str(k): rows[k].close_start for k in rows if text[k] in "([{"} == {"(1": 9, "[3": 5, "{6": 8, "(14": None}
    assert {text[k]: rows[k].open_start for k in rows if text[k].isalpha()} == {"a": None, "b": 1, "c": 3, "d": 6, "e": None, "f": 14}
    assert rows[3].after_close == "{" and rows[4].open_prev == "b"
    assert brackets.structure(near) is near


def test_a_head_of_a_hundred_thousand_tokens(spark):
    many = ", ".join(["u8"] * 50_000)
    deep = "Vec<" * 2_000 + "u8" + ">" * 2_000
    text = f"fn long(a: ({many}), b: {deep}) -> {deep} where T: X {{}}\nstruct S({many});\nimpl Tr for {deep} {{}}\npub(in {'a::' * 20_000}b) fn shown() {{}}\n"
    near, found = table(spark, text)
    assert {(r.kind, r.name) for r in found.collect()} == {("function", "long"), ("struct", "S"), ("impl", None), ("function", "shown")}
    assert [r.visibility for r in found.filter("name = 'shown'").collect()] == [f"pub(in{'a::' * 20_000}b)"]
    (head,) = binders.heads_of(binders.function_parts(near, found)).filter("result is not null").collect()
    assert head.params == [f"a: ({many})", f"b: {deep}"] and head.result == deep
    assert scopes.struct_fields(near, found).count() == 50_000
    (impl,) = scopes.impl_headers(found, near).collect()
    assert (impl.self_path, impl.trait_path) == (["Vec"], ["Tr"])


def test_items_behind_modifiers_and_attributes(spark):
    text = '#![a]\n#[b(c)] pub(in crate::x::y::z) unsafe extern "C" fn one() {}\npub(super) default async fn two();\nconst fn three() {}\nconst N: fn(u8) -> u8 = f;\nextern "C" { fn four(); }\nlet x = S { union: 1 };\nfn five(f: fn(u8), g: impl Fn()) { type A = u8; }\nextern crate z;'
    _, found = table(spark, text)
    got = [(r.kind, r.name, r.visibility) for r in found.orderBy("span_start").collect()]
    assert got == [
        ("function", "one", "pub(incrate::x::y::z)"), ("function", "two", "pub(super)"), ("function", "three", "private"), ("const", "N", "private"), ("function", "four", "private"),
        ("function", "five", "private"), ("type_alias", "A", "private"), ("extern_crate", "z", "private"),
    ]


def test_members_by_name_and_place(spark):
    text = "struct A(#[x(y)] pub u8, pub(crate) (B, C), fn(u8) -> D<E, F>,); struct G<T: H<I>> { r#type: &'a mut J<K, L>, pub n: [M; 3], } enum O { P = 1, #[q] Q(R, S), T { u: V }, } struct W; union X { a: u8 }"
    near, found = table(spark, text)
    rows = [(r.type_kind, r.ordinal, r.name, r.ty, r.type_path) for r in scopes.members(near, found).orderBy("type_id", "ordinal").collect()]
    assert rows == [
        ("struct", 0, "0", "u8", ["u8"]), ("struct", 1, "1", "(B, C)", None), ("struct", 2, "2", "fn(u8) -> D<E, F>", None), ("struct", 0, "type", "&'a mut J<K, L>", ["J"]), ("struct", 1, "n", "[M; 3]", None),
        ("enum", 0, "P", None, None), ("enum", 1, "Q", None, None), ("enum", 2, "T", None, None), ("union", 0, "a", "u8", ["u8"]),
    ]
