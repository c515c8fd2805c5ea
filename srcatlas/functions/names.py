"""Names, kinds, sort keys and rendered labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbol kinds in the order in which results rank them.
KINDS = "module struct union enum trait function type_alias const static field enum_variant macro impl".split()
# Primitive types of the analysed language.
PRIMITIVES = "bool char str i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64".split()
# Keywords by where they may start.
KEYWORDS = {
    "item": "fn struct enum union trait impl mod use const static type extern pub unsafe async macro_rules".split(),
    "statement": "let if match while loop for return break continue unsafe async move".split(),
    "expression": "if match while loop for return break continue unsafe async move true false self crate super".split(),
    "type": "dyn impl fn self Self crate super".split(),
}


def rank_of(kind: Column, order: list[str] = KINDS) -> Column:
    """Place of a kind in a fixed order; unknown kinds come last."""
    out = F.lit(len(order))
    for i, k in reversed(list(enumerate(order))):
        out = F.when(kind == k, i).otherwise(out)
    return out


def symbol_matches(name: Column, needle: Column) -> Column:
    """C.14: an empty needle matches all, else a case-insensitive substring."""
    return (needle == "") | F.contains(F.lower(name), F.lower(needle))


def completion_sort_key(bucket: Column, label: Column, kind: Column, applicability: Column, target: Column) -> Column:
    """I.21: bucket, lower-case label, kind, applicability, target in one string that sorts as they do."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat_ws("|", pad(bucket, 2), F.lower(label), pad(kind, 2), pad(applicability, 1), pad(target, 6))


def call_snippet(name: Column, params: Column, has_parens: Column) -> Column:
    """I.20: name(${1:a}, ${2:b}); self is skipped, snippet marks are escaped, parentheses never doubled."""
    shown = F.filter(params, lambda p: ~p.isin("self", "&self", "&mut self", "mut self"))
    holes = F.transform(shown, lambda p, i: F.concat(F.lit("${"), (i + 1).cast("string"), F.lit(":"), F.regexp_replace(p, r"([$}\\])", r"\\$1"), F.lit("}")))
    return F.when(has_parens, name).otherwise(F.concat(name, F.lit("("), F.array_join(holes, ", "), F.lit(")")))


def type_label(kind: Column, name: Column, args: Column) -> Column:
    """J.4: a type's label, with arguments if there are some; null when unknown."""
    full = F.when(F.size(args) > 0, F.concat(name, F.lit("<"), F.array_join(args, ", "), F.lit(">"))).otherwise(name)
    return (
        F.when(kind == "unknown", F.lit(None)).when(kind == "never", F.lit("!")).when(kind == "unit", F.lit("()"))
        .when(kind == "reference", F.concat(F.lit("&"), full)).otherwise(full)
    )


def signature(kind: Column, name: Column, visibility: Column, params: Column, result: Column) -> Column:
    """J.1: one-line signature of a definition."""
    lead = F.when(visibility.isNull() | (visibility == "private"), F.lit("")).otherwise(F.concat(visibility, F.lit(" ")))
    call = F.concat(F.lit("fn "), name, F.lit("("), F.array_join(params, ", "), F.lit(")"), F.when(result.isNull(), F.lit("")).otherwise(F.concat(F.lit(" -> "), result)))
    word = F.when(kind == "type_alias", "type").when(kind == "module", "mod").when(kind.isin("field", "enum_variant"), "").otherwise(kind)
    typed = F.when(kind.isin("const", "static", "field") & result.isNotNull(), F.concat(F.lit(": "), result)).when((kind == "type_alias") & result.isNotNull(), F.concat(F.lit(" = "), result)).otherwise(F.lit(""))
    return F.concat(lead, F.when(kind == "function", call).otherwise(F.concat(word, F.when(word == "", F.lit("")).otherwise(F.lit(" ")), name, typed)))


def capped_list(members: Column, most: int) -> Column:
    """J.2: at most `most` members, then a line that says how many are left out."""
    more = F.size(members) - most
    return F.when(more > 0, F.concat(F.slice(members, 1, most), F.array(F.concat(F.lit("/* … "), more.cast("string"), F.lit(" more */"))))).otherwise(members)


def doc_markdown(docs: Column) -> Column:
    """J.6: code fences without a language become rust ones, hidden lines of examples go."""
    shown = F.regexp_replace(docs, r"(?m)^\s*# .*(?:\n|$)", "")
    return F.regexp_replace(shown, r"(?m)^```(?:ignore|no_run|should_panic|compile_fail)?\n((?:(?!```).*\n)*?)```", "```rust\n$1```")


def fingerprint(domain: str, *fields: Column) -> Column:
    """J.10: SHA-256 over a domain name and length-tagged fields; null differs from the empty string."""
    tagged = [F.when(f.isNull(), F.lit("-;")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"), F.lit(";"))) for f in fields]
    return F.sha2(F.concat(F.lit(domain + "\n"), *tagged), 256)
