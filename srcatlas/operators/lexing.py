"""Tokens and items of Rust text by built-in functions (A.7, A.8, B.1, B.2, B.9-B.17, C.1).

A file's tokens are all matches of one lossless pattern; offsets, depths and neighbours are windows inside the file, and
nesting is an interval join. Items are recognised from keywords at item position, so unknown syntax is skipped, not an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.interval import points_in_spans, smallest_cover
from .brackets import following, siblings, structure

#: Block comments nest; deeper ones are left open, as unterminated ones are. Runs are possessive, so that a long token needs no stack.
NESTED = 16


def _block_comment(depth: int) -> str:
    inner = "|" + _block_comment(depth - 1) if depth else ""
    return r"/\*(?:[^*/]++|\*(?!/)|/(?!\*)" + inner + r")*+\*/"


# Token classes of the language, tried in this order; the last takes any one character.
TOKEN = "|".join([
    r"\s++", r"//[^\n]*+", _block_comment(NESTED), r"(?:b|c)?r(#*+)\"(?s:.*?)\"\1", r"(?:b|c)?\"[^\"\\]*+(?:\\(?s:.)[^\"\\]*+)*+\"",
    r"b?'(?:\\u\{[0-9a-fA-F_]+\}|\\x[0-9a-fA-F]{2}|\\.|[^\\'\n])'", r"'[\p{L}_][\p{L}\p{N}_]*+", r"r#[\p{L}_][\p{L}\p{N}_]*+", r"[\p{L}_][\p{L}\p{N}_]*+",
    r"[0-9][0-9A-Za-z_]*+(?:\.[0-9][0-9A-Za-z_]*+)?(?:(?<=[eE])[+-][0-9_]+)?", r"(?s:.)",
])
# Words that begin an item, and their kinds.
ITEM_KINDS = {
    "fn": "function", "struct": "struct", "enum": "enum", "union": "union", "trait": "trait", "impl": "impl", "mod": "module",
    "type": "type_alias", "const": "const", "static": "static", "use": "use", "macro_rules": "macro", "extern": "extern_crate",
}
# Words that may stand between a visibility and an item word.
MODIFIERS = "unsafe async default auto".split()


def token_kind(token: Column) -> Column:
    """B.2: the kind of one token."""
    first = F.substring(token, 1, 1)
    return (
        F.when(F.rlike(token, F.lit(r"^\s")), "whitespace").when(F.startswith(token, F.lit("//")), "comment").when(F.startswith(token, F.lit("/*")) & (F.length(token) > 1), "comment")
        .when(F.rlike(token, F.lit(r'^(?:b|c)?r?#*"')), "string").when(F.rlike(F.substring(token, 1, 16), F.lit(r"^b?'.+'$")), "char").when(first == "'", "lifetime")
        .when(F.rlike(token, F.lit(r"^(?:r#)?[\p{L}_]")), "ident").when(F.rlike(token, F.lit(r"^[0-9]")), "number").otherwise("punct")
    )


def tokens(files: DataFrame) -> DataFrame:
    """B.1: file_id, n, token, kind, span_start, span_end of every token, trivia too; together they are the text."""
    some = files.select("file_id", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("n", "token"))
    order = Window.partitionBy("file_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.octet_length("token")).over(order).cast("long")
    return some.withColumn("span_end", end).withColumn("span_start", F.col("span_end") - F.octet_length("token")).withColumn("kind", token_kind(F.col("token")))


def lexical_errors(toks: DataFrame) -> DataFrame:
    """B.1: tokens that never end: an opening quote or comment mark left as punctuation."""
    open_ = F.col("token").isin('"', "'") | ((F.col("kind") == "comment") & F.startswith("token", F.lit("/*")) & ~F.endswith("token", F.lit("*/")))
    return toks.filter(open_).select("file_id", "span_start", F.lit("unterminated").alias("error"))


def items(toks: DataFrame) -> DataFrame:
    """B.10-B.13: file_id, item_id (start), kind, name, visibility, span, name_start, is_inline, parent_id, parent_kind, header.

    An item's word stands first in its block, or after a semicolon, a block or an attribute, but for visibility and modifiers,
    whatever their length. It ends at the bracket that brings the depth back, or at a semicolon of its own depth; `use`,
    `const`, `static` and `type` always at the semicolon. The next end is found by a window per file and depth, not by a join.
    """
    near = structure(toks)
    word = F.col("token")
    limited = (word == "(") & (F.col("prev") == "pub") & F.col("next").isin("crate", "super", "self", "in")
    before_fn = F.col("next").isin("fn", "unsafe", "async", "extern")
    leads = word.isin("pub", "crate", *MODIFIERS) | ((word == "const") & before_fn) | ((word == "extern") & (F.col("next") != "crate")) | ((F.col("kind") == "string") & (F.col("prev") == "extern")) | limited
    earlier = siblings().rowsBetween(Window.unboundedPreceding, -1)
    bound = F.last(F.when(~leads, F.struct("n", "token", "prev")), ignorenulls=True).over(earlier)
    shown = F.last(F.when(word.isin("pub", "crate"), F.struct("n", "token", F.when(F.col("next") == "(", F.col("next_start")).alias("at"))), ignorenulls=True).over(earlier)
    near = near.withColumns({"_bound": bound, "_shown": shown})
    free = F.col("_bound").isNull() | F.col("_bound.token").isin(";", "{") | ((F.col("_bound.token") == "[") & F.col("_bound.prev").isin("#", "!")) | ((F.col("_bound.token") == "(") & (word == "fn"))
    starts = word.isin(*ITEM_KINDS) & free & (F.col("open_token").isNull() | (F.col("open_token") == "{"))
    starts = starts & ~((word == "const") & F.col("next").isin("fn", "unsafe", "async", "{", "extern")) & ~((word == "extern") & (F.col("next") != "crate"))
    starts = starts & ~((word == "macro_rules") & (F.col("next") != "!")) & ~((word == "union") & ~F.rlike("next", F.lit(r"^[\p{L}_]")))
    kind = F.create_map(*[F.lit(x) for pair in ITEM_KINDS.items() for x in pair])[word]
    own = F.when(F.col("_bound").isNull() | (F.col("_shown.n") > F.col("_bound.n")), F.col("_shown"))
    shut = (word == "}") | (word == ";")
    level = F.when(word == "}", F.col("depth_after")).otherwise(F.col("depth"))
    events = near.withColumns({"_starts": starts, "_level": level, "_item": kind, "_vis": own, "_shut": shut}).filter("_starts or _shut")
    end_any = following(F.col("_shut"), F.struct("span_end", "token"), "file_id", "_level")
    end_semi = following(word == ";", F.struct("span_end", "token"), "file_id", "_level")
    found = events.withColumn("_end", F.when(F.col("_item").isin("use", "const", "static", "type_alias", "extern_crate"), end_semi).otherwise(end_any)).filter("_starts")
    name = F.when(F.col("_item").isin("impl", "use"), F.lit(None)).when(F.col("_item").isin("macro", "extern_crate"), F.col("next2")).otherwise(F.col("next"))
    rows = found.select(
        "file_id", F.col("span_start").alias("item_id"), F.col("_item").alias("kind"), F.regexp_replace(name, "^r#", "").alias("name"),
        F.col("_vis.token").alias("_vis"), F.col("_vis.at").alias("_vis_at"), "span_start", F.coalesce(F.col("_end.span_end"), F.col("span_end")).alias("span_end"),
        F.when(name.isNotNull(), F.col("next_start")).alias("name_start"), (F.col("_end.token") == "}").alias("is_inline"),
    )
    # pub(in a::b): what stands in the brackets after a pub.
    inside = near.filter("open_prev = 'pub' and open_token = '(' and token <> ')'").groupBy("file_id", F.col("open_start").alias("_vis_at")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]), "").alias("_path"))
    limit = F.rlike("_path", F.lit("^(?:crate|super|self|in)"))
    rows = rows.join(inside, ["file_id", "_vis_at"], "left").withColumn("visibility", F.when(F.col("_vis").isNull(), "private").when((F.col("_vis") == "pub") & limit, F.concat(F.lit("pub("), "_path", F.lit(")"))).otherwise(F.col("_vis"))).drop("_vis", "_vis_at", "_path")
    as_id = rows.withColumn("id", F.col("item_id"))
    owners = as_id.filter(F.col("kind").isin("module", "impl", "trait", "function", "struct", "enum", "union")).select("file_id", "id", "span_start", "span_end")
    nested = smallest_cover(as_id, owners, ["file_id"]).drop("id")
    parents = rows.select("file_id", F.col("item_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    return nested.join(parents, ["file_id", "parent_id"], "left")


def item_docs(toks: DataFrame, found: DataFrame) -> DataFrame:
    """B.17: file_id, item_id, docs: `///`, `/** */` and #[doc = ".."] right before an item, and `//!` and `/*! */` first inside
    it, joined by line; those first in a file have no item_id.

    Runs of doc comments and attributes end at any other significant token; a window numbers the runs.
    """
    some = toks.filter(F.col("kind") != "whitespace")
    starts = found.select("file_id", F.col("item_id").alias("span_start"), F.lit(True).alias("_item"))
    marked = some.join(starts, ["file_id", "span_start"], "left")
    order = Window.partitionBy("file_id").orderBy("n")
    stop = F.col("token").isin("{", "}", ";").cast("int")
    run = F.coalesce(F.sum(stop).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    token = F.col("token")
    back = [F.lag("token", k).over(Window.partitionBy("file_id", "_plain").orderBy("n")) for k in (1, 2, 3, 4)]
    attribute = (F.col("kind") == "string") & (back[0] == "=") & (back[1] == "doc") & (back[2] == "[") & (back[3] == "#")
    unquoted = F.regexp_replace(F.regexp_replace(token, r'^r?#*"', ""), r'"#*$', "")
    # Of a block, the marks and each line's leading star go.
    block = lambda mark: F.regexp_replace(F.trim(F.expr(f"substring(token, {mark}, length(token) - {mark + 1})")), r"(?m)^[ \t]*\* ?", "")
    outer = F.when(F.rlike(token, F.lit(r"^///(?!/)")), F.regexp_replace(token, r"^/// ?", "")).when(F.rlike(token, F.lit(r"^/\*\*[^*/]")), block(4)).when(attribute, F.regexp_replace(unquoted, "^ ", ""))
    inner = F.when(F.startswith(token, F.lit("//!")), F.regexp_replace(token, r"^//! ?", "")).when(F.startswith(token, F.lit("/*!")), block(4))
    numbered = marked.withColumn("_plain", F.col("kind") != "comment").withColumns({"_run": run, "_doc": outer, "_in": inner})
    heads = numbered.filter("_item").groupBy("file_id", "_run").agg(F.min("n").alias("_first"), F.min_by("span_start", "n").alias("item_id"))
    lines = numbered.filter("_doc is not null").join(heads, ["file_id", "_run"]).filter("n < _first").select("file_id", "item_id", "n", F.col("_doc").alias("_line"))
    # Inner ones: nothing but their like stands between them and the item's brace, or the file's begin.
    last = F.last(F.when(F.col("kind") != "comment", F.struct("span_start", "span_end", "token")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    within = numbered.withColumn("_last", last).filter("_in is not null and (_last is null or _last.token = '{')")
    spans = found.select("file_id", "item_id", "span_start", "span_end")
    owner = points_in_spans(within.filter("_last is not null").select("file_id", "n", F.col("_last.span_start").alias("_at"), F.col("_in").alias("_line")), spans, ["file_id"], at="_at", closed=False)
    owner = owner.groupBy("file_id", "n", "_line").agg(F.max_by("item_id", "span_start").alias("item_id")).select("file_id", "item_id", "n", "_line")
    whole = within.filter("_last is null").select("file_id", F.lit(None).cast("long").alias("item_id"), "n", F.col("_in").alias("_line"))
    every = lines.unionByName(owner).unionByName(whole)
    return every.groupBy("file_id", "item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "_line"))), lambda x: x["_line"]), "\n").alias("docs"))


def path_attributes(toks: DataFrame, found: DataFrame) -> DataFrame:
    """A.7: file_id, item_id, literal of each #[path = "..."] before an item."""
    near = structure(toks)
    given = near.filter("kind = 'string' and prev = '=' and prev2 = 'path' and prev3 = '[' and open_prev = '#'").select("file_id", "span_start", F.regexp_extract("token", r'"(.*)"', 1).alias("literal"))
    both = given.unionByName(found.select("file_id", "span_start", "item_id"), allowMissingColumns=True)
    owned = both.withColumn("item_id", following(F.col("item_id").isNotNull(), F.col("item_id"), "file_id", order="span_start"))
    return owned.filter("literal is not null and item_id is not null").select("file_id", "item_id", "literal")


def normal_path(path: Column) -> Column:
    """A path without `.`, doubled slashes and `..`; those that lead above the root stay there."""
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))


def module_files(found: DataFrame, files: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """A.7, A.8, D.4: out-of-line modules to their file: x.rs or x/mod.rs in the directory of the declaring file's children, or
    what a #[path] names (paths: file_id, item_id, literal of path_attributes).

    lib.rs, main.rs and mod.rs keep their children beside them, other files in a folder of their own name; modules inside
    inline ones in a folder of the inline module's name. A path is meant from the declaring file's folder, inside inline
    modules from where their children are. A module whose file is not among the files has no link.
    """
    path = F.col("path")
    folder = F.regexp_replace(path, r"[^/]*$", "")
    stem = F.regexp_extract(path, r"([^/]*)\.rs$", 1)
    home = F.when(stem.isin("lib", "main", "mod"), folder).otherwise(F.concat(folder, stem, F.lit("/")))
    declared = found.filter("kind = 'module' and not is_inline").join(files.select("file_id", home.alias("_home"), folder.alias("_folder")), "file_id")
    # Names of the inline modules around, the outermost first.
    inline = found.filter("kind = 'module' and is_inline").select("file_id", "span_start", "span_end", F.col("name").alias("_in"))
    around = points_in_spans(declared.select("file_id", "item_id", F.col("span_start").alias("_at")), inline, ["file_id"], at="_at", closed=False)
    around = around.groupBy("file_id", "item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("span_start", "_in"))), lambda x: x["_in"]).alias("_around"))
    declared = declared.join(around, ["file_id", "item_id"], "left").withColumn("_below", F.coalesce(F.concat(F.array_join("_around", "/"), F.lit("/")), F.lit("")))
    given = declared.join(paths, ["file_id", "item_id"], "left") if paths is not None else declared.withColumn("literal", F.lit(None).cast("string"))
    option = lambda rank, p: F.struct(F.lit(rank).alias("rank"), p.alias("path"))
    base = F.when(F.col("_below") == "", F.col("_folder")).otherwise(F.concat("_home", "_below"))
    own = F.array(option(0, F.when(F.startswith("literal", F.lit("/")), F.col("literal")).otherwise(F.concat(base, "literal"))))
    usual = F.array(option(0, F.concat("_home", "_below", "name", F.lit(".rs"))), option(1, F.concat("_home", "_below", "name", F.lit("/mod.rs"))))
    options = given.select("file_id", "item_id", "name", F.explode(F.when(F.col("literal").isNotNull(), own).otherwise(usual)).alias("o"))
    target = files.select(F.col("file_id").alias("module_file"), F.col("path").alias("_p"))
    return options.join(target, normal_path(F.col("o.path")) == normal_path(F.col("_p"))).groupBy("file_id", "item_id", "name").agg(F.min_by("module_file", "o.rank").alias("module_file"))


def flatten_use(text: str) -> Iterator[tuple[list[str], str | None, str]]:
    """B.16: leaves of one use tree as (segments, new name, kind): a small per-statement helper."""
    flat = text.strip().removeprefix("use").strip().rstrip(";").strip()

    def walk(s: str, lead: list[str]) -> Iterator[tuple[list[str], str | None, str]]:
        s = s.strip()
        if "{" in s:
            head, body = s.split("{", 1)
            lead = lead + [x.strip() for x in head.split("::") if x.strip()]
            depth, piece = 0, ""
            for c in body.rsplit("}", 1)[0] + ",":
                if c == "," and not depth:
                    if piece.strip():
                        yield from walk(piece, lead)
                    piece = ""
                else:
                    depth += (c == "{") - (c == "}")
                    piece += c
            return
        path, _, new = s.partition(" as ")
        segments = lead + [x.strip() for x in path.split("::") if x.strip()]
        if segments and segments[-1] == "*":
            yield segments[:-1], None, "glob"
        elif len(segments) > 1 and segments[-1] == "self":
            yield segments[:-1], new.strip() or None, "self"
        elif segments:
            yield segments, new.strip() or None, "named"

    yield from walk(flat, [])


LEAVES = "array<struct<segments:array<string>,binding:string,import_kind:string>>"


def _leaves(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("segments", pa.list_(pa.string())), ("binding", pa.string()), ("import_kind", pa.string())]))
    once = {t: [dict(zip(("segments", "binding", "import_kind"), x, strict=True)) for x in flatten_use(t)] for t in set(texts.to_pylist())}
    return pa.array([once[t] for t in texts.to_pylist()], kind)


def item_text(found: DataFrame, toks: DataFrame, alias: str) -> DataFrame:
    """file_id, item_id and the significant tokens of each item as one string, a space between them."""
    near = toks.filter(~F.col("kind").isin("whitespace", "comment")).select("file_id", "n", F.col("span_start").alias("_at"), "token")
    inside = points_in_spans(near, found.select("file_id", "item_id", "span_start", "span_end"), ["file_id"], at="_at", closed=False)
    return inside.groupBy("file_id", "item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]), " ").alias(alias))


def use_leaves(found: DataFrame, toks: DataFrame) -> DataFrame:
    """B.16, D.5: file_id, item_id, parent_id, visibility, segments, binding, import_kind, absolute of every leaf of every use item."""
    some = found.filter("kind = 'use'")
    text = item_text(some, toks, "_use").withColumn("_use", F.replace("_use", F.lit(": :"), F.lit("::")))
    leaves = F.arrow_udf(_leaves, LEAVES)
    out = some.select("file_id", "item_id", "parent_id", "visibility").join(text, ["file_id", "item_id"])
    out = out.select("file_id", "item_id", "parent_id", "visibility", F.rlike("_use", F.lit(r"^use ::")).alias("absolute"), F.explode(leaves(F.col("_use"))).alias("l"))
    return out.select("file_id", "item_id", "parent_id", "visibility", "absolute", "l.*")


def cfg_tree(text: str) -> str | None:
    """C.1: an attribute's inside, cfg(..) or cfg_attr(.., ..), as a JSON tree of functions/cfg.py: a small per-attribute helper.

    cfg_attr(p, cfg(q)) gates by not p or q; with no cfg among its attributes it gates nothing (None).
    """

    def pieces(s: str) -> list[str]:
        out, depth, quoted, last = [], 0, False, ""
        start = 0
        for k, c in enumerate(s + ","):
            quoted ^= c == '"' and last != "\\"
            last = "" if last == "\\" else c
            if not quoted:
                depth += (c == "(") - (c == ")")
                if c == "," and not depth:
                    out.append(s[start:k])
                    start = k + 1
        return [x for x in out if x.strip()]

    def parse(s: str) -> dict:
        s = s.strip()
        if s.endswith(")") and "(" in s and not ("=" in s.split("(", 1)[0]):
            op, inner = s[:-1].split("(", 1)
            return {"op": op.strip(), "args": [parse(x) for x in pieces(inner)]}
        if "=" in s:
            key, value = s.split("=", 1)
            return {"op": "kv", "key": key.strip(), "value": value.strip().strip('"')}
        return {"op": s} if s in ("true", "false") else {"op": "atom", "key": s}

    def gate(node: dict) -> dict | None:
        args = node.get("args") or []
        if node["op"] == "cfg":
            return args[0] if args else {"op": "all", "args": []}
        inner = [g for a in args[1:] if (g := gate(a))] if node["op"] == "cfg_attr" else []
        whole = inner[0] if len(inner) == 1 else {"op": "all", "args": inner}
        return {"op": "any", "args": [{"op": "not", "args": [args[0]]}, whole]} if inner else None

    found = gate(parse(text))
    return found and json.dumps(found)


def cfg_gates(toks: DataFrame, found: DataFrame) -> DataFrame:
    """C.1: file_id, item_id, gate (JSON) of each #[cfg(...)] and gating #[cfg_attr(...)] before an item, of any length and depth.

    An attribute ends at the bracket that brings the depth of its `#` back; it belongs to the next item of its file.
    """
    near = structure(toks)
    level = F.when(F.col("token") == "]", F.col("depth_after")).otherwise(F.col("depth"))
    marks = near.withColumn("_level", level).filter("token = ']' or (token = '#' and next = '[' and next2 in ('cfg', 'cfg_attr'))")
    stop = following(F.col("token") == "]", F.col("span_end"), "file_id", "_level")
    attrs = marks.withColumn("_end", stop).filter("token = '#' and _end is not null").select("file_id", F.col("span_start").alias("item_id"), "span_start", F.col("_end").alias("span_end"))
    texts = item_text(attrs, toks, "attr").select("file_id", F.col("item_id").alias("span_start"), "attr").filter(F.startswith("attr", F.lit("# [ cfg (")) | F.startswith("attr", F.lit("# [ cfg_attr (")))
    both = texts.withColumn("item_id", F.lit(None).cast("long")).unionByName(found.select("file_id", "span_start", F.lit(None).cast("string").alias("attr"), "item_id"))
    owned = both.withColumn("_item", following(F.col("item_id").isNotNull(), F.col("item_id"), "file_id", order="span_start")).filter("attr is not null and _item is not null")
    inner = F.expr("substring(attr, 4, length(attr) - 5)")
    return owned.select("file_id", F.col("_item").alias("item_id"), F.arrow_udf(_cfg_trees, "string")(inner).alias("gate")).filter("gate is not null")


def _cfg_trees(texts: pa.Array) -> pa.Array:
    once = {t: cfg_tree(t) for t in set(texts.to_pylist())}
    return pa.array([once[t] for t in texts.to_pylist()], pa.string())
