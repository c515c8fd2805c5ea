"""Heads of functions and names bound by patterns (G.3, G.4, G.8, H.17, J.1): every binder is a row with its scope.

A pattern is a run of siblings of the bracket table: after `let`, between `for` and `in`, from an arm's begin to its arrow,
between a closure's bars, before a parameter's colon. Its scope ends with the block, the arm, the closure's body or the
function, found as the next sibling of a kind. Names in patterns that are paths, labels or constants bind nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.interval import points_in_spans
from .brackets import as_written, following, in_order, next_sibling, parts, regions, siblings, single, structure
from .scopes import head_starts, path_of

# Words that open a block beside them, and words that are no names.
BLOCK_WORDS = "match unsafe loop async if else while for const try".split()
KEYWORDS = "as box const crate dyn else false fn for if impl in let loop match move mut pub ref return self Self static super true unsafe where while _".split()
#: Tokens after which a bar begins a closure, besides the arrow of an arm.
BEFORE_CLOSURE = ["(", ",", "=", "{", "}", ";", "[", "move", "return", "else", "in", "&", "|"]


def function_parts(toks: DataFrame, items: DataFrame) -> DataFrame:
    """J.1: file_id, item_id, head_end and, in order of ordinal, text, ty, type_path and pattern span of each parameter; one
    row with a null ordinal has the result."""
    near = structure(toks)
    starts = head_starts(near, items.filter("kind = 'function'"), ("{", ";"))
    inside = regions(near, starts)
    whole = Window.partitionBy("file_id", "region")
    flat = (F.col("depth") == F.col("base")) & (F.col("angle") == 0)
    paren = F.min(F.when((F.col("token") == "(") & flat, F.struct("n", "close_n"))).over(whole)
    where = F.min(F.when((F.col("token") == "where") & flat, F.col("n"))).over(whole)
    told = inside.withColumns({"_paren": paren, "_where": where}).filter("_paren.close_n is not null")
    inner = parts(told.filter("n > _paren.n and n < _paren.close_n"))
    plain = (F.col("depth") == F.col("base") + 1) & (F.col("angle") == 0) & ~F.col("token").isin("<", ">")
    typed = F.col("n") > F.col("colon")
    ty = as_written(typed)
    given = inner.groupBy("file_id", "region", "part").agg(
        as_written().alias("text"), F.when(ty != "", ty).alias("ty"), path_of(in_order(plain & typed)).alias("type_path"), F.min("span_start").alias("from_at"),
        F.max(F.when(F.coalesce(~typed & (F.col("n") < F.col("colon")), F.lit(False)), F.col("span_end"))).alias("to_at"),
    )
    # Of the result, the arrow's two characters go; a where clause is none of it.
    tail = told.filter("n > _paren.close_n and (_where is null or n < _where)")
    result = tail.groupBy("file_id", "region").agg(F.trim(F.substring(as_written(), 3, 1 << 30)).alias("text"))
    ends = starts.select("file_id", "region", "head_end")
    rows = given.withColumn("ordinal", F.col("part").cast("int")).unionByName(result.filter("text <> ''").withColumn("ordinal", F.lit(None).cast("int")), allowMissingColumns=True)
    return ends.join(rows, ["file_id", "region"], "left").select("file_id", F.col("region.item_id").alias("item_id"), "head_end", "ordinal", "text", "ty", "type_path", "from_at", "to_at")


def heads_of(pieces: DataFrame) -> DataFrame:
    """J.1: file_id, item_id, params (as written), result, head_end of functions, of function_parts."""
    ordered = F.sort_array(F.collect_list(F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", "text"))))
    params = F.transform(ordered, lambda x: x["text"])
    return pieces.groupBy("file_id", "item_id", "head_end").agg(params.alias("params"), F.max(F.when(F.col("ordinal").isNull(), F.col("text"))).alias("result")).select("file_id", "item_id", "params", "result", "head_end")


def patterns(toks: DataFrame, pieces: DataFrame, items: DataFrame) -> DataFrame:
    """G.3: file_id, source, from_at, to_at (bytes of the pattern), scope_start, scope_end of every pattern that binds names.

    The scope of a let begins after its statement, that of `if let` and `while let` after the tested value, of an arm with
    its guard, of a closure with its body.
    """
    near = structure(toks)
    word = F.col("token")
    order = siblings().rowsBetween(Window.unboundedPreceding, 0)
    # Blocks beside words that open them: each word is matched by a brace, as brackets are, by counting.
    opens = F.when(word.isin(*BLOCK_WORDS) & ~((word == "else") & (F.col("next") == "if")) & ~((word == "for") & (F.col("next") == "<")) & ~((word == "const") & (F.col("next") != "{")), 1).when(word == "{", -1).otherwise(0)
    count = F.sum(opens).over(order)
    level = F.when(word == "{", count + 1).otherwise(count)
    beside = near.withColumn("_level", level)
    leveled = Window.partitionBy("file_id", "open_n", "_level").orderBy("n")
    brace = F.struct("n", "span_start", "span_end", "close_start", "close_end")
    equals, colon = single("="), single(":")
    heads = beside.filter(word.isin("in", "match", "{") | equals).withColumns({"_body": following(word == "{", brace, "file_id", "open_n", "_level"), "_owner": F.lag("token").over(leveled)})
    bodies = heads.select("file_id", "n", "_body", F.when(word == "{", F.col("_owner") == "match").alias("is_match"))
    both = near.join(bodies, ["file_id", "n"], "left")
    arrow = (word == "=") & (F.col("next") == ">") & (F.col("next_start") == F.col("span_end"))
    bar = word == "|"
    and_ = (word == "&") & (F.col("next") == "&") & (F.col("next_start") == F.col("span_end"))
    point = F.struct("n", "span_start", "span_end")
    told = both.withColumns({
        "_semi": next_sibling(word == ";", point), "_eq": next_sibling(equals | (word == ";"), point), "_colon": next_sibling(colon, point), "_in": next_sibling(word == "in", point),
        "_and": next_sibling(and_, point), "_bar": next_sibling(bar, point), "_block": next_sibling(word == "{", brace), "_comma": next_sibling(word.isin(",", ";"), point),
    })
    row = lambda source, to, start, end: [F.lit(source).alias("source"), F.col("span_end").alias("from_at"), to.alias("to_at"), start.alias("scope_start"), end.alias("scope_end")]
    let = told.filter("token = 'let' and _eq is not null")
    typed = F.when(F.col("_colon.n") < F.col("_eq.n"), F.col("_colon.span_start")).otherwise(F.col("_eq.span_start"))
    tested = F.col("prev").isin("if", "while", "&", "|")
    plain = let.filter(~F.coalesce(tested, F.lit(False))).select("file_id", *row("let", typed, F.coalesce("_semi.span_end", "open_close"), F.col("open_close")))
    start = F.when(F.col("_and.n") < F.col("_body.n"), F.col("_and.span_start")).otherwise(F.col("_body.span_start"))
    # A record pattern has braces too, so the body is looked for from the = or the `in` on.
    from_there = lambda rows, at: rows.drop("_body").withColumn("_from", F.col(at)).join(bodies.select("file_id", F.col("n").alias("_from"), "_body"), ["file_id", "_from"]).filter("_body is not null")
    conditional = from_there(let.filter(tested), "_eq.n").select("file_id", *row("condition", F.col("_eq.span_start"), start, F.col("_body.close_start")))
    of_impl = F.coalesce(F.rlike("prev", F.lit(r"^[\p{L}_]")) | ((F.col("prev") == ">") & (F.col("prev2") != "=")), F.lit(False))
    loops = from_there(told.filter((word == "for") & (F.col("next") != "<") & ~of_impl), "_in.n").select("file_id", *row("for", F.col("_in.span_start"), F.col("_body.span_start"), F.col("_body.close_start")))
    # Closures: the bar's place says whether it begins one; the next bar beside it ends the parameters.
    begins = F.coalesce((F.col("prev").isin(*BEFORE_CLOSURE) & ~((F.col("prev") == "|") & ~F.col("gap"))) | ((F.col("prev") == ">") & (F.col("prev2") == "=")), F.lit(False))
    shut = siblings().rowsBetween(Window.unboundedPreceding, -1)
    in_arms = both.filter("is_match").select("file_id", F.col("n").alias("open_n"), F.lit(True).alias("_arms")).distinct()
    bars = told.filter(bar).join(in_arms, ["file_id", "open_n"], "left").withColumn("_begin", begins & ~(F.coalesce("_arms", F.lit(False)) & F.col("prev").isin(",", "{", "}")))
    # A bar that ends parameters begins nothing, though what stands before it might say so.
    parity = F.last(F.when(F.col("_begin"), F.col("_bar.n")), ignorenulls=True).over(shut)
    closing = bars.withColumn("_shut", parity).filter("_begin and (_shut is null or _shut <> n) and _bar is not null")
    after = told.filter(bar).select("file_id", F.col("n").alias("_bn"), F.col("span_end").alias("_from"), F.col("next").alias("_next"), F.col("_block").alias("_blk"), F.col("_comma").alias("_cm"))
    closed = closing.select("file_id", "n", "span_end", F.col("_bar.n").alias("_bn"), F.col("_bar.span_start").alias("_to"), "open_close").join(after, ["file_id", "_bn"])
    ends = F.when(F.col("_next").isin("{", "-") & F.col("_blk").isNotNull(), F.col("_blk.close_end")).otherwise(F.coalesce("_cm.span_start", "open_close", F.lit((1 << 62))))
    closures = closed.select("file_id", F.col("n").alias("bar_n"), "span_end", "_to", "_from", ends.alias("_end"))
    # The closure's parameters are parts like a function's.
    zone = closures.select("file_id", F.struct(F.col("bar_n"), F.col("_from").alias("s"), F.col("_end").alias("e")).alias("region"), F.col("bar_n").alias("from_n"), "_to")
    to_n = near.select("file_id", F.col("span_start").alias("_to"), F.col("n").alias("to_n"))
    params = parts(regions(near, zone.join(to_n, ["file_id", "_to"]).drop("_to")).filter("n > region.bar_n"), 0)
    of_closures = params.filter("colon is null or n < colon").groupBy("file_id", "region", "part").agg(F.min("span_start").alias("from_at"), F.max("span_end").alias("to_at"))
    of_closures = of_closures.select("file_id", F.lit("closure").alias("source"), "from_at", "to_at", F.col("region.s").alias("scope_start"), F.col("region.e").alias("scope_end"))
    # Arms: a comma, or a block that nothing continues, ends one.
    within = near.join(in_arms, ["file_id", "open_n"], "left_semi")
    ended = ((word == ",") | ((word == "{") & ~F.coalesce(F.col("after_close").isin(".", "?", ",", "else", "=", "|", "if", "as"), F.lit(False)))) & (F.col("n") != F.col("open_n"))
    end_at = F.when(word == "{", F.col("close_end")).otherwise(F.col("span_start"))
    begin_at = F.when(word == "{", F.col("close_end")).otherwise(F.col("span_end"))
    arms = within.withColumns({
        "_begin": F.coalesce(F.last(F.when(ended, begin_at), ignorenulls=True).over(shut), F.col("open_start") + 1),
        "_end": F.coalesce(next_sibling(ended, end_at), F.col("open_close")), "_guard": F.last(F.when(word == "if", F.struct("n", "span_start")), ignorenulls=True).over(shut),
    }).filter(arrow)
    pattern_end = F.when(F.col("_guard.span_start") >= F.col("_begin"), F.col("_guard.span_start")).otherwise(F.col("span_start"))
    of_arms = arms.select("file_id", F.lit("arm").alias("source"), F.col("_begin").alias("from_at"), pattern_end.alias("to_at"), pattern_end.alias("scope_start"), F.col("_end").alias("scope_end"))
    spans = items.filter("kind = 'function'").select("file_id", "item_id", F.col("span_start").alias("_s"), F.col("span_end").alias("_e"))
    of_heads = pieces.filter("to_at is not null").join(spans, ["file_id", "item_id"]).select("file_id", F.lit("parameter").alias("source"), "from_at", F.col("to_at"), F.col("_s").alias("scope_start"), F.col("_e").alias("scope_end"))
    out = plain
    for more in (conditional, loops, of_closures, of_arms, of_heads):
        out = out.unionByName(more)
    return out.filter("from_at < to_at and scope_start <= scope_end")


def pattern_names(toks: DataFrame, found: DataFrame) -> DataFrame:
    """G.3: file_id, source, from_at, scope_start, scope_end, name, at, and first_at of every name in a pattern that may bind:
    alternatives of a pattern share the first place. Paths, calls, macros and labels are none."""
    near = structure(toks)
    path = ((F.col("next") == ":") & (F.col("next2") == ":")) | ((F.col("prev") == ":") & (F.col("prev2") == ":"))
    label = F.when((F.col("next") == ":") & (F.col("next2") != ":") & (F.col("open_token") == "{"), F.col("open_start"))
    names = near.filter((F.col("kind") == "ident") & ~F.col("token").isin(*KEYWORDS) & ~F.coalesce(path | F.col("next").isin("(", "{", "!"), F.lit(False)))
    points = names.select("file_id", F.col("span_start").alias("at"), F.col("token").alias("name"), label.alias("_label"))
    spans = found.withColumnsRenamed({"from_at": "span_start", "to_at": "span_end"})
    inside = points_in_spans(points, spans, ["file_id"], at="at", closed=False).filter("_label is null or _label < span_start")
    # A place in two patterns (a closure in a guard) belongs to the one that begins last.
    inner = inside.withColumn("_last", F.max("span_start").over(Window.partitionBy("file_id", "at"))).filter("span_start = _last")
    first = F.min("at").over(Window.partitionBy("file_id", "source", "span_start", "name"))
    return inner.select("file_id", "source", F.col("span_start").alias("from_at"), "scope_start", "scope_end", F.regexp_replace("name", "^r#", "").alias("name"), "at", first.alias("first_at"))


def constant(name: Column) -> Column:
    """Names that, unknown as they may be, are taken for constants or variants: those with a capital first."""
    return F.rlike(name, F.lit(r"^\p{Lu}"))
