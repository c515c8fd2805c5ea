"""Registered queries of the reference's operators over the projected driver tables, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Analysis
from .functions.cfg import evaluate, gate_admits, parse_cfg_line
from .functions.names import KINDS, call_snippet, completion_sort_key, rank_of, signature
from .functions.spans import utf16_length
from .operators import brackets, closure, completion, cursor, gates, imports, incremental, lexing, positions, references, scopes, semantic, stats, symbols
from .plans.asof import last_before
from .plans.durable import durable
from .sources.driver import CUSTOMER, NATION, SUPPLIER, Driver

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[Driver], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Driver(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- the projection as SQL, for the oracles -------------------------------------------------------------------------

DEFS = """defs AS (
  SELECT p_partkey AS def_id, p_name AS name, 'struct' AS kind, p_brand AS container, CAST(p_size % 25 AS INT) AS package_slot, CAST(0 AS BIGINT) AS start FROM part
  UNION ALL SELECT c_custkey, c_name, 'function', n_name, c_nationkey, c_custkey % 97 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_suppkey, s_name, 'trait', n_name, s_nationkey, s_suppkey % 97 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_nationkey, n_name, 'module', NULL, n_nationkey, 0 FROM nation)"""
RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + f" ELSE {len(KINDS)} END"
MODULES = f"""modules AS (
  SELECT CAST(r_regionkey AS BIGINT) AS module_id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name, -1 AS package_slot FROM region
  UNION ALL SELECT n_nationkey + {NATION}, n_regionkey, n_name, n_nationkey FROM nation
  UNION ALL SELECT c_custkey + {CUSTOMER}, c_nationkey + {NATION}, c_name, c_nationkey FROM customer
  UNION ALL SELECT s_suppkey + {SUPPLIER}, s_nationkey + {NATION}, s_name, s_nationkey FROM supplier)"""
DEPS = """deps AS (
  SELECT *, (package_slot % 2 = 0 OR package_slot % 3 = 1) AS is_normal, package_slot % 2 <> 0 AS is_build, package_slot % 5 = 0 AS is_dev FROM (
    SELECT n_nationkey AS package_slot, CAST((7 * n_nationkey + 3) % 25 AS INT) AS dep_slot FROM nation WHERE n_nationkey % 3 <> 0
    UNION SELECT n_nationkey, CAST(n_nationkey // 2 AS INT) FROM nation WHERE n_nationkey % 4 = 1))"""
IMPLS = "impls AS (SELECT DISTINCT l_partkey AS self_type, CASE WHEN l_partkey % 2 = 0 AND l_suppkey % 2 = 0 THEN NULL ELSE l_suppkey END AS trait, l_suppkey AS impl_id FROM lineitem)"
SITES = """sites AS (
  SELECT CAST(l_suppkey % 25 AS INT) AS package_slot, l_orderkey AS file_id, CAST(l_linenumber * 100 AS BIGINT) AS span_start,
         CAST(l_linenumber * 100 + CAST(floor(l_quantity) AS INT) AS BIGINT) AS span_end, l_partkey AS entity_id, l_returnflag = 'R' AS is_declaration, l_linenumber AS scan_order FROM lineitem)"""
FIELDS = "fields AS (SELECT p_partkey AS type_id, f.ordinal AS ordinal, f.name AS name, f.ty AS ty FROM part, (VALUES (0, 'brand', 'str'), (1, 'type', 'str'), (2, 'size', 'i32'), (3, 'price', 'f64')) f(ordinal, name, ty))"
OPS = "CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'change' WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'close' WHEN 'error' THEN 'failed_save' END"
EVENTS = f"doc_events AS (SELECT user_id AS path, event_id AS version, {OPS} AS op, ts, value FROM events)"

# ---- symbols, positions, cursors ------------------------------------------------------------------------------------


@query(f"WITH {DEFS} SELECT def_id, name, kind, container, package_slot, start, {RANK} AS kind_rank FROM defs WHERE contains(lower(name), 'er#0000')")
def workspace_symbols(d: Driver) -> DataFrame:
    return symbols.workspace_symbols(d.defs(), "er#0000")


@query(f"""WITH {DEFS}, needles(query_id, needle) AS (VALUES (1, ''), (2, 'supplier#00'), (3, 'UNITED'), (4, '17'))
SELECT def_id, name, kind, container, package_slot, start, query_id, needle FROM defs JOIN needles ON contains(lower(name), lower(needle))""")
def workspace_symbols_batch(d: Driver) -> DataFrame:
    needles = d.spark.createDataFrame([(1, ""), (2, "supplier#00"), (3, "UNITED"), (4, "17")], "query_id int, needle string")
    return symbols.workspace_symbols_batch(d.defs(), needles)


@query(f"""WITH RECURSIVE {MODULES}, t AS (
  SELECT module_id, 0 AS depth, name AS path FROM modules WHERE parent_id IS NULL
  UNION ALL SELECT m.module_id, t.depth + 1, t.path || '::' || m.name FROM modules m JOIN t ON m.parent_id = t.module_id)
SELECT module_id, depth, path FROM t""")
def container_path(d: Driver) -> DataFrame:
    return symbols.container_paths(d.modules())


LINES = """lines AS (
  SELECT file_id, line, CAST(coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
         CAST(strlen(content) AS BIGINT) AS byte_len, CAST(length(content) + length(regexp_replace(content, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS utf16_len
  FROM (SELECT doc_id AS file_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line, unnest(string_split(text, chr(10))) AS raw FROM documents),
       LATERAL (SELECT regexp_replace(raw, chr(13) || '$', '') AS content))"""


@query(f"WITH {LINES} SELECT file_id, line, start, byte_len, utf16_len FROM lines")
def line_index(d: Driver) -> DataFrame:
    return positions.line_index(d.files())


@query(f"""WITH {LINES}, offs AS (SELECT doc_id AS file_id, CAST(strlen(text) * k // 4 AS BIGINT) AS "offset" FROM documents, (VALUES (0), (1), (2), (3), (4)) v(k))
SELECT o.file_id, o."offset", l.line, o."offset" - l.start AS "column" FROM offs o ASOF JOIN lines l ON o.file_id = l.file_id AND o."offset" >= l.start""")
def utf8_position(d: Driver) -> DataFrame:
    lines = positions.line_index(d.files())
    quarter = F.explode(F.array(*map(F.lit, range(5)))).alias("k")
    offsets = d.files().select("file_id", F.octet_length("text").alias("n"), quarter).select("file_id", F.floor(F.col("n") * F.col("k") / 4).cast("long").alias("offset"))
    return positions.utf8_positions(offsets, lines.select("file_id", "line", "start"))


@query("SELECT doc_id AS file_id, CAST(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS units FROM documents")
def utf16_units(d: Driver) -> DataFrame:
    return d.files().select("file_id", utf16_length(F.col("text")).cast("long").alias("units"))


@query(f"""WITH {SITES}, cursors AS (SELECT l_orderkey * 10 + l_linenumber AS query_id, l_orderkey AS file_id, CAST(l_linenumber * 100 + 7 AS BIGINT) AS "offset" FROM lineitem)
SELECT query_id, entity_id, span_start, span_end FROM (
  SELECT query_id, entity_id, span_start, span_end, row_number() OVER (PARTITION BY query_id ORDER BY span_end - span_start, scan_order, span_start, span_end, entity_id) AS n
  FROM cursors c JOIN sites s ON c.file_id = s.file_id AND "offset" BETWEEN span_start AND span_end) WHERE n = 1""")
def symbol_at_narrowest(d: Driver) -> DataFrame:
    cursors = d.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("query_id"), F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") * 100 + 7).cast("long").alias("offset"))
    return cursor.symbol_at(cursors, d.sites().drop("package_slot"), ["file_id"])


BODIES = "bodies AS (SELECT o_orderkey AS file_id, o_custkey AS body_id, CAST(100 + o_custkey % 3 * 50 AS BIGINT) AS span_start, CAST(300 + o_custkey % 5 * 100 AS BIGINT) AS span_end FROM orders UNION ALL SELECT o_orderkey, -o_orderkey, 0, 10000 FROM orders)"


def _bodies(d: Driver) -> DataFrame:
    o = d.raw("orders")
    inner = o.select(F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("body_id"), (100 + F.col("o_custkey") % 3 * 50).cast("long").alias("span_start"), (300 + F.col("o_custkey") % 5 * 100).cast("long").alias("span_end"))
    return inner.unionByName(o.select(F.col("o_orderkey").alias("file_id"), (-F.col("o_orderkey")).alias("body_id"), F.lit(0).cast("long").alias("span_start"), F.lit(10000).cast("long").alias("span_end")))


@query(f"""WITH {BODIES}, cursors AS (SELECT l_orderkey * 10 + l_linenumber AS query_id, l_orderkey AS file_id, CAST(l_linenumber * 100 AS BIGINT) AS "offset" FROM lineitem)
SELECT query_id, body_id FROM (SELECT query_id, body_id, row_number() OVER (PARTITION BY query_id ORDER BY span_end - span_start, body_id) AS n
  FROM cursors c JOIN bodies b ON c.file_id = b.file_id AND span_start <= "offset" AND "offset" < span_end) WHERE n = 1""")
def innermost_body(d: Driver) -> DataFrame:
    cursors = d.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("query_id"), F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") * 100).cast("long").alias("offset"))
    return cursor.innermost_body(cursors, _bodies(d), ["file_id"])


@query(f"""WITH {SITES}, items AS (SELECT DISTINCT file_id, span_start * 1000 + span_end AS id, span_start, span_end FROM sites),
mods AS (SELECT o_orderkey AS file_id, CAST(1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS span_start, CAST(450 AS BIGINT) AS span_end FROM orders UNION ALL SELECT o_orderkey, 2, 150, 380 FROM orders)
SELECT file_id, id, span_start, span_end, parent_id FROM (
  SELECT i.file_id, i.id, i.span_start, i.span_end, m.id AS parent_id, row_number() OVER (PARTITION BY i.file_id, i.id ORDER BY m.span_end - m.span_start, m.id) AS n
  FROM items i LEFT JOIN mods m ON i.file_id = m.file_id AND m.span_start <= i.span_start AND i.span_end <= m.span_end AND (m.span_start <> i.span_start OR m.span_end <> i.span_end)) WHERE n = 1""")
def document_outline(d: Driver) -> DataFrame:
    items = d.sites().select("file_id", (F.col("span_start") * 1000 + F.col("span_end")).alias("id"), "span_start", "span_end").distinct()
    spans = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(a).cast("long").alias("span_start"), F.lit(b).cast("long").alias("span_end")) for i, a, b in ((1, 0, 450), (2, 150, 380))]))
    modules = d.raw("orders").select(F.col("o_orderkey").alias("file_id"), spans.alias("m")).select("file_id", "m.*")
    return symbols.document_outline(items, modules)


# ---- references -----------------------------------------------------------------------------------------------------

SUBJECTS = "SELECT p_partkey FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)"


def _subjects(d: Driver) -> DataFrame:
    part = d.raw("part")
    return part.join(F.broadcast(part.agg(F.min("p_brand").alias("p_brand"))), "p_brand", "left_semi").select(F.col("p_partkey").alias("entity_id"))


@query(f"WITH {SITES} SELECT DISTINCT package_slot, file_id, span_start, span_end, entity_id FROM sites WHERE NOT is_declaration AND entity_id IN ({SUBJECTS})")
def references_find(d: Driver) -> DataFrame:
    return references.references(_subjects(d), d.sites())


@query(f"WITH {SITES} SELECT DISTINCT package_slot, file_id, span_start, span_end, entity_id FROM sites WHERE entity_id IN ({SUBJECTS}) AND file_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def references_file_scoped(d: Driver) -> DataFrame:
    scope = d.raw("orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("file_id"))
    return references.references(_subjects(d), d.sites(), include_declarations=True, scope=scope)


@query(f"""WITH RECURSIVE {DEPS}, up AS (SELECT 7 AS package_slot UNION SELECT deps.package_slot FROM deps JOIN up ON deps.dep_slot = up.package_slot) SELECT package_slot FROM up""")
def search_surface(d: Driver) -> DataFrame:
    declaring = d.packages().filter("package_slot = 7").select("package_slot")
    reverse = closure.reverse_dependency_closure(declaring, d.dependencies())
    return references.search_surface(d.packages(), "dependency", declaring, reverse)


# ---- closures -------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {DEPS}, up AS (SELECT n_nationkey AS root, n_nationkey AS package_slot FROM nation
  UNION SELECT up.root, deps.package_slot FROM deps JOIN up ON deps.dep_slot = up.package_slot) SELECT root, package_slot FROM up""")
def reverse_dependency_closure(d: Driver) -> DataFrame:
    return closure.reverse_dependency_closure(d.packages(), d.dependencies())


@query(f"""WITH RECURSIVE {DEPS}, kinds(kind) AS (VALUES ('lib'), ('test'), ('build')),
vis AS (
  SELECT package_slot, kind, dep_slot AS visible FROM deps, kinds WHERE CASE kind WHEN 'build' THEN is_build WHEN 'test' THEN is_normal OR is_dev ELSE is_normal END
  UNION SELECT vis.package_slot, vis.kind, deps.dep_slot FROM vis JOIN deps ON vis.visible = deps.package_slot AND deps.is_normal)
SELECT package_slot, kind, visible FROM vis UNION SELECT n_nationkey, kind, n_nationkey FROM nation, kinds""")
def visible_dependency_closure(d: Driver) -> DataFrame:
    kinds = F.explode(F.array(F.lit("lib"), F.lit("test"), F.lit("build"))).alias("kind")
    return closure.visible_dependency_closure(d.packages().select("package_slot", kinds), d.dependencies())


@query(f"""WITH RECURSIVE {MODULES}, up AS (SELECT module_id, module_id AS ancestor_id FROM modules
  UNION ALL SELECT up.module_id, m.parent_id FROM up JOIN modules m ON up.ancestor_id = m.module_id WHERE m.parent_id IS NOT NULL) SELECT module_id, ancestor_id FROM up""")
def module_ancestors(d: Driver) -> DataFrame:
    return closure.ancestors(d.modules())


@query("SELECT DISTINCT c_nationkey AS package_slot, c_custkey AS target_id, o_orderkey AS file_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders)")
def targets_for_file(d: Driver) -> DataFrame:
    orders, customer = d.raw("orders"), d.raw("customer")
    tree = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("package_slot"), F.col("c_custkey").alias("target_id"), F.col("o_orderkey").alias("file_id"))
    asked = orders.join(F.broadcast(orders.agg(F.min("o_orderpriority").alias("o_orderpriority"))), "o_orderpriority", "left_semi").select(F.col("o_orderkey").alias("file_id"))
    return closure.targets_for_file(tree, asked)


@query(f"WITH {DEFS} SELECT def_id, name, kind, container, package_slot, start FROM defs WHERE package_slot IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
def package_subset(d: Driver) -> DataFrame:
    return closure.exact_subset(d.defs(), d.packages().filter("is_workspace_member"))


# ---- types and implementations --------------------------------------------------------------------------------------


@query(f"WITH {IMPLS} SELECT DISTINCT self_type AS type_id, impl_id, trait FROM impls WHERE self_type IN ({SUBJECTS})")
def impls_for_type(d: Driver) -> DataFrame:
    return semantic.impls_for_types(_subjects(d).select(F.col("entity_id").alias("type_id")), d.impls())


@query(f"WITH {IMPLS} SELECT DISTINCT trait, impl_id, self_type FROM impls WHERE trait IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 3 = 0)")
def impls_for_trait(d: Driver) -> DataFrame:
    return semantic.impls_for_traits(d.raw("supplier").filter("s_nationkey % 3 = 0").select(F.col("s_suppkey").alias("trait")), d.impls())


@query(f"WITH {IMPLS} SELECT DISTINCT self_type AS type_id, impl_id FROM impls WHERE trait IS NULL")
def inherent_impls(d: Driver) -> DataFrame:
    return semantic.inherent_impls(d.impls())


@query(f"WITH {IMPLS} SELECT DISTINCT self_type AS type_id, trait FROM impls WHERE trait IS NOT NULL")
def traits_for_type(d: Driver) -> DataFrame:
    return semantic.traits_for_types(d.impls())


@query(f"WITH {FIELDS} SELECT type_id, ordinal, name, ty FROM fields WHERE type_id IN ({SUBJECTS})")
def fields_for_type(d: Driver) -> DataFrame:
    return semantic.fields_for_types(_subjects(d).select(F.col("entity_id").alias("type_id")), d.fields())


@query(f"""WITH {FIELDS}, looks AS (SELECT p_partkey AS lookup_id, p_partkey AS type_id, CASE p_size % 3 WHEN 0 THEN 'size' WHEN 1 THEN '1' ELSE 'none' END AS key FROM part)
SELECT lookup_id, ordinal, name, ty FROM looks JOIN fields USING (type_id) WHERE key = name OR key = CAST(ordinal AS VARCHAR)""")
def field_by_key(d: Driver) -> DataFrame:
    key = F.when(F.col("p_size") % 3 == 0, "size").when(F.col("p_size") % 3 == 1, "1").otherwise("none")
    return semantic.field_by_key(d.raw("part").select(F.col("p_partkey").alias("lookup_id"), F.col("p_partkey").alias("type_id"), key.alias("key")), d.fields())


@query(f"""WITH {IMPLS} SELECT p_partkey AS entity_id, 'type' AS entity_kind, impl_id, self_type FROM part JOIN impls ON self_type = p_partkey
UNION SELECT s_suppkey, 'trait', impl_id, self_type FROM supplier JOIN impls ON trait = s_suppkey""")
def goto_implementation(d: Driver) -> DataFrame:
    types = d.raw("part").select(F.col("p_partkey").alias("entity_id"), F.lit("type").alias("entity_kind"))
    traits = d.raw("supplier").select(F.col("s_suppkey").alias("entity_id"), F.lit("trait").alias("entity_kind"))
    return semantic.goto_implementation(types.unionByName(traits), d.impls())


VERDICT = "CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END"


@query(f"SELECT receiver, function_id, CAST(verdict AS INT) AS verdict FROM (SELECT l_partkey AS receiver, l_suppkey AS function_id, min({VERDICT}) AS verdict FROM lineitem GROUP BY 1, 2) WHERE verdict < 2")
def applicability_best(d: Driver) -> DataFrame:
    verdict = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return semantic.best_applicability(d.raw("lineitem").select(F.col("l_partkey").alias("receiver"), F.col("l_suppkey").alias("function_id"), verdict.alias("verdict")))


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 4 = 0 THEN 2 ELSE greatest(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END,
  CASE WHEN l_linestatus = 'O' THEN 0 WHEN l_quantity < 5 THEN 1 WHEN l_suppkey % 10 = l_partkey % 10 THEN 0 ELSE 2 END) END AS INT) AS verdict FROM lineitem""")
def trait_applicability(d: Driver) -> DataFrame:
    have = F.when(F.col("l_quantity") >= 5, (F.col("l_suppkey") % 10).cast("string"))
    want = F.when(F.col("l_linestatus") != "O", (F.col("l_partkey") % 10).cast("string"))
    args = F.when(F.col("l_linenumber") % 4 == 0, F.array(have, have)).otherwise(F.array(have))
    return d.raw("lineitem").select("l_orderkey", "l_linenumber", semantic.trait_applicability(F.col("l_returnflag") == "R", args, F.array(want)).alias("verdict"))


@query("SELECT l_partkey AS expr, CASE WHEN count(DISTINCT l_suppkey % 7) = 1 THEN min(l_suppkey % 7) END AS ty, count(DISTINCT l_suppkey % 7) = 1 AS is_known FROM lineitem GROUP BY 1")
def unique_or_unknown(d: Driver) -> DataFrame:
    return semantic.unique_or_unknown(d.raw("lineitem").select(F.col("l_partkey").alias("expr"), (F.col("l_suppkey") % 7).alias("ty")), ["expr"])


# ---- scopes and imports ---------------------------------------------------------------------------------------------

# Modules are nations (ids), targets their regions; every supplier is a binding, every nation imports from two others.
BINDINGS = """bindings AS (
  SELECT CAST(s_nationkey AS BIGINT) AS module_id, 'item' || (s_suppkey % 40) AS name, 't' AS ns, s_suppkey AS def_id,
         CASE s_suppkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'crate' WHEN 2 THEN 'super' ELSE 'public' END AS visibility, CAST(s_nationkey AS BIGINT) AS owner, 'own' AS origin FROM supplier)"""
TREE = "tree AS (SELECT CAST(n_nationkey AS BIGINT) AS module_id, CAST(n_regionkey AS BIGINT) AS target_id, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST(n_nationkey // 5 * 5 AS BIGINT) END AS parent_id FROM nation)"
IMPORTS = """imports AS (
  SELECT CAST(n_nationkey AS BIGINT) AS import_id, CAST(n_nationkey AS BIGINT) AS module_id, CASE WHEN n_nationkey % 2 = 0 THEN 'glob' ELSE 'named' END AS kind, CAST((n_nationkey * 3 + 1) % 25 AS BIGINT) AS source,
         CASE WHEN n_nationkey % 2 = 1 THEN 'item' || (n_nationkey % 11) END AS item, CASE WHEN n_nationkey % 7 = 3 AND n_nationkey % 2 = 1 THEN '_' END AS binding, 'public' AS visibility FROM nation)"""


def _bindings(d: Driver) -> DataFrame:
    vis = F.element_at(F.array(*map(F.lit, ("private", "crate", "super", "public"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    n = F.col("s_nationkey").cast("long")
    return d.raw("supplier").select(n.alias("module_id"), F.concat(F.lit("item"), (F.col("s_suppkey") % 40).cast("string")).alias("name"), F.lit("t").alias("ns"), F.col("s_suppkey").alias("def_id"), vis.alias("visibility"), n.alias("owner"), F.lit("own").alias("origin"))


def _tree(d: Driver) -> DataFrame:
    n = F.col("n_nationkey")
    return d.raw("nation").select(n.cast("long").alias("module_id"), F.col("n_regionkey").cast("long").alias("target_id"), F.when(n % 5 != 0, (F.floor(n / 5) * 5).cast("long")).alias("parent_id"))


def _imports(d: Driver) -> DataFrame:
    n = F.col("n_nationkey")
    return d.raw("nation").select(
        n.cast("long").alias("import_id"), n.cast("long").alias("module_id"), F.when(n % 2 == 0, "glob").otherwise("named").alias("kind"), ((n * 3 + 1) % 25).cast("long").alias("source"),
        F.when(n % 2 == 1, F.concat(F.lit("item"), (n % 11).cast("string"))).alias("item"), F.when((n % 7 == 3) & (n % 2 == 1), "_").alias("binding"), F.lit("public").alias("visibility"),
    )


ANCESTORS = "anc AS (SELECT module_id, module_id AS ancestor_id FROM tree UNION SELECT module_id, parent_id FROM tree WHERE parent_id IS NOT NULL)"


def _ancestors(d: Driver) -> DataFrame:
    return closure.ancestors(_tree(d))


@query(f"""WITH {BINDINGS}, {TREE}, {ANCESTORS}, uses AS (
  SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS importer, l_suppkey AS def_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT u.importer, b.module_id, b.name, b.def_id, b.visibility, b.owner FROM uses u JOIN bindings b USING (def_id) JOIN tree i ON u.importer = i.module_id JOIN tree o ON b.owner = o.module_id
WHERE b.visibility = 'public' OR (i.target_id = o.target_id AND (b.visibility = 'crate' OR EXISTS (
  SELECT 1 FROM anc WHERE anc.module_id = i.module_id AND anc.ancestor_id = CASE b.visibility WHEN 'private' THEN b.owner WHEN 'super' THEN o.parent_id END)))""")
def binding_visibility(d: Driver) -> DataFrame:
    """Which modules (nations of customers) may see the bindings (suppliers) that they use."""
    orders = d.raw("lineitem").join(d.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.col("l_suppkey").alias("def_id"))
    uses = orders.join(d.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("long").alias("importer"), "def_id").distinct()
    pairs = _bindings(d).select("module_id", "name", "def_id", "visibility", "owner").join(uses, "def_id")
    return imports.visible_to(pairs, _tree(d), _ancestors(d))


@query(f"""WITH {BINDINGS}, {IMPORTS} SELECT import_id FROM imports i WHERE CASE WHEN kind = 'glob' THEN NOT EXISTS (SELECT 1 FROM bindings b WHERE b.module_id = i.source)
  ELSE NOT EXISTS (SELECT 1 FROM bindings b WHERE b.module_id = i.source AND b.name = i.item) END""")
def unresolved_imports(d: Driver) -> DataFrame:
    return imports.unresolved_imports(_imports(d), _bindings(d))


@query(f"""WITH {BINDINGS}, {IMPORTS}, {TREE}, {ANCESTORS},
seen AS (SELECT i.module_id, i.kind, i.binding, b.name, b.ns, b.def_id FROM imports i JOIN bindings b ON b.module_id = i.source AND (i.kind = 'glob' OR b.name = i.item)
  JOIN tree t ON t.module_id = i.module_id JOIN tree o ON o.module_id = b.owner
  WHERE (b.visibility = 'public' OR (t.target_id = o.target_id AND (b.visibility = 'crate' OR EXISTS (SELECT 1 FROM anc WHERE anc.module_id = i.module_id AND anc.ancestor_id = CASE b.visibility WHEN 'private' THEN b.owner WHEN 'super' THEN o.parent_id END))))
    AND (i.binding IS NULL OR i.binding <> '_')),
direct AS (SELECT module_id, name, ns, def_id, visibility, owner, origin FROM bindings UNION SELECT module_id, coalesce(binding, name), ns, def_id, 'public', module_id, 'import' FROM seen WHERE kind <> 'glob')
SELECT * FROM direct UNION SELECT module_id, name, ns, def_id, 'public', module_id, 'glob' FROM seen s WHERE kind = 'glob'
  AND NOT EXISTS (SELECT 1 FROM direct x WHERE x.module_id = s.module_id AND x.name = s.name AND x.ns = s.ns)""")
def import_round(d: Driver) -> DataFrame:
    """One round of imports: named, glob, hidden and visible ones."""
    return imports.import_round(_bindings(d), _bindings(d), _imports(d), _tree(d), _ancestors(d))


@query(f"""WITH RECURSIVE base AS (SELECT CAST(s_nationkey AS BIGINT) AS module_id, 'item' || s_suppkey AS name, 't' AS ns, s_suppkey AS def_id, CAST(s_nationkey AS BIGINT) AS owner FROM supplier),
chain AS (SELECT module_id, def_id FROM base UNION SELECT CAST(n_nationkey AS BIGINT), chain.def_id FROM nation JOIN chain ON chain.module_id = (n_nationkey * 3 + 1) % 25 WHERE n_nationkey % 2 = 0)
SELECT module_id, 'item' || def_id AS name, 't' AS ns, def_id, 'public' AS visibility, module_id AS owner, CASE WHEN EXISTS (SELECT 1 FROM base b WHERE b.module_id = chain.module_id AND b.def_id = chain.def_id) THEN 'own' ELSE 'glob' END AS origin FROM chain""")
def import_fixpoint(d: Driver) -> DataFrame:
    """Chains and cycles of globs over public names, to the fixpoint."""
    base = _bindings(d).withColumns({"name": F.concat(F.lit("item"), F.col("def_id").cast("string")), "visibility": F.lit("public")})
    return imports.import_fixpoint(base, _imports(d).filter("kind = 'glob'"), _tree(d), _ancestors(d))


@query("""WITH uses AS (SELECT o_orderkey AS use_id, CAST(o_custkey % 25 AS BIGINT) AS module_id, CAST(o_custkey % 5 AS BIGINT) AS target_id, 'n' || (o_orderkey % 60) AS name, o_orderstatus = 'F' AS absolute FROM orders),
own AS (SELECT CAST(s_nationkey AS BIGINT) AS module_id, 'n' || (s_suppkey % 30) AS name, s_suppkey AS def_id FROM supplier),
root AS (SELECT CAST(n_regionkey AS BIGINT) AS target_id, 'n' || (n_nationkey + 20) AS name, CAST(n_nationkey + 1000000 AS BIGINT) AS def_id FROM nation),
prel AS (SELECT CAST(r_regionkey AS BIGINT) AS target_id, 'n' || k AS name, CAST(2000000 + k AS BIGINT) AS def_id FROM region, (SELECT unnest(range(40, 55)) AS k)),
found AS (SELECT use_id, def_id, 0 AS priority FROM uses JOIN own USING (module_id, name) WHERE NOT absolute
  UNION SELECT use_id, def_id, 1 FROM uses JOIN root USING (target_id, name) UNION SELECT use_id, def_id, 2 FROM uses JOIN prel USING (target_id, name) WHERE NOT absolute)
SELECT use_id, def_id, CAST(priority AS INT) AS priority FROM found f WHERE priority = (SELECT min(priority) FROM found g WHERE g.use_id = f.use_id)""")
def first_segment_priority(d: Driver) -> DataFrame:
    name = lambda c: F.concat(F.lit("n"), c.cast("string")).alias("name")
    uses = d.raw("orders").select(F.col("o_orderkey").alias("use_id"), (F.col("o_custkey") % 25).alias("module_id"), (F.col("o_custkey") % 5).alias("target_id"), name(F.col("o_orderkey") % 60), (F.col("o_orderstatus") == "F").alias("absolute"))
    own = d.raw("supplier").select(F.col("s_nationkey").cast("long").alias("module_id"), name(F.col("s_suppkey") % 30), F.col("s_suppkey").alias("def_id"))
    roots = d.raw("nation").select(F.col("n_regionkey").cast("long").alias("target_id"), name(F.col("n_nationkey") + 20), (F.col("n_nationkey") + 1000000).cast("long").alias("def_id"))
    k = F.explode(F.sequence(F.lit(40), F.lit(54))).alias("k")
    prelude = d.raw("region").select(F.col("r_regionkey").cast("long").alias("target_id"), k).select("target_id", name(F.col("k")), (F.col("k") + 2000000).cast("long").alias("def_id"))
    return imports.first_segment(uses, own, roots, prelude)


@query(f"""WITH {MODULES}, scope AS (SELECT parent_id AS module_id, name, module_id AS def_id FROM modules WHERE parent_id IS NOT NULL),
paths AS (SELECT c_custkey AS path_id, CAST(n_regionkey AS BIGINT) AS module_id, n_name AS s0, CASE WHEN c_custkey % 10 = 0 THEN 'nobody' ELSE c_name END AS s1 FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT path_id, b.def_id, CASE WHEN a.def_id IS NULL THEN 0 WHEN b.def_id IS NULL THEN 1 END AS unresolved_at
FROM paths p LEFT JOIN scope a ON a.module_id = p.module_id AND a.name = s0 LEFT JOIN scope b ON b.module_id = a.def_id AND b.name = s1""")
def path_resolution(d: Driver) -> DataFrame:
    modules = d.modules()
    scope = modules.filter("parent_id is not null").select(F.col("parent_id").alias("module_id"), "name", F.lit("t").alias("ns"), F.col("module_id").alias("def_id"))
    last = F.when(F.col("c_custkey") % 10 == 0, "nobody").otherwise(F.col("c_name"))
    paths = d.raw("customer").join(d.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("path_id"), F.col("n_regionkey").cast("long").alias("module_id"), F.array("n_name", last).alias("segments"))
    return imports.resolve_paths(paths, scope, modules.select(F.col("module_id").alias("def_id"), F.col("module_id").alias("module")))


@query("""WITH defs AS (SELECT user_id AS scope, ts, event_id AS def_id, event_type AS name FROM events WHERE event_type IN ('signup', 'purchase')),
calls AS (SELECT user_id AS scope, ts, event_id AS call_id FROM events WHERE event_type = 'click')
SELECT c.call_id, c.scope, c.ts, (SELECT max((d.ts, d.def_id)) FROM defs d WHERE d.scope = c.scope AND d.ts < c.ts)[2] AS def_id FROM calls c""")
def textual_scope_asof(d: Driver) -> DataFrame:
    e = d.raw("events").select(F.col("user_id").alias("scope"), "ts", "event_id", "event_type")
    defs = e.filter(F.col("event_type").isin("signup", "purchase")).groupBy("scope", "ts").agg(F.max("event_id").alias("def_id"))
    calls = e.filter("event_type = 'click'").select(F.col("event_id").alias("call_id"), "scope", "ts")
    return last_before(calls, defs, ["scope"], "ts", "ts", ["def_id"], strict=True)


# ---- cfg, completion, rendering -------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_type LIKE '%A%' OR p_size > 25 WHEN 1 THEN NOT (p_brand = 'Brand#1') WHEN 2 THEN true ELSE p_size > 25 AND p_brand = 'Brand#1' END AS enabled FROM part""")
def cfg_eval(d: Driver) -> DataFrame:
    gates = [
        '{"op":"any","args":[{"op":"atom","key":"has_a"},{"op":"atom","key":"large"}]}', '{"op":"not","args":[{"op":"kv","key":"brand","value":"Brand#1"}]}',
        '{"op":"not","args":[]}', '{"op":"all","args":[{"op":"atom","key":"large"},{"op":"any","args":[{"op":"kv","key":"brand","value":"Brand#1"}]}]}',
    ]
    gate = F.element_at(F.array(*[F.lit(g) for g in gates]), (F.col("p_size") % 4 + 1).cast("int"))
    atoms = F.array_compact(F.array(F.when(F.contains("p_type", F.lit("A")), F.lit("has_a")), F.when(F.col("p_size") > 25, F.lit("large"))))
    pairs = F.array(F.concat(F.lit("brand="), "p_brand"))
    return d.raw("part").select("p_partkey", evaluate(F.parse_json(gate), atoms, pairs, F.lit(False)).alias("enabled"))


@query("""WITH b AS (SELECT o_orderkey AS site, 'l' || (o_custkey % 5) AS label, o_orderstatus AS ns, o_custkey AS def_id, 0 AS priority FROM orders WHERE o_custkey % 2 = 0
  UNION ALL SELECT l_orderkey, 'l' || (l_partkey % 5), l_linestatus, l_partkey, 1 FROM lineitem UNION ALL SELECT l_orderkey, 'l' || (l_suppkey % 5), 'O', l_suppkey, 2 FROM lineitem)
SELECT site, label, ns, def_id, CAST(priority AS INT) AS priority FROM b x WHERE priority = (SELECT min(priority) FROM b y WHERE y.site = x.site AND y.label = x.label AND y.ns = x.ns)""")
def unqualified_completion_shadowing(d: Driver) -> DataFrame:
    label = lambda c: F.concat(F.lit("l"), (F.col(c) % 5).cast("string")).alias("label")
    o, li = d.raw("orders"), d.raw("lineitem")
    body = o.filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("site"), label("o_custkey"), F.col("o_orderstatus").alias("ns"), F.col("o_custkey").alias("def_id"))
    module = li.select(F.col("l_orderkey").alias("site"), label("l_partkey"), F.col("l_linestatus").alias("ns"), F.col("l_partkey").alias("def_id"))
    roots = li.select(F.col("l_orderkey").alias("site"), label("l_suppkey"), F.lit("O").alias("ns"), F.col("l_suppkey").alias("def_id"))
    return completion.unqualified(body, module, roots, roots.limit(0))


@query(f"""WITH {FIELDS}, li AS (SELECT l_orderkey * 10 + l_linenumber AS site, l_partkey AS type_id, l_linenumber, l_returnflag FROM lineitem),
written AS (SELECT site, 'size' AS name FROM li WHERE l_linenumber % 2 = 0 UNION SELECT site, 'brand' FROM li WHERE l_returnflag = 'R')
SELECT site, type_id, ordinal, name, ty FROM li JOIN fields USING (type_id) WHERE NOT EXISTS (SELECT 1 FROM written w WHERE w.site = li.site AND w.name = fields.name)""")
def record_field_antijoin(d: Driver) -> DataFrame:
    li = d.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"), F.col("l_partkey").alias("type_id"), "l_linenumber", "l_returnflag")
    written = li.filter("l_linenumber % 2 = 0").select("site", F.lit("size").alias("name")).unionByName(li.filter("l_returnflag = 'R'").select("site", F.lit("brand").alias("name")))
    return completion.record_fields(li.select("site", "type_id"), d.fields(), written)


@query(f"WITH {DEFS} SELECT def_id, kind, lpad(CAST(package_slot % 4 AS VARCHAR), 2, '0') || '|' || lower(name) || '|' || lpad(CAST({RANK} AS VARCHAR), 2, '0') || '|' || CAST(def_id % 3 AS VARCHAR) || '|' || lpad(CAST(package_slot AS VARCHAR), 6, '0') AS sort_text FROM defs")
def completion_sort_text(d: Driver) -> DataFrame:
    c = F.col
    return d.defs().select("def_id", "kind", completion_sort_key(c("package_slot") % 4, c("name"), rank_of(c("kind")), c("def_id") % 3, c("package_slot")).alias("sort_text"))


@query(f"""WITH {FIELDS}, recv AS (SELECT p_partkey AS receiver FROM part WHERE p_size < 10), {IMPLS},
v AS (SELECT l_partkey AS receiver, CAST(l_suppkey AS VARCHAR) AS label, min({VERDICT}) AS verdict FROM lineitem GROUP BY 1, 2)
SELECT receiver, name AS label, 'field' AS kind, 0 AS bucket, 0 AS applicability FROM recv JOIN fields ON type_id = receiver
UNION ALL SELECT receiver, CAST(impl_id AS VARCHAR), 'function', 1, 0 FROM recv JOIN (SELECT DISTINCT self_type, impl_id FROM impls WHERE trait IS NULL) ON self_type = receiver
UNION ALL SELECT receiver, label, 'function', 2, CAST(verdict AS INT) FROM recv JOIN v USING (receiver) WHERE verdict < 2""")
def member_completion(d: Driver) -> DataFrame:
    receivers = d.raw("part").filter("p_size < 10").select(F.col("p_partkey").alias("receiver"))
    inherent = semantic.inherent_impls(d.impls()).select(F.col("type_id").alias("receiver"), F.col("impl_id").cast("string").alias("label"))
    verdict = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    verdicts = d.raw("lineitem").select(F.col("l_partkey").alias("receiver"), F.col("l_suppkey").cast("string").alias("function_id"), verdict.alias("verdict"))
    return completion.members(receivers, d.fields(), inherent, verdicts).drop("sort_text")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'f' ELSE 'f(' || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '${1:a}' ELSE '${1:a}, ${2:b}' END || ')' END AS snippet FROM orders""")
def call_snippets(d: Driver) -> DataFrame:
    params = F.element_at(F.array(F.array(F.lit("&self")), F.array(F.lit("self"), F.lit("a")), F.array(F.lit("a"), F.lit("b"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return d.raw("orders").select("o_orderkey", call_snippet(F.lit("f"), params, F.col("o_orderstatus") == "P").alias("snippet"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'pub ' ELSE '' END || CASE p_size % 3 WHEN 0 THEN 'struct ' || p_brand WHEN 1 THEN 'fn ' || p_brand || '(a: i32, b) -> ' || p_type ELSE 'const ' || p_brand || ': ' || p_type END AS text FROM part""")
def signatures(d: Driver) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "struct").when(size % 3 == 1, "function").otherwise("const")
    return d.raw("part").select("p_partkey", signature(kind, F.col("p_brand"), F.when(size % 2 == 0, "pub").otherwise("private"), F.array(F.lit("a: i32"), F.lit("b")), F.col("p_type")).alias("text"))


# ---- statistics and fingerprints ------------------------------------------------------------------------------------


@query("SELECT * FROM (SELECT 'packages' AS counter, count(*) AS n FROM nation UNION ALL SELECT 'items', count(*) FROM part UNION ALL SELECT 'sites', count(*) FROM lineitem UNION ALL SELECT 'files', count(*) FROM documents)")
def project_stats(d: Driver) -> DataFrame:
    return stats.counters({"packages": d.packages(), "items": d.raw("part"), "sites": d.raw("lineitem"), "files": d.raw("documents")})


@query(f"WITH {DEFS} SELECT kind, count(*) AS n FROM defs GROUP BY kind")
def def_map_stats(d: Driver) -> DataFrame:
    return stats.counts_by_kind(d.defs())


@query("""SELECT l_returnflag, l_linestatus, l_linenumber, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS n,
  CAST((1 - grouping(l_returnflag)) + (1 - grouping(l_linestatus)) + (1 - grouping(l_linenumber)) AS INT) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus, l_linenumber)""")
def memory_rollup(d: Driver) -> DataFrame:
    return stats.memory_rollup(d.raw("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], F.floor("l_quantity").cast("long"))


@query("""WITH f AS (SELECT source AS package, doc_id, doc_id // 4096 AS band, CAST(doc_id AS VARCHAR) || ':' || sha256(coalesce(text, '')) AS d FROM documents),
b AS (SELECT package, band, count(*) AS n, sha256(string_agg(d, chr(10) ORDER BY doc_id)) AS h FROM f GROUP BY 1, 2)
SELECT package, CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(h, chr(10) ORDER BY band)) AS fingerprint FROM b GROUP BY 1""")
def package_fingerprint(d: Driver) -> DataFrame:
    return stats.package_fingerprints(d.files())


@query("SELECT doc_id AS file_id, sha256(text) AS hash FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def stale_cache_probe(d: Driver) -> DataFrame:
    """Cached hashes are missing for ids divisible by 5 and old for those divisible by 3."""
    now = d.files().select("file_id", F.sha2("text", 256).alias("hash"))
    cached = now.filter("file_id % 5 <> 0").withColumn("hash", F.when(F.col("file_id") % 3 == 0, F.lit("old")).otherwise(F.col("hash")))
    return stats.stale_artifacts(now, cached)


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'hit' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def cache_probe(d: Driver) -> DataFrame:
    now = d.files().select("file_id", F.sha2("text", 256).alias("hash"))
    cached = now.filter("file_id % 5 <> 0").withColumn("hash", F.when(F.col("file_id") % 3 == 0, F.lit("old")).otherwise(F.col("hash")))
    return stats.cache_probe(now, cached)


# ---- documents, overlays, diagnostics -------------------------------------------------------------------------------


@query(f"""WITH {EVENTS}, last AS (SELECT path, max(version) AS version, arg_max(op, version) AS op, max(CASE WHEN op = 'save' THEN version END) AS saved_version, max(CASE WHEN op IN ('open', 'change') THEN version END) AS live
  FROM doc_events WHERE op <> 'failed_save' GROUP BY path)
SELECT path, version, saved_version, coalesce(live > coalesce(saved_version, -1), false) AS is_dirty FROM last WHERE op <> 'close'""")
def document_latest_state(d: Driver) -> DataFrame:
    return incremental.latest_documents(d.document_events())


@query(f"""WITH {EVENTS} SELECT path, version, op, ts, value FROM (SELECT *, max(version) OVER (PARTITION BY path ORDER BY ts, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM doc_events) WHERE version < top""")
def late_event_drop(d: Driver) -> DataFrame:
    return incremental.late_events(d.document_events())


@query(f"""WITH {EVENTS} SELECT path, version, op, ts, value FROM (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY path ORDER BY ts, version)) - epoch_us(ts) AS gap FROM doc_events) WHERE gap IS NULL OR gap >= 60000000""")
def debounce_last(d: Driver) -> DataFrame:
    return incremental.debounced(d.document_events(), 60)


@query(f"""WITH {EVENTS}, e AS (SELECT path, epoch_us(ts) AS us, op = 'save' AS flush FROM doc_events WHERE path IS NOT NULL AND ts IS NOT NULL),
n AS (SELECT *, lead(us) OVER (PARTITION BY path ORDER BY us, flush) - us AS gap FROM e)
SELECT path, CASE WHEN flush THEN 'flush' ELSE 'trigger' END AS op, make_timestamp(us) AS ts, make_timestamp(us + CASE WHEN flush THEN 0 ELSE 60000000 END) AS fired_at
FROM n WHERE flush OR gap IS NULL OR gap >= 60000000""")
def debounce_flush(d: Driver) -> DataFrame:
    return incremental.debounced_with_flush(d.document_events().withColumn("op", F.when(F.col("op") == "save", "flush").otherwise("trigger")), 60)


@query("SELECT doc_id AS file_id, CASE WHEN doc_id % 4 = 0 THEN upper(source) ELSE text END AS text, doc_id % 4 = 0 AS is_dirty FROM documents")
def dirty_overlay(d: Driver) -> DataFrame:
    return incremental.overlay(d.files(), d.files().filter("file_id % 4 = 0").select("file_id", F.upper("package").alias("text")))


@query("""WITH days AS (SELECT user_id AS path, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error'), marks AS (SELECT min(CAST(ts AS DATE)) AS d0 FROM events),
p AS (SELECT path, count(*) AS n FROM days, marks WHERE day = d0 GROUP BY 1), c AS (SELECT path, count(*) AS n FROM days, marks WHERE day = d0 + 1 GROUP BY 1),
dirty AS (SELECT DISTINCT user_id AS path FROM events WHERE user_id % 7 = 0)
SELECT path, CASE WHEN path IN (SELECT path FROM dirty) THEN 'hold' WHEN c.n IS NULL THEN 'clear' ELSE 'publish' END AS action, coalesce(c.n, 0) AS n FROM p FULL JOIN c USING (path)""")
def diagnostics_publish(d: Driver) -> DataFrame:
    e = d.raw("events").withColumn("day", F.to_date("ts"))
    first = F.broadcast(e.agg(F.min("day").alias("d0")))
    errors = e.filter("event_type = 'error'").join(first)
    run = lambda k: errors.filter(F.col("day") == F.date_add("d0", k)).groupBy(F.col("user_id").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return incremental.publication_plan(run(0), run(1), e.filter("user_id % 7 = 0").select(F.col("user_id").alias("path")))


@query("SELECT user_id AS path, CAST(ts AS DATE) AS run, event_id FROM events e WHERE event_type = 'error' AND CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events f WHERE f.user_id = e.user_id AND event_type = 'error')")
def diagnostics_latest_generation(d: Driver) -> DataFrame:
    runs = d.raw("events").filter("event_type = 'error'").select(F.col("user_id").alias("path"), F.to_date("ts").alias("run"), "event_id")
    return incremental.latest_generation(runs)


@query(f"""WITH RECURSIVE {DEPS}, up AS (SELECT n_nationkey AS package_slot FROM nation WHERE n_regionkey = 2 UNION SELECT deps.package_slot FROM deps JOIN up ON deps.dep_slot = up.package_slot) SELECT package_slot FROM up""")
def rebuild_set(d: Driver) -> DataFrame:
    changed = d.raw("nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("package_slot"))
    return incremental.rebuild_set(changed, closure.reverse_dependency_closure(changed, d.dependencies()))


# ---- real code: texts that a rule makes of the tables' rows, so that SQL knows what lexing must find -----------------

CODE = r"""code AS (SELECT s_suppkey AS file_id, '/// Docs of ' || s_name || chr(10) || 'pub struct S' || s_suppkey || ' { pub key: u64, bal: f64 }' || chr(10) || '/* fn not_here() {} */ #[cfg(unix)]' || chr(10)
  || 'pub(crate) fn get' || s_suppkey || '(s: &str) -> u64 { let t = "}"; 7 }' || chr(10) || 'enum E { A' || s_suppkey || ', B(i32) }' || chr(10) AS text, CAST(s_suppkey AS VARCHAR) AS k, s_name FROM supplier)"""


def code_files(d: Driver) -> DataFrame:
    """Small files of Rust text, one a supplier: the same text as CODE."""
    k = F.col("s_suppkey").cast("string")
    lines = [
        F.concat(F.lit("/// Docs of "), "s_name"), F.concat(F.lit("pub struct S"), k, F.lit(" { pub key: u64, bal: f64 }")), F.lit("/* fn not_here() {} */ #[cfg(unix)]"),
        F.concat(F.lit("pub(crate) fn get"), k, F.lit('(s: &str) -> u64 { let t = "}"; 7 }')), F.concat(F.lit("enum E { A"), k, F.lit(", B(i32) }")), F.lit(""),
    ]
    return d.raw("supplier").select(F.col("s_suppkey").alias("file_id"), F.concat_ws("\n", *lines).alias("text"))


@query(f"""WITH {CODE} SELECT file_id, 'struct' AS kind, 'S' || k AS name, 'pub' AS visibility, CAST(strpos(text, 'struct') - 1 AS BIGINT) AS item_id, CAST(strpos(text, '}}') AS BIGINT) AS span_end FROM code
  UNION ALL SELECT file_id, 'function', 'get' || k, 'pub(crate)', strpos(text, 'fn get') - 1, strpos(text, '7 }}') + 2 FROM code
  UNION ALL SELECT file_id, 'enum', 'E', 'private', strpos(text, 'enum E') - 1, length(text) - 1 FROM code""")
def code_items(d: Driver) -> DataFrame:
    return lexing.items(lexing.tokens(code_files(d))).select("file_id", "kind", "name", "visibility", "item_id", "span_end")


@query(f"WITH {CODE} SELECT file_id, CAST(strpos(text, 'struct') - 1 AS BIGINT) AS item_id, 'Docs of ' || s_name AS docs FROM code")
def code_docs(d: Driver) -> DataFrame:
    toks = lexing.tokens(code_files(d))
    return lexing.item_docs(toks, lexing.items(toks))


@query(f"""WITH {CODE} SELECT file_id, CAST(strpos(text, 'fn get') - 1 AS BIGINT) AS item_id, '{{"op": "atom", "key": "unix"}}' AS gate FROM code""")
def code_cfg_gates(d: Driver) -> DataFrame:
    toks = lexing.tokens(code_files(d))
    return lexing.cfg_gates(toks, lexing.items(toks))


@query(f"""WITH {CODE} SELECT file_id, 'key' AS name, CAST(0 AS INT) AS ordinal, CAST(strpos(text, 'key:') - 1 AS BIGINT) AS name_start FROM code UNION ALL SELECT file_id, 'bal', 1, strpos(text, 'bal:') - 1 FROM code
  UNION ALL SELECT file_id, 'A' || k, 0, strpos(text, '{{ A') + 1 FROM code UNION ALL SELECT file_id, 'B', 1, strpos(text, 'B(i32)') - 1 FROM code""")
def code_members(d: Driver) -> DataFrame:
    toks = lexing.tokens(code_files(d))
    found = lexing.items(toks)
    variants = scopes.enum_variants(toks, found).select("file_id", "name", F.col("index").alias("ordinal"), "name_start")
    return scopes.struct_fields(toks, found).select("file_id", "name", "ordinal", "name_start").unionByName(variants)


@query(f"""WITH {CODE} SELECT file_id, 'S' || k AS name, 't' AS ns, 'pub' AS visibility FROM code UNION ALL SELECT file_id, 'S' || k, 'v', 'pub' FROM code
  UNION ALL SELECT file_id, 'get' || k, 'v', 'pub(crate)' FROM code UNION ALL SELECT file_id, 'E', 't', 'private' FROM code""")
def code_bindings(d: Driver) -> DataFrame:
    return scopes.base_bindings(lexing.items(lexing.tokens(code_files(d)))).select("file_id", "name", "ns", "visibility")


@query(f"""WITH {CODE} SELECT file_id, 't' AS name, CAST(strpos(text, 't = "') - 1 AS BIGINT) AS span_start, '&str' AS ty FROM code""")
def code_let_bindings(d: Driver) -> DataFrame:
    return scopes.let_bindings(lexing.tokens(code_files(d))).select("file_id", "name", "span_start", "ty")


SCOPED = r"""scoped AS (SELECT s_suppkey AS file_id, 'fn count() {} fn item' || s_suppkey || '() {} enum K { One, Two(u8) }' || chr(10) || 'fn f(v: Vec<(u8, K)>, (left, right): (u8, u8)) {' || chr(10)
  || 'for count in v { count; } count(); let g = |left| left; if let Some(late) = late { late; } left;' || chr(10) || 'match v { K::Two(n) | K::Three { n } if n > 1 => n, other => { other } } item' || s_suppkey || '(); }' || chr(10) AS text, CAST(s_suppkey AS VARCHAR) AS k FROM supplier)"""
#: Place of a use: what stands before its name; and what stands before the name of its definition.
USES = [("v { ", "for "), ("count; } ", "fn "), ("|left| ", "g = |"), (") = late { ", "let Some("), ("late; } ", "), ("), ("if n > 1 => ", "K::Two("), ("K::Three { ", "K::Two("), ("=> { ", "=> n, "), ("other } } ", "{} fn ")]


def scoped_files(d: Driver) -> DataFrame:
    """Small files of Rust text whose names are bound by patterns, one a supplier: the same text as SCOPED."""
    k = F.col("s_suppkey").cast("string")
    lines = [
        F.concat(F.lit("fn count() {} fn item"), k, F.lit("() {} enum K { One, Two(u8) }")), F.lit("fn f(v: Vec<(u8, K)>, (left, right): (u8, u8)) {"),
        F.lit("for count in v { count; } count(); let g = |left| left; if let Some(late) = late { late; } left;"),
        F.concat(F.lit("match v { K::Two(n) | K::Three { n } if n > 1 => n, other => { other } } item"), k, F.lit("(); }")), F.lit(""),
    ]
    return d.raw("supplier").select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("/"), k, F.lit("/src/lib.rs")).alias("path"), F.concat_ws("\n", *lines).alias("text"))


@query(f"""WITH {SCOPED} """ + " UNION ALL ".join(f"""SELECT file_id, {n} AS use_no, CAST({'strpos(text, chr(40) || chr(108))' if to == '), (' else f"strpos(text, '{to}') + {len(to)} - 1"} AS BIGINT) AS name_start FROM scoped""" for n, (_, to) in enumerate(USES)))
def code_definitions(d: Driver) -> DataFrame:
    files = scoped_files(d)
    spots = F.array(*[F.struct(F.lit(n).alias("use_no"), (F.instr("text", at) + len(at) - 1).cast("long").alias("offset")) for n, (at, _) in enumerate(USES)])
    cursors = files.select("file_id", F.explode(spots).alias("s")).select(F.concat_ws("|", "file_id", "s.use_no").alias("query_id"), "file_id", "s.*")
    found = Analysis(files).goto_definition(cursors.select("query_id", "file_id", "offset"))
    return found.select(F.col("def_file").alias("file_id"), F.split("query_id", "\\|")[1].cast("int").alias("use_no"), "name_start")


GATED = r"""gated AS (SELECT s_suppkey AS file_id, s_suppkey % 2 AS odd, CAST(s_suppkey AS VARCHAR) AS k FROM supplier)"""


@query(f"""WITH {GATED}, targets AS (SELECT 1 AS target_id UNION ALL SELECT 2) SELECT target_id, file_id, name FROM (
  SELECT target_id, file_id, unnest(CASE WHEN target_id = 1 THEN ['os' || k, 'on_unix', 'all'] || CASE WHEN odd = 1 THEN ['featured'] ELSE [] END ELSE ['os' || k, 'on_windows', 'tested', 'only', 'all'] END) AS name FROM gated, targets)""")
def code_enabled_items(d: Driver) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    lines = [
        F.concat(F.lit("#[cfg(unix)] mod os"), k, F.lit(" { pub fn on_unix() {} #[cfg(test)] fn unix_test() {} }")), F.concat(F.lit("#[cfg(not(unix))] mod os"), k, F.lit(" { fn on_windows() {} #[cfg(test)] fn tested() {} }")),
        F.lit("#[cfg_attr(unix, cfg(test))] fn only() {} fn all() {}"), F.concat(F.lit('#[cfg(all(unix, feature = "f'), (F.col("s_suppkey") % 2).cast("string"), F.lit('"))] fn featured() {}')),
    ]
    files = d.raw("supplier").select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("/"), k, F.lit("/src/lib.rs")).alias("path"), F.concat_ws("\n", *lines).alias("text"))
    near = durable(brackets.structure(lexing.tokens(files)), "structure")
    items = durable(lexing.items(near), "items")
    kinds = F.array(F.struct(F.lit(1).alias("t"), F.array(F.lit("unix")).alias("atoms"), F.array(F.lit("feature=f1")).alias("pairs"), F.lit(False).alias("is_test")), F.struct(F.lit(2).alias("t"), F.array(F.lit("windows")).alias("atoms"), F.array().cast("array<string>").alias("pairs"), F.lit(True).alias("is_test")))
    targets = files.select("file_id", F.explode(kinds).alias("k")).select(F.concat_ws(":", "k.t", "file_id").alias("target_id"), F.col("file_id").alias("root_file"), "k.atoms", "k.pairs", "k.is_test")
    on = gates.enabled_items(items, lexing.cfg_gates(near, items), lexing.module_files(items, files), targets)
    return on.join(items, ["file_id", "item_id"]).select(F.split("target_id", ":")[0].cast("int").alias("target_id"), "file_id", "name")


# ---- operators that no other query covers ----------------------------------------------------------------------------

LATE = "late AS (SELECT user_id AS path, event_id * 7919 % 10007 AS version, ts FROM events)"


@query(f"WITH {LATE} SELECT path, version, ts FROM (SELECT *, max(version) OVER (PARTITION BY path ORDER BY ts, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM late) WHERE version < top")
def late_events_out_of_order(d: Driver) -> DataFrame:
    return incremental.late_events(d.raw("events").select(F.col("user_id").alias("path"), (F.col("event_id") * 7919 % 10007).alias("version"), "ts"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS atom, CASE WHEN p_size % 3 = 0 THEN 'brand' END AS key, CASE WHEN p_size % 3 = 0 THEN p_brand END AS value FROM part""")
def cfg_lines(d: Driver) -> DataFrame:
    line = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(' brand = "'), "p_brand", F.lit('" '))).otherwise(F.concat(F.lit("  "), "p_brand", F.lit(" ")))
    return d.raw("part").select("p_partkey", parse_cfg_line(line).alias("c")).select("p_partkey", "c.*")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size <= 25 OR p_brand = 'Brand#1' ELSE p_size > 25 END AS admitted FROM part")
def cfg_attr_admission(d: Driver) -> DataFrame:
    kind = F.when(F.col("p_size") % 2 == 0, "cfg_attr").otherwise("cfg")
    return d.raw("part").select("p_partkey", gate_admits(kind, F.col("p_size") > 25, F.col("p_brand") == "Brand#1").alias("admitted"))


@query("""WITH impls AS (SELECT DISTINCT l_partkey AS type_id, l_suppkey AS trait, l_suppkey AS impl_id FROM lineitem WHERE NOT (l_partkey % 2 = 0 AND l_suppkey % 2 = 0))
  SELECT DISTINCT type_id, o_orderkey AS function_id FROM impls JOIN orders ON trait = o_custkey % 1000 UNION SELECT type_id, c_custkey + 1000000 FROM impls JOIN customer ON impl_id = c_custkey % 500""")
def trait_functions(d: Driver) -> DataFrame:
    functions = d.raw("orders").select((F.col("o_custkey") % 1000).alias("trait"), F.col("o_orderkey").alias("function_id"))
    own = d.raw("customer").select((F.col("c_custkey") % 500).alias("impl_id"), (F.col("c_custkey") + 1_000_000).alias("function_id"))
    return semantic.trait_functions(semantic.traits_for_types(d.impls()), functions, own, d.impls())


@query("SELECT o_orderkey AS lookup_id, min(l_linenumber) AS index FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linestatus = o_orderstatus GROUP BY o_orderkey")
def variant_by_name(d: Driver) -> DataFrame:
    lookups = d.raw("orders").select(F.col("o_orderkey").alias("lookup_id"), F.col("o_orderkey").alias("type_id"), F.col("o_orderstatus").alias("name"))
    return semantic.variant_by_name(lookups, d.raw("lineitem").select(F.col("l_orderkey").alias("type_id"), F.col("l_linestatus").alias("name"), F.col("l_linenumber").alias("index")))


@query("SELECT event_id AS query_id, user_id AS path, event_id % 5 AS version FROM events JOIN customer ON user_id = c_custkey AND event_id % 5 = c_nationkey % 5")
def stale_query_rejection(d: Driver) -> DataFrame:
    asked = d.raw("events").select(F.col("event_id").alias("query_id"), F.col("user_id").alias("path"), (F.col("event_id") % 5).alias("version"))
    return incremental.still_current(asked, d.raw("customer").select(F.col("c_custkey").alias("path"), (F.col("c_nationkey") % 5).cast("long").alias("version"))).select("query_id", "path", "version")


@query("""SELECT path, CASE WHEN m = 0 THEN 'lockfile' WHEN m = 1 AND k % 2 = 0 THEN 'manifest' WHEN m = 1 THEN 'new_manifest' ELSE 'target_root' END AS reason FROM (
  SELECT c_custkey AS k, c_custkey % 4 AS m, '/w/' || c_custkey || '/' || CASE c_custkey % 4 WHEN 0 THEN 'Cargo.lock' WHEN 1 THEN 'Cargo.toml' WHEN 2 THEN 'lib.rs' ELSE 'util.rs' END AS path FROM customer) WHERE m < 3""")
def graph_change_reasons(d: Driver) -> DataFrame:
    m = F.col("c_custkey") % 4
    name = F.when(m == 0, "Cargo.lock").when(m == 1, "Cargo.toml").when(m == 2, "lib.rs").otherwise("util.rs")
    saved = d.raw("customer").select("c_custkey", m.alias("m"), F.concat(F.lit("/w/"), F.col("c_custkey").cast("string"), F.lit("/"), name).alias("path"))
    return incremental.graph_changed(saved.select("path"), saved.filter("m = 1 and c_custkey % 2 = 0").select("path"), saved.filter("m = 2").select("path"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)


__all__ = ["oracle_sql", "queries"]
