"""cfg predicates as columns: gates are small JSON trees.

A gate node is {"op": all|any|not|atom|kv|true|false, "key", "value", "args": [node, ...]}; trees are read to DEPTH levels by column expressions, deeper
ones by a small helper.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 5


def parse_cfg_line(line: Column) -> Column:
    """C.5: key="value" or a bare atom."""
    pair = F.regexp_extract(line, r'^\s*([\w-]+)\s*=\s*"([^"]*)"\s*$', 1)
    return F.struct(
        F.when(pair == "", F.trim(line)).alias("atom"),
        F.when(pair != "", pair).alias("key"),
        F.when(pair != "", F.regexp_extract(line, r'^\s*([\w-]+)\s*=\s*"([^"]*)"\s*$', 2)).alias("value"),
    )


def evaluate(gate: Column, atoms: Column, pairs: Column, is_test: Column) -> Column:
    """C.4: truth of a gate. atoms: array<string>, pairs: array<string> of key=value; `test` is the target's flag.

    A `not` with other than one argument and anything malformed are enabled. Gates with nodes below DEPTH levels, which
    hardly occur, go through a helper; for all others it gets nulls.
    """
    deep = F.try_variant_get(gate, "$.args", "array<variant>")
    for _ in range(DEPTH):
        deep = F.flatten(F.transform(deep, lambda a: F.coalesce(F.try_variant_get(a, "$.args", "array<variant>"), F.expr("cast(array() as array<variant>)"))))
    below = F.when(F.size(deep) > 0, F.to_json(gate))
    return F.coalesce(F.arrow_udf(_deep_truth, "boolean")(below, atoms, pairs, is_test), _evaluated(gate, atoms, pairs, is_test, DEPTH))


def _deep_truth(gates: pa.Array, atoms: pa.Array, pairs: pa.Array, is_test: pa.Array) -> pa.Array:
    def truth(node, have: set, kv: set, test: bool) -> bool:
        op, args = (node.get("op"), node.get("args") or []) if isinstance(node, dict) else (None, [])
        if op == "atom":
            return test if node.get("key") == "test" else node.get("key") in have
        if op == "kv":
            return f"{node.get('key')}={node.get('value')}" in kv
        inner = [truth(a, have, kv, test) for a in args] if op in ("all", "any", "not") else []
        return all(inner) if op == "all" else any(inner) if op == "any" else not inner[0] if op == "not" and len(inner) == 1 else op != "false"

    return pa.array([None if g is None else truth(json.loads(g), set(a or ()), set(p or ()), bool(t)) for g, a, p, t in zip(*(x.to_pylist() for x in (gates, atoms, pairs, is_test)), strict=True)], pa.bool_())


def _evaluated(gate: Column, atoms: Column, pairs: Column, is_test: Column, depth: int) -> Column:
    node = F.variant_get(gate, "$.op", "string")
    atom = F.variant_get(gate, "$.key", "string")
    value = F.variant_get(gate, "$.value", "string")
    has_atom = F.when(atom == "test", is_test).otherwise(F.array_contains(atoms, atom))
    has_pair = F.array_contains(pairs, F.concat_ws("=", atom, value))

    def verdict(r: Column | None) -> Column:
        out = F.when(node == "true", F.lit(True)).when(node == "false", F.lit(False)).when(node == "atom", has_atom).when(node == "kv", has_pair)
        if r is not None:
            out = (
                out.when(node == "all", F.forall(r, lambda x: x)).when(node == "any", F.exists(r, lambda x: x))
                .when((node == "not") & (F.size(r) == 1), ~F.get(r, F.lit(0)))
            )
        return F.coalesce(out.otherwise(F.lit(True)), F.lit(True))

    if not depth:
        return verdict(None)
    args = F.coalesce(F.try_variant_get(gate, "$.args", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    results = F.transform(args, lambda a: _evaluated(a, atoms, pairs, is_test, depth - 1))
    # One-element transform: the results are named once, so the expression does not double at every level.
    return F.get(F.transform(F.array(results), verdict), F.lit(0))


def gate_admits(kind: Column, predicate: Column, inner: Column) -> Column:
    """C.3: a direct gate is its predicate; cfg_attr(p, cfg(q)) is not p or q."""
    return F.when(kind == "cfg_attr", ~predicate | inner).otherwise(predicate)
