"""Completions (I.14-I.21)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import KEYWORDS, PRIMITIVES, completion_sort_key, rank_of
from ..plans.priority import first_of
from .semantic import best_applicability


def unqualified(body_scope: DataFrame, module_scope: DataFrame, extern_roots: DataFrame, prelude: DataFrame) -> DataFrame:
    """I.16: per site, label and namespace the innermost origin wins: body, module, extern root, prelude."""
    return first_of([body_scope, module_scope, extern_roots, prelude], ["site", "label", "ns"])


def record_fields(sites: DataFrame, fields: DataFrame, written: DataFrame) -> DataFrame:
    """I.17: named fields of the site's type that are not written yet."""
    return sites.join(fields, "type_id").join(written.select("site", "name"), ["site", "name"], "left_anti")


def members(receivers: DataFrame, fields: DataFrame, inherent: DataFrame, verdicts: DataFrame) -> DataFrame:
    """I.14: fields, inherent methods (known) and trait methods (known or maybe) of each receiver, with sort keys."""
    f = receivers.join(fields.select(F.col("type_id").alias("receiver"), F.col("name").alias("label")), "receiver").select("receiver", "label", F.lit("field").alias("kind"), F.lit(0).alias("bucket"), F.lit(0).alias("applicability"))
    i = receivers.join(inherent, "receiver").select("receiver", "label", F.lit("function").alias("kind"), F.lit(1).alias("bucket"), F.lit(0).alias("applicability"))
    t = best_applicability(verdicts).join(receivers, "receiver", "left_semi").select("receiver", F.col("function_id").alias("label"), F.lit("function").alias("kind"), F.lit(2).alias("bucket"), F.col("verdict").alias("applicability"))
    both = f.unionByName(i).unionByName(t)
    key = completion_sort_key(F.col("bucket"), F.col("label"), rank_of(F.col("kind")), F.col("applicability"), F.lit(0))
    return both.withColumn("sort_text", key)


def static_completions(sites: DataFrame) -> DataFrame:
    """I.18, I.19: keywords by the site's context (item, statement, expression, type), primitives at types."""
    words = [(c, w, "keyword") for c, ws in KEYWORDS.items() for w in ws] + [("type", w, "primitive") for w in PRIMITIVES]
    table = sites.sparkSession.createDataFrame(words, "context string, label string, kind string")
    return sites.join(F.broadcast(table), "context")
