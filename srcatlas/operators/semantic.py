"""Types, traits, implementations, fields (F.2-F.13, I.6) and the applicability lattice (G.16-G.18, G.22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdicts of applicability, the best first.
YES, MAYBE, NO = 0, 1, 2


def impls_for_types(types: DataFrame, impls: DataFrame) -> DataFrame:
    """F.9: (type_id, impl_id) of implementations whose self type is asked for."""
    return impls.join(types.select(F.col("type_id").alias("self_type")), "self_type", "left_semi").select(F.col("self_type").alias("type_id"), "impl_id", "trait").distinct()


def impls_for_traits(traits: DataFrame, impls: DataFrame) -> DataFrame:
    """F.10: (trait, impl_id, self_type) of implementations of the traits."""
    return impls.join(traits.select("trait"), "trait", "left_semi").select("trait", "impl_id", "self_type").distinct()


def inherent_impls(impls: DataFrame) -> DataFrame:
    """F.11: implementations without a trait."""
    return impls.filter("trait is null").select(F.col("self_type").alias("type_id"), "impl_id").distinct()


def traits_for_types(impls: DataFrame) -> DataFrame:
    """F.12: distinct (type_id, trait)."""
    return impls.filter("trait is not null").select(F.col("self_type").alias("type_id"), "trait").distinct()


def fields_for_types(types: DataFrame, fields: DataFrame) -> DataFrame:
    """F.7: fields of the asked types with their ordinal."""
    return fields.join(types.select("type_id"), "type_id", "left_semi")


def field_by_key(lookups: DataFrame, fields: DataFrame) -> DataFrame:
    """F.7: (lookup_id, type_id, key) to a field by name or, for tuple fields, by its number."""
    keyed = lookups.join(fields, "type_id").filter((F.col("key") == F.col("name")) | (F.col("key") == F.col("ordinal").cast("string")))
    return keyed.groupBy("lookup_id").agg(F.min(F.struct("ordinal", "name", "ty")).alias("f")).select("lookup_id", "f.*")


def variant_by_name(lookups: DataFrame, variants: DataFrame) -> DataFrame:
    """F.8: the first variant (smallest index) with the name."""
    return lookups.join(variants, ["type_id", "name"]).groupBy("lookup_id").agg(F.min("index").alias("index"))


def goto_implementation(entities: DataFrame, impls: DataFrame) -> DataFrame:
    """I.6: a type leads to its implementations, a trait to the implementations of it (entity_id, entity_kind). Both sides are
    distinct before they meet, so the joined rows need no distinct."""
    asked = lambda kind: entities.filter(F.col("entity_kind") == kind).select("entity_id", "entity_kind").distinct()
    of_type = asked("type").join(impls.select("impl_id", "self_type").distinct(), F.col("entity_id") == F.col("self_type"))
    of_trait = asked("trait").join(impls.select("impl_id", "self_type", "trait").distinct(), F.col("entity_id") == F.col("trait"))
    cols = ["entity_id", "entity_kind", "impl_id", "self_type"]
    return of_type.select(*cols).unionByName(of_trait.select(*cols))


def trait_functions(traits_of_types: DataFrame, functions: DataFrame, impl_functions: DataFrame, impls: DataFrame) -> DataFrame:
    """F.13: functions that a type gets from its traits and from its trait implementations, each once.

    The sources of a function, nearly always one trait or implementation, are ordered: traits before implementations, each in
    order. A type takes a function from the first of them that it has, so the pairs need no distinct and are never shuffled.
    """
    has_trait = traits_of_types.filter("trait is not null").select("type_id", "trait").distinct()
    has_impl = impls.filter("trait is not null and impl_id is not null").select(F.col("self_type").alias("type_id"), "impl_id").distinct()
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    sources = functions.select("function_id", "trait", none(impl_functions, "impl_id")).unionByName(impl_functions.select("function_id", none(functions, "trait"), "impl_id"))
    by_function = sources.groupBy("function_id").agg(F.array_sort(F.collect_set("trait")).alias("_traits"), F.array_sort(F.collect_set("impl_id")).alias("_impls"))
    declared = by_function.select("function_id", "_traits", F.posexplode("_traits").alias("_n", "trait")).select("function_id", "trait", F.slice("_traits", F.lit(1), F.col("_n")).alias("_before"))
    own = by_function.select("function_id", "_traits", "_impls", F.posexplode("_impls").alias("_n", "impl_id")).select("function_id", "impl_id", "_traits", F.slice("_impls", F.lit(1), F.col("_n")).alias("_before"))
    # Of a type's sources only those that stand before another one in some function are looked at.
    firsts = declared.select(F.explode("_before").alias("trait")).unionByName(own.select(F.explode("_traits").alias("trait"))).distinct()
    first_impls = own.select(F.explode("_before").alias("impl_id")).distinct()
    traits_had = has_trait.join(firsts, "trait", "left_semi").groupBy("type_id").agg(F.collect_set("trait").alias("_had_traits"))
    impls_had = has_impl.join(first_impls, "impl_id", "left_semi").groupBy("type_id").agg(F.collect_set("impl_id").alias("_had_impls"))
    new = lambda had, before: ~F.coalesce(F.arrays_overlap(had, before), F.lit(False))
    by_trait = declared.join(has_trait.join(traits_had, "type_id", "left"), "trait").filter((F.size("_before") == 0) | new("_had_traits", "_before"))
    of_impl = has_impl.join(traits_had, "type_id", "left").join(impls_had, "type_id", "left")
    by_impl = own.join(of_impl, "impl_id").filter(((F.size("_traits") == 0) | new("_had_traits", "_traits")) & ((F.size("_before") == 0) | new("_had_impls", "_before")))
    return by_trait.select("type_id", "function_id").unionByName(by_impl.select("type_id", "function_id"))


def inherent_applicability(receiver_args: Column, impl_args: Column) -> Column:
    """G.16: arguments must agree in number; null in the implementation is a generic parameter and fits anything."""
    pairs = F.zip_with(receiver_args, impl_args, lambda r, i: i.isNull() | (F.coalesce(r, F.lit("?")) == i))
    return F.when((F.size(receiver_args) == F.size(impl_args)) & F.forall(pairs, lambda x: x), YES).otherwise(NO)


def trait_applicability(header_is_direct: Column, receiver_args: Column, impl_args: Column) -> Column:
    """G.17: Yes for a direct header, else Maybe; worse if arguments are unknown (Maybe) or differ (No)."""
    args = F.zip_with(receiver_args, impl_args, lambda r, i: F.when(i.isNull() | (r == i), YES).when(r.isNull(), MAYBE).otherwise(NO))
    worst = F.coalesce(F.array_max(args), F.lit(YES))
    return F.when(F.size(receiver_args) != F.size(impl_args), NO).otherwise(F.greatest(F.when(header_is_direct, YES).otherwise(MAYBE), worst))


def best_applicability(verdicts: DataFrame) -> DataFrame:
    """G.18: (receiver, function_id, verdict): the best verdict of each function; No is dropped."""
    return verdicts.groupBy("receiver", "function_id").agg(F.min("verdict").alias("verdict")).filter(F.col("verdict") < NO)


def unique_or_unknown(candidates: DataFrame, keys: list[str], ty: str = "ty") -> DataFrame:
    """G.22, G.11, G.13: the type if all candidates agree on one, else unknown. min = max needs no distinct set."""
    one = F.min(ty) == F.max(ty)
    return candidates.groupBy(*keys).agg(F.when(one, F.min(ty)).alias(ty)).withColumn("is_known", F.col(ty).isNotNull())


def substitute(args: Column, params: Column, values: Column) -> Column:
    """G.19: generic arguments with parameters replaced by their values; other names stay."""
    table = F.map_from_arrays(params, values)
    return F.transform(args, lambda a: F.coalesce(F.try_element_at(table, a), a))
