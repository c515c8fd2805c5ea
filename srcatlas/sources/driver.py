"""Engine tables projected from TPC-H-like driver tables.

The driver tables hold no code. This projection is an invention that lets the operators be held against SQL; it says
nothing about code. Keys: modules are regions, nations, customers and suppliers as a tree; definitions are their rows;
reference sites are line items; implementations pair parts (types) with suppliers (traits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Offsets that keep the module ids of the four levels apart.
NATION, CUSTOMER, SUPPLIER = 1_000, 10_000_000_000, 20_000_000_000


class Driver:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def packages(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("package_slot"), F.col("n_name").alias("name"), (F.col("n_regionkey") == 0).alias("is_workspace_member"))

    def dependencies(self) -> DataFrame:
        """package_slot needs dep_slot; kinds follow the slot's parity."""
        slot = self.raw("nation").select(F.col("n_nationkey").alias("package_slot"))
        ring = slot.filter("package_slot % 3 <> 0").select("package_slot", ((7 * F.col("package_slot") + 3) % 25).alias("dep_slot"))
        half = slot.filter("package_slot % 4 = 1").select("package_slot", F.floor(F.col("package_slot") / 2).cast("int").alias("dep_slot"))
        even = F.col("package_slot") % 2 == 0
        return ring.union(half).distinct().withColumns({"is_normal": even | (F.col("package_slot") % 3 == 1), "is_build": ~even, "is_dev": F.col("package_slot") % 5 == 0})

    def modules(self) -> DataFrame:
        """module_id, parent_id, name, package_slot: region > nation > customer and supplier."""
        key = F.col
        region = self.raw("region").select(key("r_regionkey").cast("long").alias("module_id"), F.lit(None).cast("long").alias("parent_id"), key("r_name").alias("name"), F.lit(-1).alias("package_slot"))
        nation = self.raw("nation").select((key("n_nationkey") + NATION).cast("long").alias("module_id"), key("n_regionkey").cast("long").alias("parent_id"), key("n_name").alias("name"), key("n_nationkey").alias("package_slot"))
        customer = self.raw("customer").select((key("c_custkey") + CUSTOMER).alias("module_id"), (key("c_nationkey") + NATION).cast("long").alias("parent_id"), key("c_name").alias("name"), key("c_nationkey").alias("package_slot"))
        supplier = self.raw("supplier").select((key("s_suppkey") + SUPPLIER).alias("module_id"), (key("s_nationkey") + NATION).cast("long").alias("parent_id"), key("s_name").alias("name"), key("s_nationkey").alias("package_slot"))
        return region.unionByName(nation).unionByName(customer).unionByName(supplier)

    def defs(self) -> DataFrame:
        """def_id, name, kind, container, package_slot, start of every kind of definition."""
        part = self.raw("part").select(F.col("p_partkey").alias("def_id"), F.col("p_name").alias("name"), F.lit("struct").alias("kind"), F.col("p_brand").alias("container"), (F.col("p_size") % 25).alias("package_slot"), F.lit(0).cast("long").alias("start"))
        nations = self.raw("nation").select("n_nationkey", "n_name")
        customer = self.raw("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("def_id"), F.col("c_name").alias("name"), F.lit("function").alias("kind"), F.col("n_name").alias("container"), F.col("c_nationkey").alias("package_slot"), (F.col("c_custkey") % 97).alias("start"))
        supplier = self.raw("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("def_id"), F.col("s_name").alias("name"), F.lit("trait").alias("kind"), F.col("n_name").alias("container"), F.col("s_nationkey").alias("package_slot"), (F.col("s_suppkey") % 97).alias("start"))
        nation = self.raw("nation").select(F.col("n_nationkey").cast("long").alias("def_id"), F.col("n_name").alias("name"), F.lit("module").alias("kind"), F.lit(None).cast("string").alias("container"), F.col("n_nationkey").alias("package_slot"), F.lit(0).cast("long").alias("start"))
        return part.unionByName(customer).unionByName(supplier).unionByName(nation)

    def impls(self) -> DataFrame:
        """self_type (part), trait (supplier); the trait is null, an inherent implementation, where both keys are even."""
        inherent = (F.col("l_partkey") % 2 == 0) & (F.col("l_suppkey") % 2 == 0)
        return self.raw("lineitem").select("l_partkey", "l_suppkey").distinct().select(F.col("l_partkey").alias("self_type"), F.when(~inherent, F.col("l_suppkey")).alias("trait"), F.col("l_suppkey").alias("impl_id"))

    def fields(self) -> DataFrame:
        """type_id, ordinal, name, ty: four fields of every part."""
        names = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("name"), F.lit(t).alias("ty")) for i, (n, t) in enumerate((("brand", "str"), ("type", "str"), ("size", "i32"), ("price", "f64")))])
        return self.raw("part").select(F.col("p_partkey").alias("type_id"), F.explode(names).alias("f")).select("type_id", "f.*")

    def sites(self) -> DataFrame:
        """Reference sites: package_slot, file_id (order), span, entity (part); returned items are declarations."""
        return self.raw("lineitem").select(
            (F.col("l_suppkey") % 25).cast("int").alias("package_slot"), F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") * 100).cast("long").alias("span_start"),
            (F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")).cast("long").alias("span_end"), F.col("l_partkey").alias("entity_id"),
            (F.col("l_returnflag") == "R").alias("is_declaration"), F.col("l_linenumber").alias("scan_order"),
        )

    def files(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("file_id"), "text", F.col("source").alias("package"))

    def document_events(self) -> DataFrame:
        """path, version, op, ts of editor events."""
        op = F.create_map(*[F.lit(x) for pair in (("view", "open"), ("click", "change"), ("purchase", "save"), ("signup", "close"), ("error", "failed_save")) for x in pair])
        return self.raw("events").select(F.col("user_id").alias("path"), F.col("event_id").alias("version"), op[F.col("event_type")].alias("op"), "ts", "value")
