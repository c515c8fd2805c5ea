"""Readers of real workspaces: metadata JSON, source files, compiler messages (A.1-A.4, A.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = """packages array<struct<id: string, name: string, edition: string, source: string, manifest_path: string,
  targets: array<struct<name: string, kind: array<string>, src_path: string>>,
  dependencies: array<struct<name: string, kind: string, rename: string, path: string>>>>,
  workspace_members array<string>, workspace_root string,
  resolve struct<nodes: array<struct<id: string, deps: array<struct<name: string, pkg: string, dep_kinds: array<struct<kind: string>>>>>>>"""
MESSAGE = """reason string, message struct<message: string, level: string, code: struct<code: string>,
  spans: array<struct<file_name: string, byte_start: long, byte_end: long, line_start: int, is_primary: boolean>>>"""


class Workspace:
    """Tables of one `cargo metadata` document; Spark reads it, so any path that Spark opens will do."""

    def __init__(self, spark: SparkSession, metadata_path: str):
        self.raw = spark.read.schema(METADATA).json(metadata_path, multiLine=True)

    def packages(self) -> DataFrame:
        """A.1, A.2: package_slot (place in the document), id, name, edition, origin, manifest_path, is_workspace_member."""
        p = self.raw.select("workspace_members", F.posexplode("packages").alias("package_slot", "p"))
        member = F.array_contains("workspace_members", F.col("p.id"))
        return p.select("package_slot", F.col("p.id").alias("package_id"), "p.name", "p.edition", F.when(member, "workspace").otherwise("dependency").alias("origin"), "p.source", "p.manifest_path", member.alias("is_workspace_member"))

    def targets(self) -> DataFrame:
        """A.1: package_slot, target_id, name, kind, src_path."""
        p = self.raw.select(F.posexplode("packages").alias("package_slot", "p"))
        kind = F.element_at("t.kind", 1)
        shown = F.when(kind == "custom-build", "build").when(kind.isin("rlib", "dylib", "cdylib", "staticlib", "proc-macro"), "lib").otherwise(kind)
        return p.select("package_slot", F.posexplode("p.targets").alias("target_id", "t")).select("package_slot", "target_id", "t.name", shown.alias("kind"), "t.src_path")

    def dependencies(self) -> DataFrame:
        """A.1: package_slot, dep_slot, name, is_normal, is_build, is_dev; an edge without kinds is normal."""
        node = self.raw.select(F.explode("resolve.nodes").alias("n")).select("n.id", F.explode("n.deps").alias("d"))
        slots = self.packages().select("package_id", "package_slot")
        kinds = F.transform(F.coalesce("d.dep_kinds", F.array()), lambda k: F.coalesce(k["kind"], F.lit("normal")))
        has = lambda k: F.exists(kinds, lambda x: x == k)
        out = node.select("id", F.col("d.pkg").alias("_dep"), F.col("d.name").alias("name"), (has("normal") | (F.size(kinds) == 0)).alias("is_normal"), has("build").alias("is_build"), has("dev").alias("is_dev"))
        out = out.join(slots.withColumnRenamed("package_id", "id"), "id")
        return out.join(slots.select(F.col("package_id").alias("_dep"), F.col("package_slot").alias("dep_slot")), "_dep").select("package_slot", "dep_slot", "name", "is_normal", "is_build", "is_dev")


def with_sysroot(packages: DataFrame, dependencies: DataFrame, sysroot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A.3: packages and edges with the sysroot's crates (package_slot, name): every other package needs each of them."""
    roots = sysroot.select(F.col("package_slot").alias("dep_slot"), F.col("name").alias("dep_name"))
    # A handful of crates by nature: they are counted before they are broadcast.
    if roots.limit(65).count() > 64:
        raise ValueError("a sysroot has a handful of crates")
    edges = packages.select("package_slot").join(F.broadcast(roots)).select("package_slot", "dep_slot", F.col("dep_name").alias("name"), F.lit(True).alias("is_normal"), F.lit(True).alias("is_build"), F.lit(True).alias("is_dev"))
    added = sysroot.select("package_slot", "name", F.lit("sysroot").alias("origin"))
    return packages.select("package_slot", "name", "origin").unionByName(added), dependencies.unionByName(edges)


def source_files(spark: SparkSession, *paths: str) -> DataFrame:
    """A.4: path, text of all .rs files below the paths; file_id is a hash of the path, so it survives new listings."""
    some = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.rs").text(list(paths))
    return some.select(F.xxhash64("_metadata.file_path").alias("file_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def reparsed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """A.5, A.6: files with the text of changed ones (path, text) in place, and was_known: false for changed paths that no
    file has; they get the hash of the path as their id. Several texts of one path: the greatest counts."""
    new = changed.groupBy("path").agg(F.max("text").alias("_new"))
    return files.withColumn("_old", F.lit(True)).join(new, "path", "full").select(
        F.coalesce("file_id", F.xxhash64("path")).alias("file_id"), "path", F.coalesce("_new", "text").alias("text"), F.coalesce("_old", F.lit(False)).alias("was_known")
    )


def owning_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """C.13: files with the package whose root folder is the deepest one above them: an equi-join on ancestor folders."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = files.select("file_id", "path", F.explode(folders).alias("root"))
    roots = packages.select("package_slot", F.regexp_replace("manifest_path", r"/[^/]*$", "").alias("root"))
    return up.join(roots, "root").groupBy("file_id", "path").agg(F.max_by("package_slot", F.length("root")).alias("package_slot"))


def diagnostics(spark: SparkSession, *paths: str) -> DataFrame:
    """A.13: path, message, level, span of compiler messages (one JSON object a line): one per primary span, each once."""
    m = spark.read.schema(MESSAGE).json(list(paths)).filter("reason = 'compiler-message'")
    spans = m.select("message.message", "message.level", F.col("message.code.code").alias("code"), F.explode(F.filter("message.spans", lambda s: s["is_primary"])).alias("s"))
    return spans.select(F.col("s.file_name").alias("path"), "message", "level", "code", F.col("s.byte_start").alias("span_start"), F.col("s.byte_end").alias("span_end")).distinct()


def cargo_config(spark: SparkSession, path: str) -> DataFrame:
    """C.5: atoms and key=value pairs of a compiler's cfg lines."""
    from ..functions.cfg import parse_cfg_line

    return spark.read.text(path).filter(F.trim("value") != "").select(parse_cfg_line(F.col("value")).alias("c")).select("c.*")
