"""Package artifacts as partitioned Parquet (A.9-A.12, M.1-M.3, M.6-M.9): one folder a table, laid out by revision and package.

A revision is never written twice, so a reader of one revision sees one state. What a revision does not hold any more is
reported, and rebuilt by the caller; Spark manages memory, so residency plans have no counterpart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Goes up when a table's columns change; rows of other versions are not read.
SCHEMA_VERSION = 1


class ArtifactStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, name: str, rows: DataFrame, revision: str) -> None:
        """A.10: rows (package_slot and more) as one revision of a table; a partition a package, dealt by package first."""
        tagged = rows.withColumns({"revision": F.lit(revision), "schema_version": F.lit(SCHEMA_VERSION)})
        tagged.repartition("package_slot").write.mode("append").partitionBy("revision", "package_slot").parquet(f"{self.folder}/{name}")

    def read(self, name: str, revision: str, packages: DataFrame | None = None) -> DataFrame:
        """A.9, M.1, M.3: a revision's rows of the asked packages; both prune partitions, other schema versions are left out."""
        path = f"{self.folder}/{name}"
        schema = self.spark.read.option("mergeSchema", False).parquet(path).schema
        some = self.spark.read.schema(schema).parquet(path).filter((F.col("revision") == revision) & (F.col("schema_version") == SCHEMA_VERSION)).drop("revision", "schema_version")
        return some if packages is None else some.join(packages.select("package_slot"), "package_slot", "left_semi")

    def missing(self, name: str, revision: str, packages: DataFrame) -> DataFrame:
        """M.8: asked packages that the revision has no artifact of, for a rebuild from source."""
        return packages.select("package_slot").join(self.read(name, revision).select("package_slot").distinct(), "package_slot", "left_anti")

    def carried_over(self, name: str, old: str, new: str, changed: DataFrame) -> DataFrame:
        """L.12, M.4: the old revision's rows of all packages but the changed ones, to be written beside the rebuilt ones."""
        return self.read(name, old).join(changed.select("package_slot"), "package_slot", "left_anti")

    def clean(self, keep: list[str]) -> list[str]:
        """A.12: delete revisions that are not kept; returns their folders."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs, gone = root.getFileSystem(conf), []
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/*/revision=*")):
            path = status.getPath()
            if path.getName().split("=", 1)[1] not in keep:
                fs.delete(path, True)
                gone.append(path.toString())
        return gone
