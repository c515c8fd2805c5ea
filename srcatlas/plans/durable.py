"""Written intermediate tables: rounds of a loop cut their lineage here and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Spark broadcasts a side of a join by the size of its files, and those of token tables are a hundredth of their rows: millions of
#: rows would pass through the driver. Tables of more rows than this are joined by shuffles, whatever their files' size.
MOST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a new local folder only where it is unset and all tasks run in this process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="srcatlas-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def durable(df: DataFrame, tag: str = "round") -> DataFrame:
    """df written to the shared folder and read back; of more than MOST_ROWS rows, it asks its joins not to broadcast."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.hint("merge") if seen.get["n"] > MOST_ROWS else out


def forget(df: DataFrame) -> None:
    """Delete the folders that durable() made for df, once nothing reads them any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    base = shared_dir(df.sparkSession).split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if base in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
