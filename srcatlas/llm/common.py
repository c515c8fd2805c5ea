"""Shared helpers: the shared folder, written intermediate tables, worker paths, nullable ids, bit filters, free names."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside an operator: it sorts before every other id and is null again in the result. So this one id
#: is no id of its own: rows that carry it count as rows without an id.
NULL_ID = -(2**63)


#: Texts travel to Python in batches of about this size; Spark's own limit is 64 MB.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver's folder exists on the workers too, and bound Arrow batches.

    On a cluster without such a folder, ship the package with --py-files as usual. A batch limit that the session sets
    below BATCH_BYTES stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def give_back() -> None:
    """Return memory that a Python worker has freed but still holds; workers outlive tasks and stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new local one only where it is unset and all tasks
    run in this process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="srcatlas-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    The files outlive lost executors; each call writes to a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the folders that written() made for df, once nothing reads them any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    base = shared_dir(df.sparkSession).split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if base in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def known_id(col: str = "doc_id") -> Column:
    """A column of ids with NULL_ID for null."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def shown_id(col: str) -> Column:
    """The reverse of known_id."""
    return F.when(F.col(col) != F.lit(NULL_ID), F.col(col))


def known_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever case its columns are in."""
    taken = {c.lower() for c in df.columns}
    tail = "_"
    while any(f"{n}{tail}".lower() in taken for n in names):
        tail += "_"
    return [f"{n}{tail}" for n in names]


#: Least and most bits of a bit filter; 16 for each row between them.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def maybe_in(key: Column, found: DataFrame, found_key: Column) -> Column:
    """A column that is false only where no row of found has the key (a long).

    The filter has 16 bits for each row of found, at most 16 MB, and passes through the driver; beyond that more rows are
    true, so it only saves work. What is true has to be joined.
    """
    bits = LEAST_BITS
    rows = found.count()
    while bits < min(MOST_BITS, 16 * rows):
        bits *= 2
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = found.select(slot(found_key).alias("s")).groupBy(F.shiftright("s", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("s").bitwiseAND(32767)).alias("bits"))
    table = np.zeros((bits >> 15, 4096), np.uint8)
    for k, blob in marks.toLocalIterator():
        table[k] = np.frombuffer(blob, np.uint8)
    shared = found.sparkSession.sparkContext.broadcast(table.ravel())

    def seen(column: pa.Array) -> pa.Array:
        s = column.to_numpy()
        return pa.array(shared.value[s >> 3] >> (s & 7).astype(np.uint8) & 1 == 1)

    return F.arrow_udf(seen, "boolean")(slot(key))
