"""Written intermediates in the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` of the session.  Where that is unset, a
    session of this machine alone gets a temporary folder, and a cluster an error, since
    its executors would not see one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="loam-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is cut,
    and a lost executor costs nothing but the tasks it ran."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


#: bytes that Spark hands a Python task at once, unless the session says less; a longer row is one batch
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the batches that Python tasks get: with whole texts in them, ten
    thousand rows are a lot, on both sides of the pipe."""
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


def located(spark: SparkSession, path: str):
    """A path and the file system that it is on."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Delete written tables from which all that is needed has been written since."""
    for df in tables:
        path, fs = located(df.sparkSession, df.written_to)
        fs.delete(path, True)
