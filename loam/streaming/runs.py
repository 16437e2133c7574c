"""Running a stream over all that is there, into a table of the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import located, scratch_dir

__all__ = ["rocksdb", "run_available", "run_closed", "scratch_dir"]

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which keyed state needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_closed(events: DataFrame, name: str, job: Callable[[DataFrame], DataFrame], end: str = "2200-01-01") -> DataFrame:
    """The result of ``job`` on a stream with event times ``ts`` after all available
    input and after the end of time.

    First the stream is read to its end.  Then the same query runs once more from its
    checkpoint, and all it finds is a row without values at the time ``end``, which moves the
    watermark past every timer.
    """
    spark = events.sparkSession
    marks = f"{scratch_dir(spark)}/{name}-marks"
    types = {f.name: f.dataType for f in events.schema}
    mark = spark.range(1).select(*[(F.lit(end) if n == "ts" else F.lit(None)).cast(t).alias(n) for n, t in types.items()])
    mark.limit(0).write.parquet(marks)
    whole = job(events.unionByName(spark.readStream.schema(mark.schema).parquet(marks)))
    run_available(whole, name)
    mark.write.mode("append").parquet(marks)
    return run_available(whole, name)


def run_available(stream: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """The stream's result after all available input, read back from Parquet.

    With ``keys`` the stream runs in update mode, and of the rows with one key that of the
    last batch counts; else in append mode.  A batch that is run again replaces its rows.
    """
    root = f"{scratch_dir(stream.sparkSession)}/{name}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={epoch}")

    spark = stream.sparkSession
    (
        stream.writeStream.outputMode("update" if keys else "append").foreachBatch(write)
        .option("checkpointLocation", f"{root}-state").trigger(availableNow=True).start().awaitTermination()
    )
    path, fs = located(spark, root)
    if not fs.exists(path):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(root)
    if not keys:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in stream.columns])
