"""A stored table played again as a stream: files in the order of arrival, a bounded number of them a micro-batch."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_slices(rows: DataFrame, path: str, number: Column, slices: int, files: int = 4) -> None:
    """Write rows as `slices` successive loads of `files` files each, dealt by number (0 up); the stream reads them in that order.

    A load is written only after the one before it, so file times tell the order. Rows are dealt evenly over the files of
    a load, so a load of at least `files` rows has all of them, and files_per_trigger=files makes it one micro-batch.
    """
    for k in range(slices):
        rows.where(number == k).repartition(files).write.mode("append").parquet(path)


def replayed(spark: SparkSession, path: str, schema: str, files: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


@contextmanager
def rocksdb(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, on disk and with changelog checkpoints, not on the heap."""
    wanted = {"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}
    wanted |= {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_end(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over all that is available and stop; results in a Parquet table at path, which tasks write."""
    query = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_with_restart(df: DataFrame, path: str, checkpoint: str, batches: int = 2, patience: float = 120.0) -> int:
    """Run with a processing-time trigger, stop after some micro-batches, and go on from the checkpoint to the end.

    Gives the number of the first batch after the restart. Whatever the stop cut off is computed again from the state
    and offsets of the checkpoint; the file sink's log keeps each batch once.
    """
    query = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime="100 milliseconds").start()
    began = time.monotonic()
    while query.isActive and (not query.lastProgress or query.lastProgress["batchId"] < batches) and time.monotonic() - began < patience:
        time.sleep(0.05)
    if query.exception():
        raise query.exception()
    seen = query.lastProgress["batchId"] if query.lastProgress else -1
    query.stop()
    query.awaitTermination()
    run_to_end(df, path, checkpoint)
    return seen + 1
