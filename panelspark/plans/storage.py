"""Tables that a query writes in the shared folder, for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a folder of our own only in local mode (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back, for plans that use it several times."""
    path = f"{shared_folder(df.sparkSession)}/stored_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
