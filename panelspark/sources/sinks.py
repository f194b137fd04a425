"""Writers: range-sorted Parquet and CSV, keyed upserts into date partitions, indicator files with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.joins import upsert


def write_sorted(df: DataFrame, path: str, keys: list[str], kind: str = "parquet", partitions: int | None = None) -> None:
    """Files that follow each other in key order: a range partitioning, never one global file."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    writer = ranged.sortWithinPartitions(*keys).write.mode("overwrite")
    if kind == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.option("compression", "snappy").format(kind).save(path)


def upsert_partitions(base_path: str, updates: DataFrame, keys: list[str], partition: str = "date", mode: str = "replace") -> None:
    """Merge updates into a table partitioned by `partition`; only the partitions that they touch are read and rewritten."""
    spark = updates.sparkSession
    touched = updates.select(partition).distinct()
    try:
        old = spark.read.parquet(base_path)
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        merged = updates
    else:
        merged = upsert(old.join(touched, partition, "left_semi"), updates, keys, mode)
    if spark.sparkContext.getCheckpointDir() is None:
        raise ValueError("set a checkpoint folder: the partitions are overwritten that these rows are read from")
    merged = merged.checkpoint()
    merged.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(base_path)


def export_indicator_series(df: DataFrame, path: str) -> DataFrame:
    """One folder of CSV per indicator, each sorted by date; returns the manifest (rows and range per indicator)."""
    df.repartition("indicator").sortWithinPartitions("indicator", "date").write.mode("overwrite").option("header", "true").partitionBy("indicator").csv(path)
    return indicator_manifest(df)


def indicator_manifest(df: DataFrame) -> DataFrame:
    return df.groupBy("indicator").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def ranking_rows(ranking: DataFrame) -> DataFrame:
    """Buy rows before sell rows, each with its direction and rank, as exported."""
    from pyspark.sql import Window

    buy = F.col("side") == "buy"
    order = Window.partitionBy("side").orderBy(F.when(buy, -F.col("net")).otherwise(F.col("net")), "stock_id")
    return ranking.withColumn("direction", F.when(buy, "買超").otherwise("賣超")).withColumn("rank", F.row_number().over(order))
