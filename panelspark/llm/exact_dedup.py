"""Exact deduplication by content sort, with DataFrame functions only.

Sampled splitters range-partition the normalised texts, Spark's external sort places equal
texts next to each other, and each text is compared in full with its neighbour. The sort key
is (first 256 characters, SHA-256, whole text, identifier), so a splitter stays small and a
huge group of copies is cut into several buckets by its identifiers; groups that run over a
bucket's edge are joined afterwards from at most two rows a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, sampled_splitters, shuffle_width, staged

PREFIX_CHARS = 256
BUCKETS_PER_PARTITION = 4


def normalised(text: Column) -> Column:
    """Runs of space, tab, LF, VT, FF and CR become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _sorted_runs(docs: DataFrame, identifier: Column, text: Column, buckets: int | None) -> DataFrame:
    """docs with _norm, _sha, _bucket, _first (starts its run) and _run (number of its run in the bucket)."""
    norm = normalised(text)
    id_type = docs.select(identifier.alias("i")).schema["i"].dataType.simpleString()
    keyed = docs.select("*", F.struct(F.substring(norm, 1, PREFIX_CHARS).alias("p"), F.sha2(norm, 256).alias("s"), identifier.alias("i")).alias("_key"))
    parts = buckets or BUCKETS_PER_PARTITION * shuffle_width(docs.sparkSession)
    cuts = sampled_splitters(keyed.select(F.col("_key.p").alias("p"), F.col("_key.s").alias("s"), F.col("_key.i").alias("i")), ["p", "s", "i"], parts)
    dealt = keyed.withColumn("_bucket", bucket_of(F.col("_key"), f"struct<p:string,s:string,i:{id_type}>", cuts)).drop("_key").repartition("_bucket")
    order = Window.partitionBy("_bucket").orderBy("_p", "_sha", "_norm", identifier)
    return (
        dealt.withColumn("_norm", norm)
        .withColumns({"_p": F.substring("_norm", 1, PREFIX_CHARS), "_sha": F.sha2("_norm", 256)})
        .withColumn("_first", ~F.col("_norm").eqNullSafe(F.lag("_norm").over(order)))
        .withColumn("_run", F.sum(F.col("_first").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_p")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Decision for every row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their normalised forms are identical; null counts as empty. The row with
    the smallest identifier stays (a null identifier is the smallest); of rows repeated with the
    same identifier exactly one stays. An empty table gives an empty result; other columns are
    ignored, so their names cannot clash.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    runs = _sorted_runs(rows, F.col("doc_id"), F.col("text"), buckets)
    run = Window.partitionBy("_bucket", "_run")
    whole = Window.partitionBy("_bucket")
    narrow = staged(
        runs.withColumn("_last", F.max("_run").over(whole))
        .withColumn("_edge", F.when(F.col("_first") & ((F.col("_run") == 1) | (F.col("_run") == F.col("_last"))), F.col("_norm")))
        .select("doc_id", "_bucket", "_run", "_sha", "_first", "_edge")
        .withColumns({"_keep": F.min(F.struct(F.col("doc_id").alias("i"))).over(run)["i"], "_size": F.count("*").over(run)})
    )
    edges = narrow.where(F.col("_edge").isNotNull())
    joined = edges.groupBy("_edge").agg(F.min_by("_keep", "_bucket").alias("_all_keep"), F.sum("_size").alias("_all_size"), F.min("_bucket").alias("_from"), F.collect_list(F.struct("_bucket", "_run")).alias("_at")).where(F.size("_at") > 1)
    # At most two rows a bucket, so the broadcast is bounded by the number of buckets.
    fix = joined.select("_all_keep", "_all_size", "_from", F.explode("_at").alias("_at")).select("_all_keep", "_all_size", "_from", "_at.*")
    out = narrow.join(F.broadcast(fix), ["_bucket", "_run"], "left")
    spans = F.col("_from").isNotNull()
    return out.select(
        "doc_id",
        F.when(spans, F.col("_all_keep")).otherwise(F.col("_keep")).alias("keep_id"),
        F.when(spans, F.col("_all_size")).otherwise(F.col("_size")).alias("group_size"),
        (F.col("_first") & (~spans | (F.col("_bucket") == F.col("_from")))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """docs without later copies, all columns as they were (same rules as exact_dedup).

    The row travels as one struct, so no column's name can clash with those used here.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    last = F.max("_run").over(Window.partitionBy("_bucket"))
    runs = _sorted_runs(row, F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`"), buckets).withColumn("_last", last).where("_first")
    # Only the first and the last surviving text of each bucket can meet a copy in another bucket.
    edge = F.when((F.col("_run") == 1) | (F.col("_run") == F.col("_last")), F.col("_norm"))
    firsts = staged(runs.withColumn("_edge", edge).select("row", "_bucket", "_run", "_edge"))
    meets = firsts.where(F.col("_edge").isNotNull()).groupBy("_edge").agg(F.min("_bucket").alias("_from"), F.collect_list(F.struct("_bucket", "_run")).alias("_at")).where(F.size("_at") > 1)
    later = meets.select("_from", F.explode("_at").alias("_at")).select("_from", "_at.*").where(F.col("_bucket") > F.col("_from")).select("_bucket", "_run")
    return firsts.join(F.broadcast(later), ["_bucket", "_run"], "left_anti").select("row.*")
