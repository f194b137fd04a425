"""Helpers that several corpus operators share: staged tables, sampled splitters, counted offsets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. A folder of our own only in local mode (tests), where
    all tasks see it; on a cluster without that setting this is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared checkpoint folder and read it back: lineage ends here."""
    path = f"{checkpoint_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """For small frames of iterative jobs: reliable checkpoint, removed once nothing refers to it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled(df: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About `rows` rows of df (all, if it has no more), whatever its size: what comes to the driver stays bounded."""
    total = df.count()
    return df if total <= rows else df.sample(fraction=min(1.0, 1.1 * rows / total), seed=seed)


def cuts_of(sample: list[tuple], parts: int) -> list[list]:
    """At most parts - 1 ascending key tuples that cut the sample into runs of about equal size."""
    order = lambda row: tuple((v is not None, v) for v in row)  # nulls first, as Spark sorts
    rows = sorted(sample, key=order)
    cuts = [rows[len(rows) * i // parts] for i in range(1, parts)] if rows else []
    return [list(r) for r in sorted(set(cuts), key=order)]


def sampled_splitters(df: DataFrame, keys: list[str], parts: int, per_part: int = 32) -> list[list]:
    """Key tuples that cut df into at most `parts` runs of about equal size.

    Only a sample of about parts * per_part key tuples comes to the driver, whatever the size of df.
    """
    return cuts_of([tuple(r) for r in sampled(df.select(*keys), parts * per_part).collect()], parts) if parts > 1 else []


def _literal(value: object, kind: str) -> str:
    """SQL text of a constant; strings as bytes, so that nothing in them needs quoting."""
    if value is None:
        return f"CAST(NULL AS {kind})"
    if kind == "string":
        return f"decode(X'{str(value).encode().hex()}', 'UTF-8')"
    return f"CAST('{value}' AS {kind})"


def bucket_of(key: Column, key_type: str, splitters: list[list]) -> Column:
    """How many splitters are <= key (a struct of type key_type), by binary search inside the expression.

    The key is bound by an outer transform: named in the search itself, it would be computed anew at each step.
    """
    if not splitters:
        return F.lit(0)
    fields = [f.split(":") for f in key_type.removeprefix("struct<").removesuffix(">").split(",")]
    rows = (", ".join(f"'{name}', {_literal(v, kind)}" for (name, kind), v in zip(fields, s, strict=True)) for s in splitters)
    cuts = F.expr(f"array({', '.join(f'named_struct({r})' for r in rows)})")  # the optimizer folds it into one constant
    steps = len(splitters).bit_length()

    def halve(wanted: Column, state: Column) -> Column:
        lo, hi = state["lo"], state["hi"]
        mid = F.shiftright(lo + hi, 1)
        return (
            F.when(lo >= hi, state)
            .when(F.get(cuts, mid) <= wanted, F.struct((mid + 1).alias("lo"), hi.alias("hi")))
            .otherwise(F.struct(lo.alias("lo"), mid.alias("hi")))
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))
    rounds = F.sequence(F.lit(1), F.lit(steps))
    return F.get(F.transform(F.array(key), lambda k: F.aggregate(rounds, start, lambda state, _: halve(k, state))["lo"]), 0)


def thinned(df: DataFrame, rows: int, id_col: str = "doc_id") -> DataFrame:
    """df cut by a hash of its identifier to about four times `rows` rows, before an exact limit: what each task then
    sends for the limit does not grow with the table. The rows with the smallest hashes are all in."""
    total = df.count()
    if total <= 4 * rows:
        return df
    cut = int(-(1 << 63) + (1 << 64) * (4 * rows / total))
    return df.where(F.xxhash64(id_col) <= F.lit(min(cut, (1 << 63) - 1)))


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, total: int, most: int = 1000) -> DataFrame:
    """Inner join of rows with lookup (one row per key, n = how many rows it has), no key's rows in one task.

    Keys with over 1 / `most` of the `total` rows, fewer than `most` of them, are broadcast; rows of all other keys, none
    of them crowded, are shuffled. rows is read twice, so it should be a stored table.
    """
    crowded = F.col("n") * most > total
    few = lookup.where(crowded).drop("n")
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(lookup.where(~crowded).drop("n"), key)
    return rows.join(F.broadcast(few), key).unionByName(rest)
