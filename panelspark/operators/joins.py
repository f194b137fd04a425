"""Joins that SQL engines leave to the user: interval, as-of, n-th later row, aligned calendars, keyed merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, key: str, low: Column, high: Column, at: str = "date") -> DataFrame:
    """Points within [low, high] of intervals with the same key: an equi-join with a range condition, so each key meets only its own."""
    right = intervals.withColumnRenamed(key, "_key")
    return points.join(right, (points[key] == F.col("_key")) & points[at].between(low, high)).drop("_key")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, columns: list[str]) -> DataFrame:
    """Each left row with the columns of the last right row at or before it: one union, one sort per key, no range join."""
    packed = F.struct(F.col(right_at).alias("_right_at"), *columns)
    names = left.columns
    rows = left.select(key, F.col(left_at).alias("_at"), F.lit(1).alias("_left"), F.struct(*names).alias("_row"), F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("_got"))
    rows = rows.unionByName(right.select(key, F.col(right_at).alias("_at"), F.lit(0).alias("_left"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), packed.alias("_got")))
    seen = F.last("_got", ignorenulls=True).over(Window.partitionBy(key).orderBy("_at", "_left").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_seen", seen).where("_left = 1").select("_row.*", F.col("_seen._right_at").alias(f"matched_{right_at}"), *[F.col(f"_seen.{c}").alias(f"matched_{c}") for c in columns])


def nth_later(df: DataFrame, n: int, columns: list[str], key: str = "stock_id", order: str = "date") -> DataFrame:
    """Columns of the n-th later row of the same key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({f"later_{c}": F.lead(c, n).over(w) for c in columns})


def align_calendars(a: DataFrame, b: DataFrame, a_col: str, b_col: str, key: str = "series") -> DataFrame:
    """a's calendar with b's last value at or before each date; dates before b's first value are left out."""
    known = b.where(F.col(b_col).isNotNull()).select(key, "date", b_col)
    got = asof_join(a.select(key, "date", a_col), known, key, "date", "date", [b_col])
    return got.select(key, "date", a_col, F.col(f"matched_{b_col}").alias(b_col)).dropna(subset=[b_col])


def align_both_calendars(a: DataFrame, b: DataFrame, a_col: str, b_col: str, key: str = "series") -> DataFrame:
    """Both series on the union of their dates, carried forward, from where both have begun."""
    rows = a.select(key, "date", a_col).join(b.select(key, "date", b_col), [key, "date"], "full")
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in (a_col, b_col)}).dropna(subset=[a_col, b_col])


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key, without a self-join."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], mode: str = "replace", load: str = "load_ts") -> DataFrame:
    """Keyed merge. replace: the newest row wins whole; update: the updates' columns win, the base's others stay;
    ignore: the first row wins. Both sides carry `load`; repeated keys are resolved within each side first, ties in `load` by
    the other columns, smallest first.
    """
    order = F.asc(load) if mode == "ignore" else F.desc(load)
    first = lambda df: Window.partitionBy(*keys).orderBy(order, *[c for c in sorted(df.columns) if c not in (*keys, load)])
    one = lambda df: df.withColumn("_n", F.row_number().over(first(df))).where("_n = 1").drop("_n")
    if mode != "update":
        return one(base.unionByName(updates, allowMissingColumns=True))
    new = one(updates)
    values = [c for c in new.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_hit"))
    joined = one(base).join(renamed, keys, "full")
    every = [c for c in base.columns if c not in keys] + [c for c in values if c not in base.columns]
    pick = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c) if c in base.columns else None).alias(c) if c in values else F.col(c)
    return joined.select(*keys, *[pick(c) for c in every])


def append_new(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base with those new rows whose keys it does not have."""
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti").select(*base.columns))


def active_instruments(stocks: DataFrame, prices: DataFrame, days: int = 30) -> DataFrame:
    """Instruments with any bar in the last `days` days of the table."""
    last = prices.agg(F.max("date").alias("_last"))
    return stocks.join(prices.join(F.broadcast(last)).where(F.col("date") >= F.date_sub("_last", days)), "stock_id", "left_semi")  # one date


def orphans(facts: DataFrame, stocks: DataFrame, months: int = 6) -> DataFrame:
    """Identifiers of facts that the dimension lacks, recent ones apart from old ones."""
    last = facts.agg(F.max("date").alias("_last"))
    lost = facts.join(stocks.select("stock_id"), "stock_id", "left_anti").groupBy("stock_id").agg(F.max("date").alias("last_date"), F.count("*").alias("n"))
    return lost.join(F.broadcast(last)).withColumn("kind", F.when(F.col("last_date") >= F.add_months("_last", -months), "recent").otherwise("old")).drop("_last")  # one date
