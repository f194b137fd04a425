"""Audits of the panel: anomalies, gaps, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .disposition import is_real_stock
from .technical import adjust_prices, by


def clean_kline(prices: DataFrame, near: int = 30, rows: int = 4, gap: int = 60, repeats: int = 3, span: int = 30) -> DataFrame:
    """Bars to delete, with the reason; each pass sees what the one before left.

    early: before the first bar whose `rows`-th later bar is at most `near` days away; isolated: of at least
    three bars, one more than `gap` days from both neighbours, or the first one so far from the second, but never the last; frozen: the same prices and volume at least `repeats` times
    over `span` days, the newest excepted; bars without volume are exempt.
    """
    w, every = by(), Window.partitionBy("stock_id")
    one = prices.withColumn("_dense", F.when(F.datediff(F.lead("date", rows).over(w), "date") <= near, F.col("date"))).withColumn("_start", F.min("_dense").over(every))
    one = one.withColumn("reason", F.when(F.col("date") < F.col("_start"), "early")).drop("_dense", "_start")
    # What a pass deletes goes on in a window partition of its own, so that the next one does not see it: one chain, one shuffle.
    left = Window.partitionBy("stock_id", "reason")
    near_by = left.orderBy("date")
    gaps = one.withColumns({"_before": F.datediff("date", F.lag("date").over(near_by)), "_after": F.datediff(F.lead("date").over(near_by), "date"), "_all": F.count("*").over(left)})
    lone = F.col("reason").isNull() & (F.coalesce("_before", F.lit(1 << 30)) > gap) & (F.col("_after") > gap) & (F.col("_all") >= 3)
    two = gaps.withColumn("reason", F.when(lone, "isolated").otherwise(F.col("reason"))).drop("_before", "_after", "_all")
    same = Window.partitionBy("stock_id", "_there", "open_price", "high_price", "low_price", "close_price", "volume")
    there = F.col("reason").isNull() & F.coalesce(F.col("volume") > 0, F.lit(False))
    last = two.withColumn("_there", there).withColumns({"_n": F.count("*").over(same), "_first": F.min("date").over(same), "_newest": F.max("date").over(same)})
    frozen = F.col("_there") & (F.col("_n") >= repeats) & (F.datediff("_newest", "_first") >= span) & (F.col("date") < F.col("_newest"))
    return last.withColumn("reason", F.when(frozen, "frozen").otherwise(F.col("reason"))).where("reason IS NOT NULL").select("stock_id", "date", "reason")


def missing_dates(prices: DataFrame, calendar: DataFrame, least: int) -> DataFrame:
    """Calendar dates with no bars or fewer than `least`."""
    counts = prices.groupBy("date").agg(F.count("*").alias("n"))
    return calendar.join(counts, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least).withColumn("kind", F.when(F.col("n") == 0, "missing").otherwise("partial"))


def date_gaps(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar dates within the table's range that it lacks."""
    bounds = df.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    inside = calendar.join(F.broadcast(bounds)).where(F.col("date").between(F.col("_lo"), F.col("_hi"))).select("date")  # one row
    return inside.join(df.select("date").distinct(), "date", "left_anti")


def bar_checks(prices: DataFrame, stocks: DataFrame, flows: DataFrame, max_change: float = 11.0, drift: float = 5.0) -> DataFrame:
    """All counts of the quality report as rows (check, n), from one pass over each table."""
    w = by()
    rows = adjust_prices(prices).withColumns({"_row": F.row_number().over(w), "_prev": F.lag("adj_close").over(w)})
    moved = F.when(F.col("_prev") > 0, F.abs((F.col("adj_close") / F.col("_prev") - 1) * 100 - F.col("change_pct")) > drift)
    counts = rows.agg(
        F.count_if(F.col("close_price").isNull()).alias("q1_null_close"), F.count_if(F.col("close_price") <= 0).alias("q2_close_not_positive"), F.count_if(F.coalesce("volume", F.lit(0)) == 0).alias("q3_no_volume"), F.count_if((F.abs("change_pct") > max_change) & (F.col("_row") > 5) & is_real_stock()).alias("q4_large_change"),
        F.count_if(moved).alias("q5_adjusted_drift"), F.count_if(F.col("adj_close").isNull()).alias("q6_adjusted_missing"), F.count_if(F.col("high_price") < F.col("low_price")).alias("q7_high_under_low"), F.count_if((F.col("volume") == 0) & is_real_stock()).alias("q9_no_volume_real"),
    )
    zero = flows.agg(F.count_if((F.col("foreign_buy") == 0) & (F.col("sitc_buy") == 0) & (F.col("dealer_buy") == 0)).alias("q8_all_zero_flows"))
    twice = stocks.agg((F.count("stock_id") - F.countDistinct("stock_id")).alias("q10_duplicate_ids"))
    lost = prices.select("stock_id").distinct().join(stocks, "stock_id", "left_anti").agg(F.count("*").alias("q11_orphan_bars"))
    last = flows.agg(F.max("date").alias("_last"))
    strange = flows.join(stocks.select("stock_id"), "stock_id", "left_anti").groupBy("stock_id").agg(F.max("date").alias("_d")).join(F.broadcast(last))
    recent = F.col("_d") >= F.add_months("_last", -6)
    kinds = strange.agg(F.count_if(recent).alias("q12_unknown_recent"), F.count_if(~recent).alias("q13_unknown_old"))
    long = lambda df: df.unpivot([], df.columns, "check", "n")
    out = long(counts)
    for df in (zero, twice, lost, kinds):
        out = out.unionByName(long(df))
    severity = F.when(F.col("n") == 0, "ok").when(F.col("check").rlike("^q(2|7|10)_"), "error").otherwise("warn")
    return out.withColumn("severity", severity)


def freshness(tables: dict[str, DataFrame], calendar: DataFrame) -> DataFrame:
    """Per table: rows, range, distinct dates, and by how many calendar dates it lags: ok, warn or error."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("date").alias("days")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    late = calendar.join(F.broadcast(out.select("name", "last_date")), F.col("date") > F.col("last_date")).groupBy("name").agg(F.count("*").alias("lag"))  # one row a table
    return out.join(late, "name", "left").withColumn("lag", F.coalesce("lag", F.lit(0))).withColumn("status", F.when(F.col("lag") <= 1, "ok").when(F.col("lag") <= 3, "warn").otherwise("error"))


def coverage(prices: DataFrame, stocks: DataFrame, dates: int = 10) -> DataFrame:
    """Share of the instruments that have a close, on each of the last dates."""
    last = prices.select("date").distinct().orderBy(F.desc("date")).limit(dates)
    known = stocks.agg(F.count("*").alias("stocks"))
    per = prices.where("close_price IS NOT NULL").join(F.broadcast(last), "date").groupBy("date").agg(F.count("*").alias("n"))
    return per.join(F.broadcast(known)).withColumn("coverage", F.round(F.col("n") * 100.0 / F.col("stocks"), 2))  # one row


def indicator_freshness(macro: DataFrame) -> DataFrame:
    """Per indicator: rows, last date, and by how many days it lags the newest one: ok, warn or error."""
    per = macro.groupBy("indicator").agg(F.count("*").alias("n"), F.max("date").alias("last_date"))
    lag = F.datediff(F.max("last_date").over(Window.partitionBy()), "last_date")  # one row an indicator
    return per.withColumn("lag", lag).withColumn("status", F.when(F.col("lag") <= 1, "ok").when(F.col("lag") <= 3, "warn").otherwise("error"))


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Weekdays from start to end."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")).where(F.weekday("date") < 5)


def date_chunks(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """Consecutive segments of `days` days from start to end."""
    first = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {days} days"))).alias("chunk_start"))
    return first.withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.lit(end).cast("date")))


def with_date_chunk(df: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """Rows dated from start to end, with chunk_start and chunk_end of their segment as date_chunks() numbers them; by arithmetic, without a join."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    begin = F.date_add(first, (F.floor(F.datediff("date", first) / days) * days).cast("int"))
    return df.where(F.col("date").between(first, last)).withColumn("chunk_start", begin).withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), last))
