"""Restriction periods: risk scores and event studies around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_join, interval_join
from .technical import risk_features


def is_real_stock(col: str | Column = "stock_id") -> Column:
    """Four characters, the first from 1 to 9."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.length(c) == 4) & c.rlike("^[1-9]")


def active_on(announcements: DataFrame, asof: str) -> DataFrame:
    d = F.lit(asof).cast("date")
    return announcements.where((F.col("period_start") <= d) & (F.col("period_end") >= d))


def phase(start: Column, end: Column, asof: str, recent: int = 7) -> Column:
    d = F.lit(asof).cast("date")
    return F.when((start <= d) & (end >= d), "active").when((end < d) & (end >= F.date_sub(d, recent)), "recent").when(start > d, "pending")


def disposition_risk(prices: DataFrame, stocks: DataFrame, announcements: DataFrame, asof: str, top_n: int = 100) -> DataFrame:
    """Score from 0 to 100 of each instrument's nearness to restriction; those restricted already score 100."""
    rows = prices.where(F.col("date") <= F.lit(asof).cast("date"))
    f = risk_features(rows)
    capped = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    r1, r2 = capped(F.abs("cum_ret") / 32 * 100), capped(F.abs(F.coalesce("change_pct", F.lit(0.0))) / 9.5 * 100)
    ratio = F.coalesce(F.try_divide(F.col("avg_short"), F.col("avg_long")), F.lit(0.0))
    r3, r4 = capped((ratio - 1) / 4 * 100), capped(F.abs("run_sum") / 18 * 100)
    listed = active_on(announcements, asof).select("stock_id", F.lit(1).alias("_listed")).distinct()
    scored = f.withColumns({"r1": r1, "r2": r2, "r3": r3, "r4": r4}).join(listed, "stock_id", "left").join(stocks.select("stock_id", "name"), "stock_id")
    score = F.when(F.col("_listed") == 1, 100.0).otherwise(F.round(F.col("r1") * 0.4 + F.col("r2") * 0.2 + F.col("r3") * 0.2 + F.col("r4") * 0.2, 4))
    signed = lambda c: F.format_string("%+.1f%%", F.round(c, 1))
    hits = F.array_compact(
        F.array(
            F.when(F.col("r1") >= 80, F.concat(F.lit("R1: 6日累積"), signed(F.col("cum_ret")))),
            F.when(F.col("r2") >= 80, F.concat(F.lit("R2: 單日"), signed(F.coalesce("change_pct", F.lit(0.0))))),
            F.when((F.col("r3") >= 60) & (ratio > 0), F.concat(F.lit("R3: 量能"), F.format_string("%.1fx", F.round(ratio, 1)))),
            F.when(F.col("r4") >= 60, F.concat(F.lit("R4: 連3日"), signed(F.col("run_sum")))),
        )
    )
    return scored.withColumn("score", score).withColumn("hits", F.concat_ws(", ", hits)).select("stock_id", "name", "score", "hits", F.coalesce("_listed", F.lit(0)).alias("in_disposition")).orderBy(F.desc("score"), "stock_id").limit(top_n)


def drop_signals(prices: DataFrame, announcements: DataFrame, asof: str, rise: float = 20.0, drop: float = 0.7, before: int = 30, after: int = 5, fresh: int = 7) -> DataFrame:
    """Restricted instruments that had risen by `rise` percent to a peak around the start and then fell to `drop` of it."""
    day = F.lit(asof).cast("date")
    first = announcements.groupBy("stock_id", "period_start").agg(F.min_by(F.struct("announcement_id", "period_end"), F.struct("announce_date", "announcement_id")).alias("a")).select("stock_id", "period_start", "a.*")
    bars = prices.where((F.col("close_price").isNotNull()) & (F.col("date") <= day)).select("stock_id", "date", "close_price")
    ps = F.col("period_start")
    near = interval_join(bars, first, "stock_id", F.date_sub(ps, before), F.greatest(F.date_add(ps, after), F.least(F.col("period_end"), day)))
    peaks = near.where(F.col("date") <= F.date_add(ps, after)).groupBy("stock_id", "period_start", "announcement_id", "period_end").agg(F.max("close_price").alias("peak"), F.min_by("date", F.struct(-F.col("close_price"), "date")).alias("peak_date"))
    based = asof_join(peaks.withColumn("_from", F.date_sub(ps, before)), bars, "stock_id", "_from", "date", ["close_price"])
    based = based.withColumn("rise_pct", F.round(F.try_divide((F.col("peak") - F.col("matched_close_price")) * 100, F.col("matched_close_price")), 2)).where(F.col("rise_pct") >= rise)
    keys = ["stock_id", "period_start"]
    inside = near.where((F.col("date") >= ps) & (F.col("date") <= F.least(F.col("period_end"), day))).select(*keys, "date", "close_price")
    hit = inside.join(based.select(*keys, "peak"), keys).where(F.round(F.col("close_price"), 4) <= F.round(F.col("peak") * drop, 4)).groupBy(*keys).agg(F.min("date").alias("trigger_date"), F.min_by("close_price", "date").alias("trigger_close"))
    now = bars.groupBy("stock_id").agg(F.max_by("close_price", "date").alias("current_close"))
    out = based.join(hit, keys).join(now, "stock_id")
    return out.select(*keys, "announcement_id", "period_end", "peak", "peak_date", F.col("matched_close_price").alias("base_close"), "rise_pct", "trigger_date", "trigger_close", "current_close", (F.datediff(day, F.col("trigger_date")) <= fresh).cast("int").alias("fresh")).orderBy(F.desc("fresh"), F.desc("trigger_date"), "stock_id", "period_start")


def oversold(prices: DataFrame, announcements: DataFrame, asof: str, least: float = 30.0, before: int = 30) -> DataFrame:
    """Newest period per instrument whose close stands at least `least` percent under the peak since before its start."""
    day = F.lit(asof).cast("date")
    newest = announcements.where(F.col("period_start") <= day).groupBy("stock_id").agg(F.max_by(F.struct("announcement_id", "period_start", "period_end"), F.struct("period_start", "announcement_id")).alias("a")).select("stock_id", "a.*")
    bars = prices.where(F.col("close_price").isNotNull()).select("stock_id", "date", "close_price")
    near = interval_join(bars, newest, "stock_id", F.date_sub("period_start", before), day)
    out = near.groupBy("stock_id", "announcement_id", "period_start", "period_end").agg(F.max("close_price").alias("peak"), F.max_by("close_price", "date").alias("close_now"))
    out = out.withColumn("drop_pct", F.round((F.col("close_now") - F.col("peak")) * 100 / F.col("peak"), 2)).where(F.col("drop_pct") <= -least)
    return out.withColumns({"phase": phase(F.col("period_start"), F.col("period_end"), asof), "days_in": F.datediff(day, F.col("period_start")), "days_left": F.datediff(F.col("period_end"), day)})


def breakout_backtest(flags: DataFrame, prices: DataFrame, n: int, hold: int) -> DataFrame:
    """Return of buying each N-day breakout at its close and selling `hold` bars later."""
    later = Window.partitionBy("stock_id").orderBy("date")
    exits = prices.where(F.col("close_price").isNotNull()).select("stock_id", "date", F.lead("close_price", hold).over(later).alias("exit_close"), F.lead("date", hold).over(later).alias("exit_date"))
    rows = flags.where(F.col(f"break_{n}") == 1).select("stock_id", "date", "close_price").join(exits, ["stock_id", "date"]).where("exit_close IS NOT NULL AND close_price > 0")
    return rows.withColumn("ret", F.round((F.col("exit_close") - F.col("close_price")) * 100 / F.col("close_price"), 2))


def backtest_monthly(trades: DataFrame) -> DataFrame:
    return trades.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("trades"), F.round(F.avg("ret"), 4).alias("avg_ret"), F.round(F.avg((F.col("ret") > 0).cast("int")) * 100, 2).alias("win_rate"))
