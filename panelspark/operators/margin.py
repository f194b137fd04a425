"""Margin balances: maintenance ratios, market sums and the scan of all instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .technical import complete_date, trim_recent_continuous


def maintenance_ratio(price: Column, cost: Column, rate: float | Column = 0.6) -> Column:
    """Price over the loan on its cost, in percent; null for a missing or non-positive cost."""
    return F.when((cost > 0) & price.isNotNull(), F.round(price / (cost * rate) * 100, 2))


def warning_level(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "na").when(ratio < 130, "danger").when(ratio < 166.67, "warn").otherwise("safe")


def avg_cost(prices: DataFrame, asof: str, n: int = 60) -> DataFrame:
    """Mean of the last n closes up to asof."""
    rows = prices.where((F.col("date") <= F.lit(asof).cast("date")) & F.col("close_price").isNotNull())
    newest = Window.partitionBy("stock_id").orderBy(F.desc("date"))
    return rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).groupBy("stock_id").agg(F.round(F.avg("close_price"), 4).alias("avg_cost"), F.count("*").alias("n"))


def adv(prices: DataFrame, asof: str, n: int = 20, least: int = 10) -> DataFrame:
    """Average volume of the last n trading bars before asof, where there are at least `least`."""
    rows = prices.where((F.col("date") < F.lit(asof).cast("date")) & (F.col("volume") > 0))
    newest = Window.partitionBy("stock_id").orderBy(F.desc("date"))
    return rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).groupBy("stock_id").agg(F.avg("volume").alias("adv"), F.count("*").alias("n")).where(F.col("n") >= least)


def market_adv(prices: DataFrame, universe: DataFrame, n: int = 20) -> DataFrame:
    """Mean over the last n dates of the value traded by the universe: one row."""
    per = prices.join(universe.select("stock_id"), "stock_id", "left_semi").groupBy("date").agg(F.sum("trade_value").alias("value"))
    return per.orderBy(F.desc("date")).limit(n).agg(F.round(F.avg("value"), 4).alias("market_adv"), F.count("*").alias("days"))


def margin_market(margin: DataFrame, prices: DataFrame, stocks: DataFrame) -> DataFrame:
    """Per date: market value of margin positions, utilisation on the main market, short balance and its share."""
    rows = margin.join(prices.select("stock_id", "date", "close_price"), ["stock_id", "date"]).join(stocks.select("stock_id", "market"), "stock_id")
    main = F.col("market") == "twse"
    used = F.sum(F.when(main, F.try_divide(F.col("balance") * F.col("balance"), F.col("limit").cast("double"))))
    return rows.groupBy("date").agg(
        F.round(F.sum(F.col("balance") * F.col("close_price") * 1000) / 1e12, 6).alias("market_value"), F.round(F.try_divide(used, F.sum(F.when(main, F.col("balance")))) * 100, 4).alias("utilisation"), F.round(F.sum("short_balance") / 1e4, 4).alias("short_balance"), F.round(F.try_divide(F.sum("short_balance") * 100.0, F.sum("balance")), 4).alias("short_pct")
    )


def maintenance_distribution(margin: DataFrame, prices: DataFrame, costs: DataFrame, stocks: DataFrame) -> DataFrame:
    """Per date: value over loan in percent, and shares of loans whose ratio is under 140 and 130 percent."""
    rate = F.when(F.col("market") == "twse", 0.6).otherwise(0.5)
    rows = margin.join(prices.select("stock_id", "date", "close_price"), ["stock_id", "date"]).join(costs.select("stock_id", "avg_cost"), "stock_id").join(stocks.select("stock_id", "market"), "stock_id")
    rows = rows.withColumns({"loan": F.col("balance") * F.col("avg_cost") * rate, "value": F.col("balance") * F.col("close_price"), "ratio": F.round(F.try_divide(F.col("close_price"), F.col("avg_cost") * rate), 6)})
    share = lambda x: F.round(F.try_divide(F.sum(F.when(F.col("ratio") < x, F.col("loan")).otherwise(0)) * 100, F.sum("loan")), 4)
    return rows.groupBy("date").agg(F.round(F.try_divide(F.sum("value") * 100, F.sum("loan")), 4).alias("wavg"), share(1.4).alias("under_140"), share(1.3).alias("under_130"))


def margin_usage(margin: DataFrame, stocks: DataFrame, prices: DataFrame, limit: int = 50) -> DataFrame:
    """Newest row per instrument: use of the limit and the change of the balance, most used first."""
    w = Window.partitionBy("stock_id").orderBy("date")
    rows = margin.withColumns({"change": F.col("balance") - F.lag("balance").over(w), "_rank": F.row_number().over(Window.partitionBy("stock_id").orderBy(F.desc("date")))}).where("_rank = 1")
    close = prices.groupBy("stock_id").agg(F.max_by("close_price", "date").alias("close_price"))
    out = rows.join(stocks.select("stock_id", "name", "market"), "stock_id").join(close, "stock_id", "left")
    return out.select("stock_id", "name", "market", "date", "balance", "limit", F.round(F.try_divide(F.col("balance") * 100.0, F.col("limit")), 2).alias("use_rate"), "change", "short_balance", "close_price").orderBy(F.desc("use_rate"), "stock_id").limit(limit)


def margin_scan(prices: DataFrame, stocks: DataFrame, margin: DataFrame, rolled: DataFrame, n: int = 60) -> DataFrame:
    """Maintenance ratio of every instrument with a balance, on the last complete date; cost is the rolled cost, or else
    the average of the last continuous n bars."""
    day = complete_date(prices)
    price = prices.join(F.broadcast(day), "date").select("stock_id", "date", "close_price")  # one date
    latest = margin.groupBy("stock_id").agg(F.max_by("balance", "date").alias("balance")).where((F.col("balance") > 0) & ~F.col("stock_id").startswith("91"))
    rows = latest.join(price, "stock_id").join(rolled.select("stock_id", F.round("cost", 2).alias("rolled")), "stock_id", "left").join(trim_recent_continuous(prices, n).select("stock_id", "avg_close"), "stock_id", "left").join(stocks.select("stock_id", "name"), "stock_id")
    rows = rows.withColumn("cost", F.coalesce("rolled", "avg_close"))
    ratio = maintenance_ratio(F.col("close_price"), F.col("cost"))
    return rows.withColumn("ratio", ratio).withColumn("level", warning_level(F.col("ratio"))).select("stock_id", "name", "date", "close_price", "balance", "cost", "ratio", "level")
