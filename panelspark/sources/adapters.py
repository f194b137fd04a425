"""The supplied tables seen as market tables: instruments, bars, flows, positions and the like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Order of trades within a bar; (l_orderkey, l_linenumber) is not unique.
TRADE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey).select(  # 25 nations
        F.col("s_suppkey").cast("string").alias("stock_id"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 3 == 0, "tpex").otherwise("twse").alias("market"),
        F.col("n_name").alias("sector"),
    )


def week() -> F.Column:
    return F.date_trunc("week", "l_shipdate").cast("date")


def _bars(lineitem: DataFrame, key: F.Column, date: F.Column) -> DataFrame:
    """OHLCV bars per key and date; one shuffle, with partial aggregation before it."""
    px = 100 + 1.2 * (F.col("l_quantity") - 25)
    order = F.struct(*TRADE_ORDER)
    return (
        lineitem.groupBy(key.cast("string").alias("stock_id"), date.alias("date"))
        .agg(
            F.min_by(px, order).alias("open_price"),
            F.max(px).alias("high_price"),
            F.min(px).alias("low_price"),
            F.max_by(px, order).alias("close_price"),
            F.sum("l_quantity").cast("long").alias("volume"),
            F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).cast("long").alias("trade_value")  # exact, whatever the order of summing,
        )
    )


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars per supplier and week, with the change from the previous bar in percent."""
    from panelspark.operators.technical import change_pct

    return change_pct(_bars(table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), week()))


def daily_prices_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars per part and day: a panel with gaps."""
    from panelspark.operators.technical import change_pct

    return change_pct(_bars(table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_shipdate").cast("date")))


def institutional(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    side = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, net).otherwise(0)).cast("long")
    flows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("stock_id"), week().alias("date")).agg(side("R").alias("foreign_buy"), side("A").alias("sitc_buy"), side("N").alias("dealer_buy"))
    return flows.withColumn("total_buy", F.col("foreign_buy") + F.col("sitc_buy") + F.col("dealer_buy"))


def broker_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net trades per supplier, month and the customers' nation."""
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    per = rows.groupBy(F.col("l_suppkey").cast("string").alias("stock_id"), F.trunc("l_shipdate", "month").alias("date"), F.col("n_name").alias("broker_name")).agg(
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0)).cast("long").alias("buy_volume"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0)).cast("long").alias("sell_volume"),
    )
    whole = F.sum(F.col("buy_volume") + F.col("sell_volume")).over(Window.partitionBy("stock_id", "date"))
    return per.withColumn("net_volume", F.col("buy_volume") - F.col("sell_volume")).withColumn("pct", F.round((F.col("buy_volume") + F.col("sell_volume")) * 100.0 / whole, 4))


def holder_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holders and shares per nation, month and band of order size, with a total row per (nation, month)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("string").alias("stock_id"), F.trunc("o_orderdate", "month").alias("sca_date"), F.least(F.lit(15), 1 + F.floor(F.col("o_totalprice") / 35000)).cast("int").alias("band"), "o_custkey", F.round("o_totalprice").cast("long").alias("value")
    )
    per = rows.groupBy("stock_id", "sca_date", "band").agg(F.countDistinct("o_custkey").alias("holders"), F.sum("value").alias("shares"))
    whole = F.sum("shares").over(Window.partitionBy("stock_id", "sca_date"))
    bands = per.select("stock_id", "sca_date", "band", F.concat(F.lit("band "), "band").alias("band_label"), "holders", "shares", F.round(F.col("shares") * 100.0 / whole, 4).alias("pct"))
    total = bands.groupBy("stock_id", "sca_date").agg(F.sum("holders").alias("holders"), F.sum("shares").alias("shares")).select("stock_id", "sca_date", F.lit(17).alias("band"), F.lit("合計").alias("band_label"), "holders", "shares", F.lit(100.0).alias("pct"))
    return bands.unionByName(total)


def disposition_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restriction periods of two weeks, from pending orders."""
    stocks = table(spark, sf_dir, "supplier").agg(F.count("*").alias("k"))
    start = F.col("o_orderdate").cast("date")
    return (
        table(spark, sf_dir, "orders")
        .where("o_orderstatus = 'P'")
        .join(F.broadcast(stocks))  # one row
        .select(F.col("o_orderkey").alias("announcement_id"), (F.col("o_orderkey") % F.col("k")).cast("string").alias("stock_id"), start.alias("announce_date"), start.alias("period_start"), F.date_add(start, 14).alias("period_end"), F.col("o_orderpriority").alias("action"))
    )


def option_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    date = F.trunc("l_shipdate", "month")
    return lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(date.alias("date"), F.col("l_linestatus").alias("contract"), (F.col("p_size") * 100).cast("double").alias("strike"), F.when(F.col("l_returnflag") == "R", "C").otherwise("P").alias("cp")).agg(F.sum("l_quantity").cast("long").alias("oi")).withColumn("expiry", F.last_day("date"))


def futures_large_trader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-5 and top-10 buy and sell positions per month and product, for all traders (0) and for flag A only (1)."""
    lineitem = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("trader_type", F.explode(F.when(F.col("l_returnflag") == "A", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    per = rows.groupBy(F.trunc("l_shipdate", "month").alias("date"), F.col("p_brand").alias("product_code"), "trader_type", "l_suppkey").agg(
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0)).cast("long").alias("b"), F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0)).cast("long").alias("s")
    )
    cell = Window.partitionBy("date", "product_code", "trader_type")
    ranked = per.withColumn("rb", F.row_number().over(cell.orderBy(F.desc("b"), "l_suppkey"))).withColumn("rs", F.row_number().over(cell.orderBy(F.desc("s"), "l_suppkey")))
    top = lambda v, r, n: F.sum(F.when(F.col(r) <= n, F.col(v)).otherwise(0)).alias
    return ranked.groupBy("date", "product_code", "trader_type").agg(top("b", "rb", 5)("top5_buy"), top("s", "rs", 5)("top5_sell"), top("b", "rb", 10)("top10_buy"), top("s", "rs", 10)("top10_sell"), F.sum(F.col("b") + F.col("s")).alias("market_oi"))


def stock_futures_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("p_brand", r"(\d+)", 1)
    mini = number.cast("int") % 2 == 0
    return table(spark, sf_dir, "part").select("p_brand").distinct().select(F.col("p_brand").alias("product_code"), F.floor((number.cast("int") + 1) / 2).cast("string").alias("stock_id"), mini.cast("int").alias("is_mini"), F.when(mini, 0.1).otherwise(2.0).alias("lots_per_contract"))


def margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin buys and balances per supplier and week; the balance is the quantity of the last 12 bars, the limit twice its maximum."""
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("stock_id"), week().alias("date")).agg(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(0)).cast("long").alias("buy"), F.sum("l_quantity").cast("long").alias("q"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0)).cast("long").alias("short_balance"))
    recent = Window.partitionBy("stock_id").orderBy("date").rowsBetween(-11, 0)
    balanced = per.withColumn("balance", F.sum("q").over(recent))
    return balanced.withColumn("limit", 2 * F.max("balance").over(Window.partitionBy("stock_id"))).drop("q")


def macro_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("indicator")).agg(F.round(F.avg("value"), 6).alias("value"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rate series per day, each from one event type, scaled to the range of its thresholds."""
    kind, v = F.col("indicator"), F.col("value")
    name = F.when(kind == "click", "T10Y3M").when(kind == "error", "CP_SPREAD").when(kind == "view", "DOLLAR").when(kind == "purchase", "COR3M").otherwise("MOVE")
    scaled = F.when(kind == "click", v / 5 - 10).when(kind == "error", v / 10 - 4.5).when(kind == "view", v).when(kind == "purchase", v / 2).otherwise(v * 2)
    return macro_indicators(spark, sf_dir).select("date", name.alias("indicator"), F.round(scaled, 4).alias("value"))


def option_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """option_daily with a close, its change from 100 and a volume per strike and side."""
    lineitem = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.trunc("l_shipdate", "month").alias("date"), F.col("l_linestatus").alias("contract"), (F.col("p_size") * 100).cast("double").alias("strike"), F.when(F.col("l_returnflag") == "R", "C").otherwise("P").alias("cp"))
    per = rows.agg(F.round(100 + 1.2 * (F.avg("l_quantity") - 25), 2).alias("close"), F.count("*").alias("volume"), F.sum("l_quantity").cast("long").alias("oi"))
    return per.withColumns({"change": F.round(F.col("close") - 100, 2), "change_pct": F.round(F.col("close") - 100, 2), "expiry": F.last_day("date")})


def intraday_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative volume per user and day; minutes of the day are scaled to a session of 270."""
    return snapshots_of(table(spark, sf_dir, "events"))


def snapshots_of(events: DataFrame) -> DataFrame:
    day = Window.partitionBy("user_id", F.col("ts").cast("date")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select(
        F.col("user_id").cast("string").alias("stock_id"),
        F.col("ts").alias("snapshot_ts"),
        "event_id",
        F.sum(100 * F.round("value")).over(day).cast("long").alias("cum_volume"),
        F.floor((F.hour("ts") * 60 + F.minute("ts")) * 270 / 1440).cast("int").alias("minute"),
        F.col("value").alias("last_price"),
    )
