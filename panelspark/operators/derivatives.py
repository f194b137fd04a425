"""Options and futures positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.exprs import restriction_matching

CHAIN = ("date", "contract")


def _sides(options: DataFrame) -> DataFrame:
    """One row per strike with call and put open interest."""
    side = lambda cp: F.sum(F.when(F.col("cp") == cp, F.col("oi")))
    return options.groupBy(*CHAIN, "strike").agg(side("C").alias("call_oi"), side("P").alias("put_oi"), F.max("expiry").alias("expiry"))


def option_walls(options: DataFrame) -> DataFrame:
    """Strikes of the largest call (resistance) and put (support) interest, ties to the lower strike, 0 for a missing side."""
    s = _sides(options)
    wall = lambda c: F.coalesce(F.max_by("strike", F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.col("strike")))), F.lit(0.0))
    out = s.groupBy(*CHAIN).agg(wall("call_oi").alias("resistance"), wall("put_oi").alias("support"), F.coalesce(F.sum("call_oi"), F.lit(0)).alias("call_total"), F.coalesce(F.sum("put_oi"), F.lit(0)).alias("put_total"), F.max("expiry").alias("expiry"))
    return out.withColumn("pc_ratio", F.when(F.col("call_total") > 0, F.round(F.col("put_total") / F.col("call_total"), 4)).otherwise(0.0))


def max_pain(options: DataFrame) -> DataFrame:
    """Strike at which option holders are paid least, by running sums over the strikes rather than all strike pairs."""
    s = _sides(options).withColumns({"c": F.coalesce("call_oi", F.lit(0)), "p": F.coalesce("put_oi", F.lit(0))})
    chain = Window.partitionBy(*CHAIN).orderBy("strike")
    below, above = chain.rowsBetween(Window.unboundedPreceding, 0), chain.rowsBetween(0, Window.unboundedFollowing)
    k = F.col("strike")
    pain = k * F.sum("c").over(below) - F.sum(F.col("c") * k).over(below) + F.sum(F.col("p") * k).over(above) - k * F.sum("p").over(above)
    return s.withColumn("pain", pain).groupBy(*CHAIN).agg(F.min_by("strike", F.struct("pain", "strike")).alias("max_pain"), F.min("pain").alias("pain"))


def option_chain(options: DataFrame) -> DataFrame:
    """One row per strike with both sides and marks for walls and maximum pain."""
    marks = option_walls(options).select(*CHAIN, "resistance", "support").join(max_pain(options).select(*CHAIN, "max_pain"), list(CHAIN))
    rows = _sides(options).join(marks, list(CHAIN))
    return rows.select(*CHAIN, "strike", "call_oi", "put_oi", *[(F.col("strike") == F.col(m)).cast("int").alias(f"is_{m}") for m in ("resistance", "support", "max_pain")])


def option_table(quotes: DataFrame) -> DataFrame:
    """One row per strike with call and put structs (close, change, change_pct, volume, oi) and the marks of option_chain.

    quotes: date, contract, strike, cp, close, change, change_pct, volume, oi, expiry. A missing side has null prices and zero counts.
    """
    fields = ("close", "change", "change_pct", "volume", "oi")
    side = lambda cp: F.max(F.when(F.col("cp") == cp, F.struct(*fields)))
    rows = quotes.groupBy(*CHAIN, "strike").agg(side("C").alias("c"), side("P").alias("p"))
    shown = lambda s, out: F.struct(*[F.col(f"{s}.{f}").alias(f) if f not in ("volume", "oi") else F.coalesce(f"{s}.{f}", F.lit(0)).alias(f) for f in fields]).alias(out)
    marks = option_chain(quotes).drop("call_oi", "put_oi")
    return rows.select(*CHAIN, "strike", shown("c", "call"), shown("p", "put")).join(marks, [*CHAIN, "strike"])


def default_contract(options: DataFrame) -> DataFrame:
    """Per date the contract with the nearest expiry not before it, else the last one."""
    rows = options.select("date", "contract", "expiry").distinct()
    ahead = F.when(F.col("expiry") >= F.col("date"), F.struct("expiry", "contract"))
    return rows.groupBy("date").agg(F.coalesce(F.min(ahead), F.max(F.struct("expiry", "contract")))["contract"].alias("contract"))


def large_trader_net(positions: DataFrame, contracts: DataFrame, days: int = 20) -> DataFrame:
    """Net position of the large traders who are not institutions, per underlying and date, over its last dates.

    The shares are of the open interest of the largest contract (main_code): of the top five and ten buyers and sellers,
    of the top ten's net, and of the net without institutions; null without open interest.
    """
    pick = lambda c, t: F.max(F.when(F.col("trader_type") == t, F.col(c)))
    held = ("top5_buy", "top5_sell", "top10_buy", "top10_sell", "market_oi")
    per = positions.groupBy("date", "product_code").agg(*[pick(c, 0).alias(f"{c}_0") for c in held], *[pick(c, 1).alias(f"{c}_1") for c in held[2:4]]).where(F.col("top10_buy_0").isNotNull())
    other = lambda c: F.col(f"{c}_0") - F.coalesce(f"{c}_1", F.lit(0))
    rows = per.withColumn("net", other("top10_buy") - other("top10_sell")).join(contracts, "product_code")
    lots = F.col("lots_per_contract")
    order = F.struct(-F.col("is_mini"), F.col("market_oi_0") * lots, F.col("product_code"))
    out = rows.groupBy("stock_id", "date").agg(
        F.round(F.sum(F.col("net") * lots), 1).alias("net_lots"), F.sum(F.when(F.col("is_mini") == 0, F.col("net")).otherwise(0)).alias("main_net"), F.sum(F.when(F.col("is_mini") == 1, F.col("net")).otherwise(0)).alias("mini_net"), F.max_by(F.struct("product_code", "net", *[f"{c}_0" for c in held]), order).alias("m")
    )
    m = lambda c: F.col(f"m.{c}")
    share = lambda v, name: F.when(m("market_oi_0") > 0, F.round(v * 100 / m("market_oi_0"), 2)).alias(name)
    shares = [share(m(f"{c}_0"), f"{c}_pct") for c in held[:4]] + [share(m("top10_buy_0") - m("top10_sell_0"), "net_pct"), share(m("net"), "big_net_pct")]
    out = out.select("stock_id", "date", "net_lots", "main_net", "mini_net", m("product_code").alias("main_code"), m("market_oi_0").alias("market_oi"), *shares)
    newest = Window.partitionBy("stock_id").orderBy(F.desc("date"))
    return out.withColumn("_rank", F.dense_rank().over(newest)).where(F.col("_rank") <= days).drop("_rank")


def futures_oi_net(rows: DataFrame) -> DataFrame:
    """Long minus short interest per date by investor class, found by name, and in total."""
    net = F.col("long_oi") - F.col("short_oi")
    part = lambda word: F.sum(F.when(F.col("investor").contains(word), net).otherwise(0))
    return rows.groupBy("date").agg(part("外資").alias("foreign_net"), part("投信").alias("sitc_net"), part("自營").alias("dealer_net"), F.sum(net).alias("total_net"))


def retail_ratio(institutions: DataFrame, daily: DataFrame) -> DataFrame:
    """Minus the institutions' net over the day session's open interest, in percent; 0 without interest."""
    net = institutions.groupBy("date").agg(F.sum(F.col("long_oi") - F.col("short_oi")).alias("net"))
    oi = daily.where((F.col("session") == "position") & (F.col("oi") > 0)).groupBy("date").agg(F.sum("oi").alias("oi"))
    return net.join(oi, "date", "left").select("date", F.coalesce("oi", F.lit(0)).alias("oi"), F.when(F.col("oi") > 0, F.round(-F.col("net") * 100 / F.col("oi"), 2)).otherwise(0.0).alias("retail_ratio"))


def put_call_ratio(rows: DataFrame) -> DataFrame:
    side = lambda cp: F.sum(F.when(F.col("cp") == cp, F.col("long_oi") + F.col("short_oi")).otherwise(0))
    return rows.groupBy("date").agg(side("P").alias("puts"), side("C").alias("calls")).withColumn("ratio", F.when(F.col("calls") > 0, F.round(F.col("puts") / F.col("calls"), 4)).otherwise(0.0))


def futures_basis(futures: DataFrame, realtime: DataFrame, prices: DataFrame, stocks: DataFrame, restricted: DataFrame) -> DataFrame:
    """Near contract per underlying against its spot (real-time price, else last close), with basis and its sign.

    futures: stock_id, product_code, price, volume; realtime: stock_id, price; restricted: stock_id.
    """
    near = futures.groupBy("stock_id").agg(F.max_by(F.struct("product_code", F.col("price").alias("futures_price"), "volume"), F.struct("volume", "product_code")).alias("c")).select("stock_id", "c.*")
    last = prices.groupBy("stock_id").agg(F.max_by("close_price", "date").alias("last_close"))
    rows = near.join(realtime.select("stock_id", F.col("price").alias("live")), "stock_id", "left").join(last, "stock_id", "left").join(stocks.select("stock_id", "name"), "stock_id", "left").join(restricted.select("stock_id", F.lit(1).alias("_r")).distinct(), "stock_id", "left")
    rows = rows.withColumns({"spot": F.coalesce("live", "last_close"), "spot_stale": F.col("live").isNull().cast("int"), "restricted": F.coalesce("_r", F.lit(0))})
    basis = F.round(F.col("futures_price") - F.col("spot"), 4)
    rows = rows.withColumns({"basis": basis, "basis_pct": F.round(F.try_divide(basis * 100, F.col("spot")), 2)})
    status = F.when(F.col("spot").isNull(), "no_spot").when(F.col("basis") > 0, "contango").when(F.col("basis") < 0, "backwardation").otherwise("flat")
    return rows.withColumn("status", status).select("stock_id", "name", "product_code", "futures_price", "spot", "spot_stale", "basis", "basis_pct", "status", "restricted").orderBy(F.desc_nulls_last("basis_pct"), "stock_id")


def basis_report(futures: DataFrame, realtime: DataFrame, prices: DataFrame, stocks: DataFrame, restricted: DataFrame) -> DataFrame:
    """futures_basis with the restriction in force, its matching interval and label; no basis without a spot above zero.

    restricted: stock_id, period_start, period_end, action; of several the one that began last, then the greatest action.
    """
    one = restricted.groupBy("stock_id").agg(F.max(F.struct("period_start", "action", "period_end")).alias("r")).select("stock_id", "r.*")
    rows = futures_basis(futures, realtime, prices, stocks, one.select("stock_id")).join(one, "stock_id", "left")
    priced = (F.col("spot") != 0) & F.col("futures_price").isNotNull()
    basis = F.when(priced, F.col("futures_price") - F.col("spot"))
    status = F.when(basis > 0, "contango").when(basis < 0, "backwardation").when(basis == 0, "flat").otherwise("no_spot")
    minutes, label = restriction_matching(F.col("action"))
    return rows.select(
        "stock_id", "name", "product_code", "futures_price", "spot", "spot_stale", F.round(F.round(basis, 6), 2).alias("basis"), F.round(F.round(F.try_divide(basis * 100, F.col("spot")), 7), 3).alias("basis_pct"), status.alias("status"), "restricted", "period_start", "period_end", minutes.alias("match_minutes"), label.alias("match_label")
    ).orderBy(F.desc_nulls_last("basis_pct"), "stock_id")


def basis_counts(rows: DataFrame) -> DataFrame:
    """How many rows of basis_report have each status, a restriction, and a live or stale spot: one row."""
    stale = (F.col("spot_stale") == 1) & F.col("spot").isNotNull()
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("contango", "backwardation", "flat", "no_spot")], F.count_if(F.col("restricted") == 1).alias("restricted"), F.count_if(F.col("spot_stale") == 0).alias("spot_realtime"), F.count_if(stale).alias("spot_stale"), F.count("*").alias("total"))


def night_session_spread(rows: DataFrame) -> DataFrame:
    """Close of the busiest contract per session; each night against the same or the latest earlier day session.

    rows: date, session ('day' or 'night'), contract, close, volume. Spread contracts (with '/') and rows without a
    positive close do not count.
    """
    busiest = rows.where(~F.col("contract").contains("/") & (F.col("close") > 0)).groupBy("date", "session").agg(F.max_by("close", F.struct("volume", "contract")).alias("close"))
    both = busiest.groupBy("date").agg(F.max(F.when(F.col("session") == "day", F.col("close"))).alias("day_close"), F.max(F.when(F.col("session") == "night", F.col("close"))).alias("night_close")).withColumn("series", F.lit("all"))
    day = F.last("day_close", ignorenulls=True).over(Window.partitionBy("series").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("base", day).where("night_close IS NOT NULL AND base IS NOT NULL").select("date", "night_close", F.col("base").alias("day_close"), F.round(F.col("night_close") - F.col("base"), 4).alias("spread"), F.round(F.try_divide((F.col("night_close") - F.col("base")) * 100, F.col("base")), 2).alias("spread_pct"))
