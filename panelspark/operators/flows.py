"""Investor flows, holders, brokers and market breadth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INVESTORS = ("foreign_buy", "sitc_buy", "dealer_buy")


def recent_dates(df: DataFrame, n: int, asof: str | None = None, col: str = "date", offset: int = 0) -> DataFrame:
    """The newest n distinct dates up to asof, after skipping `offset` of them."""
    dates = df.select(col).distinct()
    if asof:
        dates = dates.where(F.col(col) <= F.lit(asof).cast("date"))
    return dates.orderBy(F.desc(col)).offset(offset).limit(n)


def two_sided(df: DataFrame, value: str, limit: int, key: str = "stock_id") -> DataFrame:
    """Largest positive and smallest negative values, tagged, each in order (top-k without a full sort)."""
    buy = df.where(F.col(value) > 0).orderBy(F.desc(value), key).limit(limit).withColumn("side", F.lit("buy"))
    return buy.unionByName(df.where(F.col(value) < 0).orderBy(F.asc(value), key).limit(limit).withColumn("side", F.lit("sell")))


def flow_ranking(flows: DataFrame, stocks: DataFrame, prices: DataFrame, col: str, days: int = 5, asof: str | None = None, market: str | None = None, limit: int = 50) -> DataFrame:
    """Net flow per instrument over the last dates, both ways, with the last close."""
    rows = flows.join(F.broadcast(recent_dates(flows, days, asof)), "date", "left_semi")  # `days` dates
    names = stocks if market is None else stocks.where(F.col("market") == market)
    summed = rows.groupBy("stock_id").agg(F.sum(col).alias("net")).join(names.select("stock_id", "name", "market"), "stock_id")
    last = prices.groupBy("stock_id").agg(F.max_by("close_price", "date").alias("last_close"))
    return two_sided(summed, "net", limit).join(last, "stock_id", "left")


def flow_totals(flows: DataFrame, stocks: DataFrame, days: int = 20) -> DataFrame:
    """Daily totals per market of the newest dates."""
    rows = flows.join(F.broadcast(recent_dates(flows, days)), "date", "left_semi").join(stocks.select("stock_id", "market"), "stock_id")
    return rows.groupBy("date", "market").agg(*[F.sum(c).alias(c) for c in (*INVESTORS, "total_buy")])


def inst_cost_vwap(prices: DataFrame, flows: DataFrame, days: int = 20) -> DataFrame:
    """Average mid price each investor class bought at, over its buying days of the last bars."""
    newest = Window.partitionBy("stock_id").orderBy(F.desc("date"))
    recent = prices.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= days)
    rows = recent.join(flows, ["stock_id", "date"]).withColumn("mid", (F.col("high_price") + F.col("low_price")) / 2)
    long = rows.unpivot(["stock_id", "mid"], list(INVESTORS), "investor", "net").where("net > 0")
    return long.groupBy("stock_id", "investor").agg(F.round(F.sum(F.col("mid") * F.col("net")) / F.sum("net"), 6).alias("cost"), F.count("*").alias("days_buying"))


def flow_totals_per_stock(flows: DataFrame, rows: int = 20) -> DataFrame:
    newest = Window.partitionBy("stock_id").orderBy(F.desc("date"))
    return flows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= rows).groupBy("stock_id").agg(*[F.sum(c).alias(c) for c in INVESTORS])


def enrich_dates(flows: DataFrame) -> DataFrame:
    """Date parts (Monday is 0) and the investor with the largest absolute net; ties go to foreign, then trust, then dealer."""
    f, s, d = (F.abs(c) for c in INVESTORS)
    most = F.greatest(f, s, d)
    return flows.withColumns({"year": F.year("date"), "month": F.month("date"), "quarter": F.quarter("date"), "weekday": F.weekday("date"), "dominant": F.when(f == most, "foreign").when(s == most, "sitc").otherwise("dealer")})


def coverage_pivot(flows: DataFrame, stocks: DataFrame) -> DataFrame:
    """Distinct dates and instruments per year and market, 0 where there are none."""
    rows = flows.join(stocks.select("stock_id", "market"), "stock_id").withColumn("year", F.year("date"))
    return rows.groupBy("year").pivot("market", ["tpex", "twse"]).agg(F.countDistinct("date").alias("days"), F.countDistinct("stock_id").alias("stocks")).na.fill(0)


def stocks_index(flows: DataFrame, stocks: DataFrame) -> DataFrame:
    per = flows.groupBy("stock_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("date").alias("days"), *[F.sum(c).alias(c) for c in INVESTORS])
    return per.join(stocks.select("stock_id", "name", "market"), "stock_id")


def trading_calendar(flows: DataFrame, stocks: DataFrame) -> DataFrame:
    rows = flows.join(stocks.select("stock_id", "market"), "stock_id")
    return rows.groupBy("date").agg(F.count_if(F.col("market") == "twse").alias("twse_rows"), F.count_if(F.col("market") == "tpex").alias("tpex_rows")).withColumns({"year": F.year("date"), "month": F.month("date"), "weekday": F.weekday("date")})


def quality_extremes(flows: DataFrame, k: int = 5) -> DataFrame:
    """Rows with the k largest absolute values of each measure."""
    long = flows.unpivot(["stock_id", "date"], list(INVESTORS), "measure", "value")
    order = Window.partitionBy("measure").orderBy(F.desc(F.abs("value")), "stock_id", "date")
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rollup_profile(flows: DataFrame, stocks: DataFrame) -> DataFrame:
    rows = flows.join(stocks.select("stock_id", "market"), "stock_id").withColumn("year", F.year("date"))
    return rows.rollup("market", "year").agg(F.count("*").alias("n"), F.countDistinct("stock_id").alias("stocks"), F.sum("total_buy").alias("total_buy"), F.grouping_id().cast("int").alias("level"))


def dataset_profile(df: DataFrame, by: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Rows, first and last date, distinct dates and instruments; approximate counts keep the state small on big tables."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), distinct("date").alias("days"), distinct("stock_id").alias("stocks"))


def clean_flows(flows: DataFrame) -> DataFrame:
    """Audit of a flow table: identifiers, total formula, duplicates, nulls, all-zero rows."""
    wrong = F.col("total_buy") != sum((F.col(c) for c in INVESTORS[1:]), F.col(INVESTORS[0]))
    per = flows.groupBy("stock_id", "date").agg(
        F.count("*").alias("_n"), F.count_if(wrong).alias("_w"), F.count_if(F.col("total_buy").isNull()).alias("_u"), F.count_if(~F.col("stock_id").rlike(r"^\d{1,4}$")).alias("_i"), F.count_if((F.col("foreign_buy") == 0) & (F.col("sitc_buy") == 0) & (F.col("dealer_buy") == 0)).alias("_z")
    )
    return per.agg(F.sum("_n").alias("n"), F.sum("_w").alias("formula_errors"), F.sum(F.col("_n") - 1).alias("duplicates"), F.sum("_u").alias("nulls"), F.sum("_i").alias("bad_ids"), F.sum("_z").alias("all_zero"))


def export_flow_package(flows: DataFrame, stocks: DataFrame) -> DataFrame:
    """Named flows without unknown instruments and all-zero rows, as int32."""
    rows = flows.join(stocks.select("stock_id", "name", "market"), "stock_id", "left").dropna(subset=["name"])
    rows = rows.where("foreign_buy <> 0 OR sitc_buy <> 0 OR dealer_buy <> 0")
    return rows.select("date", "market", "stock_id", "name", *[F.col(c).cast("int").alias(c) for c in (*INVESTORS, "total_buy")])


def concentration(holders: DataFrame, weeks: int = 52) -> DataFrame:
    """Shares of the four holder groups per snapshot, with total holders from the total row, newest snapshots only."""
    band = lambda lo, hi: F.round(F.coalesce(F.sum(F.when(F.col("band").between(lo, hi), F.col("pct"))), F.lit(0.0)), 4)
    per = holders.groupBy("stock_id", "sca_date").agg(band(1, 3).alias("retail"), band(4, 10).alias("mid"), band(11, 14).alias("big"), band(15, 15).alias("giant"), F.max(F.when(F.col("band_label").contains("合"), F.col("holders"))).alias("holders"))
    newest = Window.partitionBy("stock_id").orderBy(F.desc("sca_date"))
    return per.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= weeks).drop("_rank")


def both_ends(df: DataFrame, value: str, limit: int, key: str = "stock_id") -> DataFrame:
    """The first and the last `limit` rows of one ranking, whatever their sign, tagged buy and sell; a short ranking is on both sides whole."""
    top = df.orderBy(F.desc(value), key).limit(limit).withColumn("side", F.lit("buy"))
    return top.unionByName(df.orderBy(F.asc(value), F.desc(key)).limit(limit).withColumn("side", F.lit("sell")))


def concentration_change(holders: DataFrame, back: int = 4, limit: int = 50) -> DataFrame:
    """Change of the large holders' share between the latest snapshot date and the one `back` dates before: both ends of the ranking.

    A missing share counts as 0; an instrument without rows on either date is left out.
    """
    now, then = recent_dates(holders, 1, col="sca_date"), recent_dates(holders, 1, col="sca_date", offset=back)
    dates = now.select(F.col("sca_date"), F.lit(1).alias("_now")).unionByName(then.select(F.col("sca_date"), F.lit(0).alias("_now")))
    rows = holders.where(F.col("band").between(11, 15)).join(F.broadcast(dates), "sca_date")  # two dates
    share = lambda on: F.sum(F.when(F.col("_now") == on, F.coalesce("pct", F.lit(0.0))))
    per = rows.groupBy("stock_id").agg(share(1).alias("now"), share(0).alias("then")).dropna()
    return both_ends(per.select("stock_id", F.round("now", 4).alias("pct_now"), F.round("then", 4).alias("pct_then"), F.round(F.col("now") - F.col("then"), 4).alias("delta")), "delta", limit)


def broker_top(broker_trades: DataFrame, k: int = 15) -> DataFrame:
    """Largest net buyers and sellers per instrument and date."""
    rows = broker_trades.where("net_volume <> 0").withColumn("side", F.when(F.col("net_volume") > 0, "buy").otherwise("sell"))
    order = Window.partitionBy("stock_id", "date", "side").orderBy(F.desc(F.abs("net_volume")), "broker_name")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# Breadth ------------------------------------------------------------------------------------

LAYERS = (("layer", 0.4), ("hot", 0.3), ("full", 0.3))


def adr(advancers: Column, decliners: Column) -> Column:
    return F.when(decliners > 0, F.round(advancers / decliners, 3)).when(advancers > 0, 10.0).otherwise(1.0)


def layer_regime(ratio: Column) -> Column:
    """Regime of one layer, by its advance-decline ratio."""
    return F.when(ratio > 2.0, "STRONG_BULL").when(ratio > 1.0, "BULL").when(ratio > 0.8, "NEUTRAL").when(ratio > 0.5, "BEAR").otherwise("CRASH")


def composite_regime(score: Column, bulls: Column, bears: Column) -> Column:
    """Regime of all layers, by their votes and the composite score together."""
    return F.when((bulls == 3) & (score > 0.65), "STRONG_BULL").when((bears == 3) & (score < 0.35), "CRASH").when((bulls >= 2) & (score > 0.55), "BULL").when((bears >= 2) & (score < 0.45), "BEAR").otherwise("NEUTRAL")


def traded(prices: DataFrame) -> DataFrame:
    """Bars that count for breadth: with a close and a volume."""
    return prices.where(F.col("close_price").isNotNull() & (F.col("volume") > 0))


def breadth_layer(rows: DataFrame) -> DataFrame:
    """Breadth of one group of bars per date; a missing change counts as unchanged."""
    chg = F.coalesce("change_pct", F.lit(0.0))
    per = traded(rows).groupBy("date").agg(F.count("*").alias("n"), F.count_if(chg > 0.1).alias("adv"), F.count_if(chg < -0.1).alias("dec"), F.count_if(chg >= 9.5).alias("limit_up"), F.count_if(chg <= -9.5).alias("limit_down"))
    per = per.withColumns({"unchanged": F.col("n") - F.col("adv") - F.col("dec"), "adr": adr(F.col("adv"), F.col("dec"))})
    per = per.withColumn("score", F.round(F.col("adr") / (F.col("adr") + 1), 4))
    return per.withColumn("regime", layer_regime(F.col("adr")))


def breadth_daily(prices: DataFrame, stocks: DataFrame, top: int = 200, hot: int = 100) -> DataFrame:
    """Advance-decline breadth of three layers per date, their regimes, votes and weighted score, in one pass over the panel.

    A missing change counts as unchanged. A layer votes bull over a score of 0.55 and bear under 0.45.
    """
    rows = traded(prices).join(stocks.select("stock_id"), "stock_id").withColumn("chg", F.coalesce("change_pct", F.lit(0.0)))
    value = Window.partitionBy("date").orderBy(F.desc_nulls_last("trade_value"), "stock_id")
    volume = Window.partitionBy("date").orderBy(F.desc_nulls_last("volume"), "stock_id")
    ranked = rows.withColumns({"_v": F.row_number().over(value), "_q": F.row_number().over(volume)})
    member = {"layer": F.col("_v") <= top, "hot": (F.col("_v") <= hot) | (F.col("_q") <= hot), "full": F.lit(True)}
    aggs = []
    for name, _ in LAYERS:
        inside = member[name]
        aggs += [F.count_if(inside & (F.col("chg") > 0.1)).alias(f"{name}_adv"), F.count_if(inside & (F.col("chg") < -0.1)).alias(f"{name}_dec"), F.count_if(inside & (F.col("chg") >= 9.5)).alias(f"{name}_limit_up"), F.count_if(inside & (F.col("chg") <= -9.5)).alias(f"{name}_limit_down")]
    per = ranked.groupBy("date").agg(F.count("*").alias("n"), *aggs)
    per = per.withColumns({f"{n}_adr": adr(F.col(f"{n}_adv"), F.col(f"{n}_dec")) for n, _ in LAYERS})
    per = per.withColumns({f"{n}_score": F.round(F.col(f"{n}_adr") / (F.col(f"{n}_adr") + 1), 4) for n, _ in LAYERS})
    per = per.withColumns({f"{n}_regime": layer_regime(F.col(f"{n}_adr")) for n, _ in LAYERS})
    score = F.round(F.round(sum((F.col(f"{n}_score") * w for n, w in LAYERS[1:]), F.col("layer_score") * LAYERS[0][1]), 8), 4)  # 8 first: sums of products such as 0.50005
    votes = lambda hit: sum((hit(F.col(f"{n}_score")).cast("int") for n, _ in LAYERS[1:]), hit(F.col("layer_score")).cast("int"))
    per = per.withColumns({"score": score, "vote_bull": votes(lambda c: c > 0.55), "vote_bear": votes(lambda c: c < 0.45)})
    return per.withColumn("regime", composite_regime(F.col("score"), F.col("vote_bull"), F.col("vote_bear")))


def breadth_full_market(prices: DataFrame) -> DataFrame:
    """Breadth over all bars, without the dimension; a missing change falls in no bucket."""
    per = prices.groupBy("date").agg(F.count_if(F.col("change_pct") > 0.1).alias("adv"), F.count_if(F.col("change_pct") < -0.1).alias("dec"), F.count_if(F.col("change_pct").between(-0.1, 0.1)).alias("flat"))
    return per.withColumn("adr", adr(F.col("adv"), F.col("dec"))).withColumn("score", F.round(F.col("adr") / (F.col("adr") + 1), 4))


def sector_summary(prices: DataFrame, stocks: DataFrame) -> DataFrame:
    """Newest date per sector: members, average change, up and down."""
    last = prices.agg(F.max("date").alias("date"))
    rows = prices.join(F.broadcast(last), "date").join(stocks.where(F.trim("sector") != ""), "stock_id")
    return rows.groupBy("sector").agg(F.count("*").alias("n"), F.round(F.avg("change_pct"), 2).alias("avg_change"), F.count_if(F.col("change_pct") > 0).alias("up"), F.count_if(F.col("change_pct") < 0).alias("down"))


def heat_map(prices: DataFrame, stocks: DataFrame, k: int = 10) -> DataFrame:
    """Newest date's k largest instruments by volume per sector."""
    last = prices.agg(F.max("date").alias("date"))
    rows = prices.join(F.broadcast(last), "date").join(stocks, "stock_id")
    order = Window.partitionBy("sector").orderBy(F.desc("volume"), "stock_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def limit_anomalies(prices: DataFrame, flows: DataFrame, bound: float = 9.5, days: int = 5, limit: int = 15) -> DataFrame:
    """Newest date's limit-up instruments that foreigners sold, and limit-down ones they bought, over the days before."""
    last = prices.agg(F.max("date").alias("asof"))
    sums = flows.join(F.broadcast(last)).where(F.col("date") >= F.date_sub("asof", days)).groupBy("stock_id").agg(F.sum("foreign_buy").alias("net"))  # one date
    rows = prices.join(F.broadcast(last), prices["date"] == F.col("asof")).join(sums, "stock_id").select("stock_id", "date", "change_pct", "net")
    up = rows.where((F.col("change_pct") >= bound) & (F.col("net") < 0)).orderBy("net", "stock_id").limit(limit).withColumn("kind", F.lit("up_sold"))
    down = rows.where((F.col("change_pct") <= -bound) & (F.col("net") > 0)).orderBy(F.desc("net"), "stock_id").limit(limit).withColumn("kind", F.lit("down_bought"))
    return up.unionByName(down)
