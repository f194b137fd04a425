"""Queries of the parsers: payloads and files as their sources send them, built from the supplied tables, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import exprs
from panelspark.sources import adapters, parsers, sinks

from .storage import shared_folder
from .registry import query


def landed(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def grouped(c: str | Column) -> Column:
    """A whole number with commas."""
    return F.format_number((F.col(c) if isinstance(c, str) else c), 0)


def code(c: str = "stock_id") -> Column:
    return F.lpad(c, 4, "0")


def rows_payload(df: DataFrame, key: str, cells: list[Column]) -> DataFrame:
    """One payload per key with all its rows as arrays of text, which is how such pages come."""
    return df.groupBy(key).agg(F.to_json(F.struct(F.collect_list(F.array(*cells)).alias("data"))).alias("payload"))


def html_rows(df: DataFrame, keys: list[str], cells: list[Column]) -> DataFrame:
    """One page per key with a table row for each of its rows."""
    row = F.concat(F.lit("<tr class='r'>"), *[F.concat(F.lit("<td align=right>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    return df.groupBy(*keys).agg(F.concat(F.lit("<table>"), F.concat_ws("\n", F.collect_list(row)), F.lit("</table>")).alias("html"))


@query("s1_read_table", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s1(spark: SparkSession, d: str) -> DataFrame:
    return parsers.read_table(spark, f"{d}/supplier.parquet", "s_suppkey bigint, s_name string, s_acctbal double")


@query(
    "s2_daily_quotes",
    """SELECT lpad(stock_id, 4, '0') AS stock_id, date, open_price, high_price, low_price, close_price, volume, trade_value, CASE WHEN close_price = c THEN 0.0 ELSE round(c / (close_price - c) * 100, 2) END AS change_pct
    FROM (SELECT *, round(close_price - open_price, 2) AS c FROM bars) WHERE length(stock_id) <= 4""",
)
def s2(spark: SparkSession, d: str) -> DataFrame:
    change = F.round(F.col("close_price") - F.col("open_price"), 2)
    sign = F.when(change < 0, "<p style='color:green'>-</p>").otherwise("<p style='color:red'>+</p>")
    cells = [code(), F.lit("name"), grouped(F.col("volume") * 1000 + 999), F.lit("1,234"), grouped("trade_value"), *[text(c) for c in ("open_price", "high_price", "low_price", "close_price")], sign, text(F.abs(change))]
    bars = adapters.daily_prices(spark, d).where(F.length("stock_id") <= 4)
    return parsers.parse_daily_quotes(rows_payload(bars, "date", cells))


@query("s3_institutional", "SELECT lpad(stock_id, 4, '0') AS stock_id, date, foreign_buy, sitc_buy, dealer_buy, total_buy FROM flows WHERE length(stock_id) <= 4")
def s3(spark: SparkSession, d: str) -> DataFrame:
    cells = [code(), F.lit("name"), *[grouped(F.col(c) * 1000 + rest) for c, rest in (("foreign_buy", 0), ("sitc_buy", 1), ("dealer_buy", 999))]]
    flows = adapters.institutional(spark, d).where(F.length("stock_id") <= 4)
    return parsers.parse_institutional(rows_payload(flows, "date", cells), (2, 3, 4))


@query("s4_option_csv", "SELECT date, contract, strike, cp, strike / 100 AS close, CAST(NULL AS DOUBLE) AS settlement, CAST(-5 AS DOUBLE) AS change, CAST(-1.5 AS DOUBLE) AS change_pct, oi * 3 AS volume, oi FROM options")
def s4(spark: SparkSession, d: str) -> DataFrame:
    say = lambda s: F.lit(parsers.big5(s))
    sessions = F.explode(F.array(say("一般"), say("盤後")))
    options = adapters.option_daily(spark, d).withColumn("session", sessions)
    blank = F.lit("")
    cells = {
        "date": F.date_format("date", "yyyy/MM/dd"), "code": F.lit("TXO"), "contract": F.col("contract"), "strike": text("strike"), "cp": F.when(F.col("cp") == "C", say("買權")).otherwise(say("賣權")),
        "open": F.lit("1"), "high": F.lit("2"), "low": F.lit("3"), "close": text(F.col("strike") / 100), "volume": grouped(F.col("oi") * 3), "settlement": F.lit("-"), "oi": text("oi"),
        "bid": blank, "ask": blank, "best_bid": blank, "best_ask": blank, "x1": blank, "session": F.col("session"), "x2": blank, "change": F.lit("-5"), "change_pct": F.lit("-1.5%"),
    }
    path = landed(spark, "options")
    options.select(*[c.alias(n) for n, c in cells.items()]).write.options(header="true", encoding="ISO-8859-1", escape="\0").csv(path)
    return parsers.read_option_csv(spark, path)


@query("s5_large_trader_csv", "SELECT date, product_code, trader_type, top5_buy, top5_sell, top10_buy, top10_sell, market_oi FROM ltrader")
def s5(spark: SparkSession, d: str) -> DataFrame:
    dash = lambda c: F.when(F.col(c) == 0, "-").otherwise(text(c))
    months = F.explode(F.array(F.lit("999999"), F.lit("202604")))
    cells = [F.date_format("date", "yyyy/MM/dd").alias("date"), F.concat("product_code", F.lit("  ")).alias("code"), F.lit(parsers.big5("台積電功許")).alias("name"), months.alias("month"), text("trader_type").alias("type")]
    path = landed(spark, "traders")
    adapters.futures_large_trader(spark, d).select(*cells, *[dash(c).alias(c) for c in ("top5_buy", "top5_sell", "top10_buy", "top10_sell", "market_oi")]).write.options(header="true", encoding="ISO-8859-1", escape="\0").csv(path)
    return parsers.read_large_trader_csv(spark, path)


@query(
    "s6_holder_table",
    """WITH h AS (SELECT stock_id, DATE '1998-08-01' AS sca_date, band, 'band ' || band AS band_label, CAST(sum(holders) AS BIGINT) AS holders, CAST(sum(shares) AS BIGINT) AS shares, CAST(0.5 AS DOUBLE) AS pct FROM holders WHERE band <= 15 GROUP BY stock_id, band)
    SELECT * FROM h WHERE stock_id IN (SELECT stock_id FROM h GROUP BY stock_id HAVING count(*) = 15)""",
)
def s6(spark: SparkSession, d: str) -> DataFrame:
    """One page per nation over all months, as single months seldom have all bands; pages that lack one are left out."""
    day = F.lit("1998-08-01").cast("date").alias("sca_date")
    bands = adapters.holder_distribution(spark, d).where("band <= 15").groupBy("stock_id", day, "band").agg(F.sum("holders").alias("holders"), F.sum("shares").alias("shares"))
    cells = [text("band"), F.concat(F.lit("<b>band "), text("band"), F.lit("</b>")), grouped("holders"), grouped("shares"), F.lit("0.5%")]
    return parsers.parse_holder_table(html_rows(bands, ["stock_id", "sca_date"], cells))


@query(
    "s7_stock_futures_map",
    r"""SELECT DISTINCT 'B' || k AS product_code, '09' || k AS stock_id, CASE WHEN even THEN '小型' ELSE '' END || p_brand AS product_name, CAST(even AS INTEGER) AS is_mini, 0 AS is_etf, CASE WHEN even THEN 0.1 ELSE 2.0 END AS lots_per_contract, coalesce(name, 'listed') AS stock_name
    FROM (SELECT p_brand, lpad(n, 2, '0') AS k, CAST(n AS INTEGER) % 2 = 0 AS even FROM (SELECT p_brand, regexp_extract(p_brand, '(\d+)', 1) AS n FROM part)) p
    LEFT JOIN (SELECT lpad(stock_id, 4, '0') AS id, name FROM instruments WHERE length(stock_id) <= 4) i ON i.id = '09' || k""",
)
def s7(spark: SparkSession, d: str) -> DataFrame:
    number = F.lpad(F.regexp_extract("p_brand", r"(\d+)", 1), 2, "0")
    even = number.cast("int") % 2 == 0
    brands = adapters.table(spark, d, "part").select("p_brand").distinct().withColumn("page", F.lit("all"))
    cells = [F.concat(F.lit("B"), number), F.concat(F.when(even, "小型").otherwise(""), "p_brand"), F.concat(F.lit("09"), number), F.lit("listed")]
    names = adapters.instruments(spark, d).where(F.length("stock_id") <= 4).select(code().alias("stock_id"), "name")
    return parsers.parse_stock_futures_map(html_rows(brands, ["page"], cells).select("html"), names)


@query(
    "s8_broker_html",
    """SELECT stock_id, date, broker_name || side AS broker_name, buy_volume, sell_volume, abs(net_volume) * CASE side WHEN ' buys' THEN 1 ELSE -1 END AS net_volume, pct FROM brokers, (VALUES (' buys'), (' sells')) s(side) WHERE buy_volume <> 0 OR sell_volume <> 0 OR net_volume <> 0""",
)
def s8(spark: SparkSession, d: str) -> DataFrame:
    side = lambda name: [F.concat("broker_name", F.lit(name)), grouped("buy_volume"), grouped("sell_volume"), grouped(F.abs("net_volume")), F.concat(text("pct"), F.lit("%"))]
    return parsers.parse_broker_html(html_rows(adapters.broker_trades(spark, d), ["stock_id", "date"], side(" buys") + side(" sells")))


@query("s9_announcements", "SELECT announce_date, stock_id, 'name' AS name, 'condition' AS condition, period_start, period_end, action, CAST(length(stock_id) = 4 AND regexp_matches(stock_id, '^[1-9]') AS INTEGER) AS is_real_stock FROM disp")
def s9(spark: SparkSession, d: str) -> DataFrame:
    roc = lambda c: F.lpad(exprs.to_roc(F.col(c)), 9, "0")
    cells = [roc("announce_date"), F.concat(F.lit(" "), "stock_id"), F.lit("name"), F.lit("condition"), F.concat(roc("period_start"), F.lit("～"), roc("period_end")), F.col("action")]
    return parsers.parse_announcements(rows_payload(adapters.disposition_announcements(spark, d), "announce_date", cells).select("payload"))


@query("s10_series_csv", "SELECT date, indicator, value FROM macro WHERE indicator = 'click' AND date_part('day', date) % 7 <> 0")
def s10(spark: SparkSession, d: str) -> DataFrame:
    path = landed(spark, "series")
    rows = adapters.macro_indicators(spark, d).where("indicator = 'click'").select("date", F.when(F.day("date") % 7 == 0, ".").otherwise(text("value")).alias("value"))
    rows.write.option("header", "true").csv(path)
    return parsers.parse_fred_csv(spark, path, "click")


@query("s11_chart_json", "SELECT stock_id AS symbol, date, round(CASE WHEN volume % 3 = 0 THEN close_price ELSE open_price END, 4) AS open_price, round(close_price, 4) AS close_price FROM bars WHERE volume % 5 <> 0")
def s11(spark: SparkSession, d: str) -> DataFrame:
    bars = adapters.daily_prices(spark, d)
    one = F.struct(F.unix_timestamp(F.to_timestamp("date")).alias("t"), F.when(F.col("volume") % 3 == 0, F.lit(0.0)).otherwise(F.col("open_price")).alias("o"), F.when(F.col("volume") % 5 != 0, F.col("close_price")).alias("c"))
    arrays = bars.groupBy(F.col("stock_id").alias("symbol")).agg(F.collect_list(one).alias("z"))  # one payload a symbol, as such feeds send them
    return parsers.parse_chart_json(arrays.select("symbol", F.to_json(F.struct(F.col("z.t").alias("timestamp"), F.col("z.o").alias("open"), F.col("z.c").alias("close")), {"ignoreNullFields": "false"}).alias("payload")))


@query("s11_margin_snapshots", "SELECT date, stock_id, CASE WHEN balance % 2 = 0 THEN buy + 1 ELSE buy END AS buy, balance FROM margin")
def s11b(spark: SparkSession, d: str) -> DataFrame:
    margin = adapters.margin(spark, d)
    parts = margin.select("date", F.lit(1).alias("part"), "stock_id", "buy", "balance").unionByName(margin.where("balance % 2 = 0").select("date", F.lit(2).alias("part"), "stock_id", (F.col("buy") + 1).alias("buy"), "balance"))
    payload = F.to_json(F.map_from_entries(F.collect_list(F.struct("stock_id", F.array("buy", "balance")))))
    return parsers.explode_margin_snapshots(parts.groupBy("date", "part").agg(payload.alias("payload")))


@query("s13_sorted_files", "SELECT stock_id, date, foreign_buy, sitc_buy, dealer_buy, total_buy, 0 AS overlaps FROM flows")
def s13(spark: SparkSession, d: str) -> DataFrame:
    """Flows written as range-sorted files and read back; overlaps counts files that begin before an earlier one ends."""
    path = landed(spark, "flows")
    sinks.write_sorted(adapters.institutional(spark, d), path, ["date", "stock_id"], partitions=8)
    rows = spark.read.parquet(path)
    files = rows.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min(F.struct("date", "stock_id")).alias("lo"), F.max(F.struct("date", "stock_id")).alias("hi"))
    pairs = files.alias("a").join(files.alias("b"), (F.col("a.f") < F.col("b.f")) & (F.col("a.hi") >= F.col("b.lo")) & (F.col("b.hi") >= F.col("a.lo")))  # eight files
    return rows.join(F.broadcast(pairs.agg(F.count("*").cast("int").alias("overlaps"))))


@query(
    "s14_market_summary",
    """SELECT market, count(*) AS n, count(DISTINCT f.stock_id) AS stocks, min(date) AS first_date, max(date) AS last_date, CAST(sum(foreign_buy) AS BIGINT) AS foreign_buy, CAST(sum(sitc_buy) AS BIGINT) AS sitc_buy, CAST(sum(dealer_buy) AS BIGINT) AS dealer_buy FROM flows f JOIN instruments i ON f.stock_id = i.stock_id GROUP BY 1""",
)
def s14(spark: SparkSession, d: str) -> DataFrame:
    """Summary per market of a flow package, from its range-sorted files."""
    path = landed(spark, "package")
    flows = adapters.institutional(spark, d).join(adapters.instruments(spark, d).select("stock_id", "market"), "stock_id")
    sinks.write_sorted(flows, path, ["stock_id", "date"], partitions=8)
    rows = spark.read.parquet(path)
    return rows.groupBy("market").agg(F.count("*").alias("n"), F.countDistinct("stock_id").alias("stocks"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), *[F.sum(c).alias(c) for c in ("foreign_buy", "sitc_buy", "dealer_buy")])


@query("s15_indicator_files", "SELECT date, indicator, value, count(*) OVER (PARTITION BY indicator) AS manifest_n FROM macro")
def s15(spark: SparkSession, d: str) -> DataFrame:
    """One folder of CSV per indicator, read back with its manifest's row counts."""
    path = landed(spark, "indicators")
    manifest = sinks.export_indicator_series(adapters.macro_indicators(spark, d), path)
    rows = spark.read.schema("date date, value double, indicator string").option("header", "true").csv(path)
    return rows.join(manifest.select("indicator", F.col("n").alias("manifest_n")), "indicator")


@query("f1_numbers", "SELECT o_orderkey, round(o_totalprice, 2) AS grouped, round(o_totalprice, 1) AS percent, CAST(NULL AS DOUBLE) AS dash, CAST(0 AS BIGINT) AS zero, CAST(round(o_totalprice) AS BIGINT) AS whole FROM orders")
def f1(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    return adapters.table(spark, d, "orders").select(
        "o_orderkey",
        exprs.number(F.concat(F.lit(" "), F.format_number(price, 2), F.lit(" "))).alias("grouped"),
        exprs.number(F.concat(F.lit("X"), text(F.round(price, 1)), F.lit("%"))).alias("percent"),
        exprs.number(F.lit(" -- ")).alias("dash"),
        exprs.number(F.lit("-"), zero=True, kind="long").alias("zero"),
        exprs.number(grouped(F.round(price)), kind="long").alias("whole"),
    )


@query("f8_disposition_interval", "SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 5 WHEN '2' THEN 10 WHEN '3' THEN 20 WHEN '4' THEN 60 END AS minutes FROM orders")
def f8(spark: SparkSession, d: str) -> DataFrame:
    kind = F.substring("o_orderpriority", 1, 1)
    action = F.when(kind == "1", "約每5分鐘撮合一次").when(kind == "2", "約每十分鐘撮合一次").when(kind == "3", "以人工管制之撮合終端機執行撮合作業(約每二十分鐘撮合一次)").when(kind == "4", "約每60分鐘撮合一次").otherwise("no matching")
    return adapters.table(spark, d, "orders").select("o_orderkey", exprs.disposition_interval(action).alias("minutes"))


@query("f9_contract_label", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m') || CASE WHEN o_orderkey % 2 = 0 THEN ' W' || (o_orderkey % 5 + 1) ELSE '' END AS label FROM orders")
def f9(spark: SparkSession, d: str) -> DataFrame:
    week = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("W"), text(F.col("o_orderkey") % 5 + 1))).otherwise("")
    return adapters.table(spark, d, "orders").select("o_orderkey", exprs.contract_label(F.concat(F.date_format("o_orderdate", "yyyyMM"), week)).alias("label"))


@query("f12_report_name", "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'note' END AS kind, CASE WHEN p_partkey % 3 > 0 THEN lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') END AS code, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS name FROM part")
def f12(spark: SparkSession, d: str) -> DataFrame:
    file = F.concat(F.lit("note_"), F.when(F.col("p_partkey") % 3 > 0, F.lpad(text(F.col("p_partkey") % 10000), 4, "0")).otherwise("x"), F.lit("_"), "p_name", F.lit(".pdf"))
    kind, number, name = exprs.report_name(file)
    return adapters.table(spark, d, "part").select("p_partkey", kind.alias("kind"), number.alias("code"), name.alias("name"))


@query("f14_json_built", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, round(o_totalprice, 2) AS price, o_orderpriority AS priority FROM orders")
def f14(spark: SparkSession, d: str) -> DataFrame:
    """Payloads built with to_json and read back by their schema."""
    built = F.to_json(F.struct(F.col("o_orderdate").cast("date").alias("day"), F.round("o_totalprice", 2).alias("price"), F.col("o_orderpriority").alias("priority")))
    back = F.from_json("payload", "day date, price double, priority string")
    return adapters.table(spark, d, "orders").select("o_orderkey", built.alias("payload")).select("o_orderkey", back.alias("p")).select("o_orderkey", "p.*")
