"""Parsers from landed raw payloads to tables, with built-in functions only; one input row is one payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.exprs import lots, number, roc_date

_CELLS = r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"


def read_table(spark: SparkSession, path: str, schema: str, kind: str = "parquet", **options: str) -> DataFrame:
    """Parquet, CSV or JSON with an explicit schema, never an inferred one."""
    return spark.read.schema(schema).options(**options).format(kind).load(path)


def _arrays(raw: DataFrame, field: str) -> DataFrame:
    rows = F.from_json("payload", f"{field} array<array<string>>")[field]
    return raw.select("date", F.posexplode(rows).alias("_n", "r"))


def parse_daily_quotes(raw: DataFrame) -> DataFrame:
    """Bars from payload.data rows [id, name, shares, trades, value, open, high, low, close, sign html, change]; raw: date, payload.

    Only identifiers of four digits with a close; the change's sign comes from the markup; lots round down.
    """
    at = lambda i: F.element_at("r", i + 1)
    rows = _arrays(raw, "data").where(F.size("r") >= 11).where(at(0).rlike(r"^\d{4}$"))
    sign = F.when(F.contains(at(9), F.lit("green")) | F.contains(at(9), F.lit(">-<")), -1.0).otherwise(1.0)
    close, change = number(at(8)), number(at(10)) * sign
    pct = F.when(F.coalesce(close, F.lit(0.0)).isin(0.0) | change.isNull() | (close == change), 0.0).otherwise(F.round(change / (close - change) * 100, 2))
    out = rows.select(at(0).alias("stock_id"), "date", number(at(5)).alias("open_price"), number(at(6)).alias("high_price"), number(at(7)).alias("low_price"), close.alias("close_price"), lots(number(at(2))).alias("volume"), number(at(4), kind="long").alias("trade_value"), pct.alias("change_pct"))
    return out.where("close_price IS NOT NULL")


def parse_institutional(raw: DataFrame, columns: tuple[int, int, int]) -> DataFrame:
    """Net flows in lots (rounded down) from payload.data rows; columns: where foreign, trust and dealer nets stand."""
    rows = _arrays(raw, "data").where(F.element_at("r", 1).rlike(r"^\d{4}$"))
    names = ("foreign_buy", "sitc_buy", "dealer_buy")
    out = rows.select(F.element_at("r", 1).alias("stock_id"), "date", *[lots(number(F.get("r", c), zero=True)).alias(n) for n, c in zip(names, columns, strict=True)])
    return out.withColumn("total_buy", F.col("foreign_buy") + F.col("sitc_buy") + F.col("dealer_buy"))


_OPTION = "date string, code string, contract string, strike string, cp string, open string, high string, low string, close string, volume string, settlement string, oi string, bid string, ask string, best_bid string, best_ask string, x1 string, session string, x2 string, change string, change_pct string"


def big5(text: str) -> str:
    """How a reader of single bytes sees Big5 text. Spark's readers take few encodings, but no Big5 byte is a comma, quote or line end."""
    return text.encode("big5").decode("latin-1")


def _read_big5(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(header="true", encoding="ISO-8859-1", escape="\0", enforceSchema="true").csv(path)


def read_option_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily option file in Big5: regular session of the index option only, rows of at least 21 cells."""
    rows = _read_big5(spark, path, _OPTION).where("change_pct IS NOT NULL")
    rows = rows.where((F.trim("code") == "TXO") & (F.trim("session") == big5("一般")))
    side = F.when(F.trim("cp") == big5("買權"), "C").when(F.trim("cp") == big5("賣權"), "P")
    whole = lambda c: number(F.col(c), kind="long")
    return rows.select(F.to_date(F.trim("date"), "yyyy/MM/dd").alias("date"), F.trim("contract").alias("contract"), number(F.col("strike")).alias("strike"), side.alias("cp"), *[number(F.col(c)).alias(c) for c in ("close", "settlement", "change", "change_pct")], whole("volume").alias("volume"), whole("oi").alias("oi"))


_TRADERS = "date string, code string, name string, month string, trader_type string, b5 string, s5 string, b10 string, s10 string, oi string"


def read_large_trader_csv(spark: SparkSession, path: str) -> DataFrame:
    """Large-trader file in Big5: the all-months rows of trader types 0 and 1; '-' counts as 0."""
    rows = _read_big5(spark, path, _TRADERS)
    rows = rows.where((F.trim("month") == "999999") & F.trim("trader_type").isin("0", "1"))
    named = {"b5": "top5_buy", "s5": "top5_sell", "b10": "top10_buy", "s10": "top10_sell", "oi": "market_oi"}
    return rows.select(F.to_date(F.trim("date"), "yyyy/MM/dd").alias("date"), F.trim("code").alias("product_code"), F.trim("trader_type").cast("int").alias("trader_type"), *[number(F.col(c), zero=True, kind="long").alias(n) for c, n in named.items()])


def _table_rows(raw: DataFrame, size: int) -> DataFrame:
    """The cells, without markup, of the html's table rows of `size` cells."""
    tr = F.regexp_extract_all("html", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(_CELLS), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), "&nbsp;", " ")))
    keys = [c for c in raw.columns if c != "html"]
    return raw.select(*keys, F.posexplode(tr).alias("_n", "tr")).select(*keys, "_n", cells.alias("c")).where(F.size("c") == size)


def parse_holder_table(raw: DataFrame) -> DataFrame:
    """Holder bands from html rows of five cells (band, label, holders, shares, percent); pages without all of bands 1 to 15 are left out.

    raw: stock_id, sca_date, html.
    """
    c = lambda i: F.element_at("c", i + 1)
    rows = _table_rows(raw, 5).where(c(0).rlike(r"^\d+$"))
    out = rows.select("stock_id", "sca_date", c(0).cast("int").alias("band"), c(1).alias("band_label"), number(c(2), kind="long").alias("holders"), number(c(3), kind="long").alias("shares"), number(c(4)).alias("pct"))
    whole = out.where(F.col("band").between(1, 15)).groupBy("stock_id", "sca_date").agg(F.countDistinct("band").alias("_k")).where("_k = 15")
    return out.join(whole.select("stock_id", "sca_date"), ["stock_id", "sca_date"], "left_semi")


def parse_stock_futures_map(raw: DataFrame, names: DataFrame) -> DataFrame:
    """Contracts from html rows of (code, product name, stock id, stock name); first row of a code wins. raw: html."""
    c = lambda i: F.element_at("c", i + 1)
    rows = _table_rows(raw, 4).where(c(0).rlike(r"^[A-Z0-9]{2,3}$") & c(2).rlike(r"^\d{4,6}$"))
    first = rows.groupBy(c(0).alias("product_code")).agg(F.min_by("c", "_n").alias("c"))
    mini, etf = F.contains(c(1), F.lit("小型")), F.startswith(c(2), F.lit("00"))
    size = F.when(etf & mini, 1.0).when(etf, 10.0).when(mini, 0.1).otherwise(2.0)
    out = first.select("product_code", c(2).alias("stock_id"), c(3).alias("listed_name"), c(1).alias("product_name"), mini.cast("int").alias("is_mini"), etf.cast("int").alias("is_etf"), size.alias("lots_per_contract"))
    return out.join(names.select("stock_id", "name"), "stock_id", "left").withColumn("stock_name", F.coalesce("name", "listed_name")).drop("name", "listed_name")


def parse_broker_html(raw: DataFrame) -> DataFrame:
    """Branch trades from html rows of ten cells: buyers on the left, sellers on the right (net made negative). raw: stock_id, date, html."""
    c = lambda i: F.element_at("c", i + 1)
    side = lambda k, sign: F.struct(c(k).alias("broker_name"), number(c(k + 1), True, "long").alias("buy_volume"), number(c(k + 2), True, "long").alias("sell_volume"), (F.abs(number(c(k + 3), True, "long")) * sign).alias("net_volume"), number(c(k + 4)).alias("pct"))
    rows = _table_rows(raw, 10).select("stock_id", "date", F.explode(F.array(side(0, 1), side(5, -1))).alias("s")).select("stock_id", "date", "s.*")
    return rows.where((F.col("broker_name") != "") & ~F.col("broker_name").rlike(r"^[\d,.]+$") & ~F.contains("broker_name", F.lit("券商")) & ((F.col("buy_volume") != 0) | (F.col("sell_volume") != 0) | (F.col("net_volume") != 0)))


def parse_announcements(raw: DataFrame) -> DataFrame:
    """Announcements from payload.data rows [date, id, name, condition, period, action]; raw: payload."""
    rows = F.from_json("payload", "data array<array<string>>")["data"]
    at = lambda i: F.element_at("r", i + 1)
    span = F.split(at(4), "[～~至]")
    stock = F.trim(at(1))
    real = stock.rlike(r"^\d{4}$") & stock.try_cast("int").between(1000, 9999)
    out = raw.select(F.explode(rows).alias("r")).select(roc_date(at(0)).alias("announce_date"), stock.alias("stock_id"), at(2).alias("name"), at(3).alias("condition"), roc_date(F.get(span, 0)).alias("period_start"), roc_date(F.get(span, 1)).alias("period_end"), at(5).alias("action"), F.coalesce(real, F.lit(False)).cast("int").alias("is_real_stock"))
    return out.where("announce_date IS NOT NULL")


def parse_fred_csv(spark: SparkSession, path: str, indicator: str) -> DataFrame:
    """Date and value columns; '.' and blanks are left out."""
    rows = spark.read.schema("date string, value string").options(header="true", enforceSchema="true").csv(path)
    return rows.select(F.col("date").try_cast("date").alias("date"), F.lit(indicator).alias("indicator"), number(F.col("value")).alias("value")).dropna()


def parse_chart_json(raw: DataFrame) -> DataFrame:
    """Bars from parallel arrays (timestamp, open, close); a missing or zero open takes the close. raw: symbol, payload."""
    q = F.from_json("payload", "timestamp array<long>, open array<double>, close array<double>")
    rows = raw.select("symbol", F.explode(F.arrays_zip(q["timestamp"].alias("t"), q["open"].alias("o"), q["close"].alias("c"))).alias("z")).where("z.c IS NOT NULL")
    return rows.select("symbol", F.to_date(F.timestamp_seconds("z.t")).alias("date"), F.round(F.coalesce(F.nullif("z.o", F.lit(0.0)), "z.c"), 4).alias("open_price"), F.round("z.c", 4).alias("close_price"))


def explode_margin_snapshots(raw: DataFrame) -> DataFrame:
    """Rows of {code: [buy, balance]} payloads; of two payloads with a code on one date the later (by part) wins. raw: date, part, payload."""
    m = raw.select("date", "part", F.explode(F.from_json("payload", "map<string, array<bigint>>")).alias("stock_id", "v"))
    return m.groupBy("date", "stock_id").agg(F.max_by("v", "part").alias("v")).select("date", "stock_id", F.get("v", 0).alias("buy"), F.get("v", 1).alias("balance"))
