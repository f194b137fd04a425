"""Queries of joins, selections, restriction periods, margin, macro indicators and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators import disposition, joins, macro, margin, quality, technical
from panelspark.sources import adapters

from .market import _BREADTH, bars, net, stocks
from .registry import ORACLES, query
from .storage import stored
from .series import _COMPLETE, _TRIM, BREAKOUTS, COST_ROLL, cost_seed, rounded
from panelspark.operators import flows, recursive

ASOF = "1999-06-28"

# Selections ----------------------------------------------------------------------------------


@query("t1_breakout_list", f"WITH b AS ({BREAKOUTS}) SELECT b.stock_id, name, market, date, close_price, change_pct, volume, break_5, break_20 FROM b JOIN instruments i ON b.stock_id = i.stock_id WHERE date = (SELECT max(date) FROM b) ORDER BY change_pct DESC NULLS LAST, b.stock_id LIMIT 50")
def t1(spark: SparkSession, d: str) -> DataFrame:
    found = technical.breakouts(bars(spark, d))
    rows = found.join(F.broadcast(found.agg(F.max("date").alias("date"))), "date").join(stocks(spark, d), "stock_id")  # one date
    return rows.select("stock_id", "name", "market", "date", "close_price", "change_pct", "volume", "break_5", "break_20").orderBy(F.desc_nulls_last("change_pct"), "stock_id").limit(50)


def screener(prices: DataFrame, names: DataFrame, inst: DataFrame, flags: DataFrame, min_vol: int | None = None, min_price: float | None = None, max_price: float | None = None, min_change: float | None = None, max_change: float | None = None, foreign: int | None = None, sitc: int | None = None, consec_foreign: int | None = None, break_n: int | None = None, market: str | None = None, limit: int = 200) -> DataFrame:
    """Instruments of the newest date that pass all active filters; none without any. A zero price or volume bound counts as absent.

    foreign and sitc: 1 for buying, -1 for selling; consec_foreign alone only makes the other filters count as active; market 'all' is none.
    """
    tests = [F.lit(True)] if consec_foreign else []
    if min_vol:
        tests.append(F.col("volume") >= min_vol)
    if min_price:
        tests.append(F.col("close_price") >= min_price)
    if max_price:
        tests.append(F.col("close_price") <= max_price)
    if min_change is not None:
        tests.append(F.col("change_pct") >= min_change)
    if max_change is not None:
        tests.append(F.col("change_pct") <= max_change)
    if foreign:
        tests.append(F.col("foreign_buy") * foreign > 0)
    if sitc:
        tests.append(F.col("sitc_buy") * sitc > 0)
    if break_n in technical.DAYS:
        tests.append(F.col(f"break_{break_n}") == 1)
    if market and market != "all":
        tests.append(F.col("market") == market)
    rows = prices.join(F.broadcast(prices.agg(F.max("date").alias("date"))), "date").join(names, "stock_id")  # one date
    rows = rows.join(inst, ["stock_id", "date"], "left").join(flags.drop("close_price", "volume", "change_pct"), ["stock_id", "date"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("foreign_buy", "sitc_buy", "dealer_buy")})
    for test in tests or [F.lit(False)]:
        rows = rows.where(test)
    return rows.select("stock_id", "name", "market", "date", "close_price", "change_pct", "volume", "foreign_buy", "sitc_buy").orderBy(F.desc("volume"), "stock_id").limit(limit)


@query("p1_screener", "SELECT b.stock_id, name, market, b.date, close_price, change_pct, volume, coalesce(foreign_buy, 0) AS foreign_buy, coalesce(sitc_buy, 0) AS sitc_buy FROM bars b JOIN instruments i ON b.stock_id = i.stock_id LEFT JOIN flows f ON b.stock_id = f.stock_id AND b.date = f.date WHERE b.date = (SELECT max(date) FROM bars) AND volume >= 20 AND close_price >= 80 AND change_pct >= -50 AND coalesce(foreign_buy, 0) >= 0 AND coalesce(foreign_buy, 0) * 1 > 0 ORDER BY volume DESC, b.stock_id LIMIT 200")
def p1(spark: SparkSession, d: str) -> DataFrame:
    prices = bars(spark, d)
    return screener(prices, stocks(spark, d), net(spark, d), technical.breakouts(prices), min_vol=20, min_price=80, min_change=-50, foreign=1)


@query("p3_breakout_any", f"SELECT * FROM ({BREAKOUTS}) WHERE break_20 = 1 OR break_60 = 1")
def p3(spark: SparkSession, d: str) -> DataFrame:
    return technical.breakouts(bars(spark, d)).where(technical.any_flag((20, 60)))


@query("p4_search_instruments", "SELECT * FROM instruments WHERE starts_with(stock_id, '1') OR contains(name, '#00000002') ORDER BY stock_id LIMIT 10")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return stocks(spark, d).where(F.col("stock_id").startswith("1") | F.col("name").contains("#00000002")).orderBy("stock_id").limit(10)


@query("p2_real_stocks", "SELECT l_partkey AS part, count(*) AS n FROM lineitem WHERE length(CAST(l_partkey AS VARCHAR)) = 4 AND regexp_matches(CAST(l_partkey AS VARCHAR), '^[1-9]') GROUP BY 1")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return adapters.table(spark, d, "lineitem").where(disposition.is_real_stock(F.col("l_partkey").cast("string"))).groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"))


_PHASE = "CASE WHEN period_start <= DATE '{0}' AND period_end >= DATE '{0}' THEN 'active' WHEN period_end < DATE '{0}' AND period_end >= DATE '{0}' - 7 THEN 'recent' WHEN period_start > DATE '{0}' THEN 'pending' END"


@query("p6_active_periods", f"SELECT * FROM disp WHERE period_start <= DATE '{ASOF}' AND period_end >= DATE '{ASOF}'")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return disposition.active_on(adapters.disposition_announcements(spark, d), ASOF)


@query("p7_phase", f"SELECT announcement_id, stock_id, {_PHASE.format(ASOF)} AS phase FROM disp")
def p7(spark: SparkSession, d: str) -> DataFrame:
    return adapters.disposition_announcements(spark, d).select("announcement_id", "stock_id", disposition.phase(F.col("period_start"), F.col("period_end"), ASOF).alias("phase"))


@query("a33_breakout_stats", f"SELECT count(*) AS n, count(DISTINCT date) AS days, count(DISTINCT stock_id) AS stocks, {', '.join(f'CAST(sum(break_{n}) AS BIGINT) AS break_{n}' for n in technical.DAYS)} FROM ({BREAKOUTS})")
def a33(spark: SparkSession, d: str) -> DataFrame:
    return technical.breakouts(bars(spark, d)).agg(F.count("*").alias("n"), F.countDistinct("date").alias("days"), F.countDistinct("stock_id").alias("stocks"), *[F.sum(f"break_{n}").alias(f"break_{n}") for n in technical.DAYS])


# Joins and set operations ---------------------------------------------------------------------


@query("j2_bars_flows", "SELECT b.stock_id, b.date, b.close_price, foreign_buy, CAST(p.stock_id IS NOT NULL AS INTEGER) AS flagged FROM bars b LEFT JOIN flows f ON b.stock_id = f.stock_id AND b.date = f.date LEFT JOIN (" + BREAKOUTS + ") p ON b.stock_id = p.stock_id AND b.date = p.date")
def j2(spark: SparkSession, d: str) -> DataFrame:
    prices = bars(spark, d)
    flags = technical.breakouts(prices).select("stock_id", "date", F.lit(1).alias("flagged"))
    return prices.join(net(spark, d), ["stock_id", "date"], "left").join(flags, ["stock_id", "date"], "left").select("stock_id", "date", "close_price", "foreign_buy", F.coalesce("flagged", F.lit(0)).alias("flagged"))


@query("j3_last_bars", "SELECT i.stock_id, name, close_price, volume FROM instruments i JOIN bars b ON i.stock_id = b.stock_id WHERE date = (SELECT max(date) FROM bars) AND sector = 'NATION_7'")
def j3(spark: SparkSession, d: str) -> DataFrame:
    prices = bars(spark, d)
    watch = stocks(spark, d).where("sector = 'NATION_7'")
    return prices.join(F.broadcast(prices.agg(F.max("date").alias("date"))), "date").join(watch, "stock_id").select("stock_id", "name", "close_price", "volume")  # one date


@query("j4_latest_snapshot", "SELECT * FROM snaps QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY snapshot_ts DESC, event_id DESC) = 1")
def j4(spark: SparkSession, d: str) -> DataFrame:
    return joins.latest_per_key(adapters.intraday_snapshots(spark, d), "stock_id", ["snapshot_ts", "event_id"])


@query("j5_interval_join", "SELECT announcement_id, p.stock_id, p.date, close_price FROM bars p JOIN disp d ON p.stock_id = d.stock_id AND p.date BETWEEN d.period_start - 30 AND d.period_end")
def j5(spark: SparkSession, d: str) -> DataFrame:
    rows = joins.interval_join(bars(spark, d), adapters.disposition_announcements(spark, d), "stock_id", F.date_sub("period_start", 30), F.col("period_end"))
    return rows.select("announcement_id", "stock_id", "date", "close_price")


@query("j6_asof_join", "SELECT announcement_id, d.stock_id, b.date AS matched_date, b.close_price AS matched_close_price FROM disp d ASOF LEFT JOIN bars b ON d.stock_id = b.stock_id AND d.announce_date >= b.date")
def j6(spark: SparkSession, d: str) -> DataFrame:
    return joins.asof_join(adapters.disposition_announcements(spark, d), bars(spark, d), "stock_id", "announce_date", "date", ["close_price"]).select("announcement_id", "stock_id", "matched_date", "matched_close_price")


@query("j7_nth_later", "SELECT stock_id, date, lead(close_price, 5) OVER (PARTITION BY stock_id ORDER BY date) AS later_close_price FROM bars")
def j7(spark: SparkSession, d: str) -> DataFrame:
    return joins.nth_later(bars(spark, d), 5, ["close_price"]).select("stock_id", "date", "later_close_price")


def two_calendars(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = bars(spark, d).where("volume % 2 = 0").select(F.col("stock_id").alias("series"), "date", F.col("close_price").alias("a"))
    return a, net(spark, d).where("total_buy % 3 = 0").select(F.col("stock_id").alias("series"), "date", F.col("foreign_buy").alias("b"))


@query(
    "j8_align_calendars",
    "SELECT * FROM (SELECT stock_id AS series, date, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM (SELECT coalesce(x.stock_id, y.stock_id) AS stock_id, coalesce(x.date, y.date) AS date, close_price AS a, foreign_buy AS b FROM (SELECT * FROM bars WHERE volume % 2 = 0) x FULL JOIN (SELECT * FROM flows WHERE total_buy % 3 = 0) y ON x.stock_id = y.stock_id AND x.date = y.date) WINDOW w AS (PARTITION BY stock_id ORDER BY date ROWS UNBOUNDED PRECEDING)) WHERE a IS NOT NULL AND b IS NOT NULL",
)
def j8(spark: SparkSession, d: str) -> DataFrame:
    return joins.align_both_calendars(*two_calendars(spark, d), "a", "b")


@query(
    "j8_one_calendar",
    "SELECT x.stock_id AS series, x.date, x.close_price AS a, y.foreign_buy AS b FROM (SELECT * FROM bars WHERE volume % 2 = 0) x ASOF JOIN (SELECT * FROM flows WHERE total_buy % 3 = 0 AND foreign_buy IS NOT NULL) y ON x.stock_id = y.stock_id AND x.date >= y.date",
)
def j8b(spark: SparkSession, d: str) -> DataFrame:
    return joins.align_calendars(*two_calendars(spark, d), "a", "b")


@query("j9_active_instruments", "SELECT * FROM instruments WHERE stock_id IN (SELECT stock_id FROM sparse WHERE date >= (SELECT max(date) FROM sparse) - 30)")
def j9(spark: SparkSession, d: str) -> DataFrame:
    return joins.active_instruments(stocks(spark, d), adapters.daily_prices_sparse(spark, d))


@query("j10_orphans", "SELECT stock_id, max(date) AS last_date, count(*) AS n, CASE WHEN max(date) >= CAST((SELECT max(date) FROM sparse) - INTERVAL 6 MONTH AS DATE) THEN 'recent' ELSE 'old' END AS kind FROM sparse WHERE stock_id NOT IN (SELECT stock_id FROM instruments) GROUP BY 1")
def j10(spark: SparkSession, d: str) -> DataFrame:
    return joins.orphans(adapters.daily_prices_sparse(spark, d), stocks(spark, d))


@query("j12_indicator_spread", "SELECT a.date, round(round(a.value - b.value, 6), 4) AS spread FROM macro a JOIN macro b ON a.date = b.date WHERE a.indicator = 'click' AND b.indicator = 'error'")
def j12(spark: SparkSession, d: str) -> DataFrame:
    return macro.spread(adapters.macro_indicators(spark, d), "click", "error")


_BATCH = "SELECT o_orderkey AS k, {cols}, o_orderdate AS load_ts FROM orders WHERE {cond}"


def batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = adapters.table(spark, d, "orders")
    base = orders.where("o_orderkey % 4 < 2").select((F.floor(F.col("o_orderkey") / 2)).alias("k"), "o_totalprice", "o_orderpriority", F.lit(1).alias("load_ts"))
    new = orders.where("o_orderkey % 4 > 0").select((F.floor(F.col("o_orderkey") / 2)).alias("k"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.col("o_orderpriority"), (2 + F.col("o_orderkey") % 2).cast("int").alias("load_ts"))
    base = base.groupBy("k").agg(F.max_by("o_totalprice", F.struct("o_totalprice", "o_orderpriority")).alias("o_totalprice"), F.max_by("o_orderpriority", F.struct("o_totalprice", "o_orderpriority")).alias("o_orderpriority"), F.max("load_ts").alias("load_ts"))
    return base, new.dropDuplicates(["k", "load_ts"])


_BASE = "base AS (SELECT o_orderkey // 2 AS k, arg_max(o_totalprice, row(o_totalprice, o_orderpriority)) AS o_totalprice, arg_max(o_orderpriority, row(o_totalprice, o_orderpriority)) AS o_orderpriority, 1 AS load_ts FROM orders WHERE o_orderkey % 4 < 2 GROUP BY 1), upd AS (SELECT o_orderkey // 2 AS k, o_totalprice + 1 AS o_totalprice, o_orderpriority, CAST(2 + o_orderkey % 2 AS INTEGER) AS load_ts FROM orders WHERE o_orderkey % 4 > 0)"


@query("s12_upsert_replace", f"WITH {_BASE} SELECT * FROM (SELECT * FROM base UNION ALL SELECT * FROM upd) QUALIFY row_number() OVER (PARTITION BY k ORDER BY load_ts DESC) = 1")
def s12(spark: SparkSession, d: str) -> DataFrame:
    return joins.upsert(*batches(spark, d), ["k"])


@query("s12_upsert_ignore", f"WITH {_BASE} SELECT * FROM (SELECT * FROM base UNION ALL SELECT * FROM upd) QUALIFY row_number() OVER (PARTITION BY k ORDER BY load_ts) = 1")
def s12b(spark: SparkSession, d: str) -> DataFrame:
    return joins.upsert(*batches(spark, d), ["k"], "ignore")


@query("s12_upsert_update", f"WITH {_BASE}, u AS (SELECT * FROM upd QUALIFY row_number() OVER (PARTITION BY k ORDER BY load_ts DESC) = 1) SELECT coalesce(b.k, u.k) AS k, CASE WHEN u.k IS NOT NULL THEN u.o_totalprice ELSE b.o_totalprice END AS o_totalprice, b.o_orderpriority, coalesce(u.load_ts, b.load_ts) AS load_ts FROM base b FULL JOIN u ON b.k = u.k")
def s12c(spark: SparkSession, d: str) -> DataFrame:
    base, new = batches(spark, d)
    return joins.upsert(base, new.drop("o_orderpriority"), ["k"], "update")


@query("u3_date_gaps", "SELECT CAST(x AS DATE) AS date FROM range((SELECT min(date) FROM sparse), (SELECT max(date) FROM sparse) + 1, INTERVAL 1 DAY) t(x) WHERE isodow(x) <= 5 AND CAST(x AS DATE) NOT IN (SELECT date FROM sparse)")
def u3(spark: SparkSession, d: str) -> DataFrame:
    return quality.date_gaps(adapters.daily_prices_sparse(spark, d), quality.business_days(spark, "1990-01-01", "2005-12-31"))


@query("u1_top_union", "SELECT DISTINCT stock_id FROM (SELECT stock_id FROM bars WHERE date = (SELECT max(date) FROM bars) QUALIFY row_number() OVER (ORDER BY trade_value DESC, stock_id) <= 20 OR row_number() OVER (ORDER BY volume DESC, stock_id) <= 20)")
def u1(spark: SparkSession, d: str) -> DataFrame:
    prices = bars(spark, d)
    last = prices.join(F.broadcast(prices.agg(F.max("date").alias("date"))), "date")  # one date
    top = lambda c: last.orderBy(F.desc(c), "stock_id").limit(20).select("stock_id")
    return top("trade_value").union(top("volume")).distinct()


@query("u2_common_dates", "SELECT DISTINCT date FROM sparse INTERSECT SELECT DISTINCT date FROM bars")
def u2(spark: SparkSession, d: str) -> DataFrame:
    return adapters.daily_prices_sparse(spark, d).select("date").intersect(bars(spark, d).select("date"))


@query("u4_append_new", "SELECT stock_id, date, close_price FROM bars WHERE date < DATE '1999-01-01' UNION ALL SELECT stock_id, date, close_price FROM bars WHERE date >= DATE '1999-01-01'")
def u4(spark: SparkSession, d: str) -> DataFrame:
    rows = bars(spark, d).select("stock_id", "date", "close_price")
    return joins.append_new(rows.where("date < '1999-01-01'"), rows.where("date >= '1998-06-01'"), ["stock_id", "date"])


@query("u5_loaded_dates", "SELECT DISTINCT market, date FROM bars b JOIN instruments i ON b.stock_id = i.stock_id")
def u5(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).join(stocks(spark, d), "stock_id").select("market", "date").distinct()


@query("s17_date_chunks", "WITH c AS (SELECT CAST(lo AS DATE) AS chunk_start, least(CAST(lo AS DATE) + 89, DATE '2005-12-31') AS chunk_end FROM range(TIMESTAMP '1990-01-01', TIMESTAMP '2006-01-01', INTERVAL 90 DAY) t(lo)) SELECT chunk_start, chunk_end, count(*) AS n, count(DISTINCT stock_id) AS stocks FROM c JOIN bars ON date BETWEEN chunk_start AND chunk_end GROUP BY 1, 2")
def s17(spark: SparkSession, d: str) -> DataFrame:
    dealt = quality.with_date_chunk(bars(spark, d), "1990-01-01", "2005-12-31", 90)
    return dealt.groupBy("chunk_start", "chunk_end").agg(F.count("*").alias("n"), F.countDistinct("stock_id").alias("stocks"))


# Restriction periods --------------------------------------------------------------------------

_RISK = f"""WITH p AS (SELECT * FROM bars WHERE date <= DATE '{ASOF}'), w AS (SELECT *, lag(close_price, 5) OVER (PARTITION BY stock_id ORDER BY date) AS b, avg(volume) OVER (PARTITION BY stock_id ORDER BY date ROWS 5 PRECEDING) AS a6,
  CASE WHEN count(volume) OVER (PARTITION BY stock_id ORDER BY date ROWS 59 PRECEDING) >= 60 THEN avg(volume) OVER (PARTITION BY stock_id ORDER BY date ROWS 59 PRECEDING) END AS a60,
  CASE WHEN (min(change_pct) OVER (PARTITION BY stock_id ORDER BY date ROWS 2 PRECEDING) > 0 OR max(change_pct) OVER (PARTITION BY stock_id ORDER BY date ROWS 2 PRECEDING) < 0) AND count(change_pct) OVER (PARTITION BY stock_id ORDER BY date ROWS 2 PRECEDING) >= 3 THEN round(sum(change_pct) OVER (PARTITION BY stock_id ORDER BY date ROWS 2 PRECEDING), 2) ELSE 0.0 END AS rs,
  count(*) OVER (PARTITION BY stock_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS n, row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) AS rk FROM p),
  f AS (SELECT stock_id, rs, coalesce(change_pct, 0.0) AS chg, round((close_price - b) * 100 / b, 2) AS cum, coalesce(round(a6, 4) / round(a60, 4), 0.0) AS vr, greatest(0.0, least(100.0, abs(round((close_price - b) * 100 / b, 2)) / 32 * 100)) AS r1, greatest(0.0, least(100.0, abs(coalesce(change_pct, 0)) / 9.5 * 100)) AS r2, greatest(0.0, least(100.0, (coalesce(round(a6, 4) / round(a60, 4), 0) - 1) / 4 * 100)) AS r3, greatest(0.0, least(100.0, abs(rs) / 18 * 100)) AS r4 FROM w WHERE rk = 1 AND n >= 6),
  l AS (SELECT DISTINCT stock_id FROM disp WHERE period_start <= DATE '{ASOF}' AND period_end >= DATE '{ASOF}')
  SELECT f.stock_id, name, CASE WHEN l.stock_id IS NOT NULL THEN 100.0 ELSE round(r1 * 0.4 + r2 * 0.2 + r3 * 0.2 + r4 * 0.2, 4) END AS score, concat_ws(', ', CASE WHEN r1 >= 80 THEN 'R1: 6日累積' || printf('%+.1f%%', round(cum, 1)) END, CASE WHEN r2 >= 80 THEN 'R2: 單日' || printf('%+.1f%%', round(chg, 1)) END, CASE WHEN r3 >= 60 AND vr > 0 THEN 'R3: 量能' || printf('%.1fx', round(vr, 1)) END, CASE WHEN r4 >= 60 THEN 'R4: 連3日' || printf('%+.1f%%', round(rs, 1)) END) AS hits, CAST(l.stock_id IS NOT NULL AS INTEGER) AS in_disposition
  FROM f JOIN instruments i ON f.stock_id = i.stock_id LEFT JOIN l ON f.stock_id = l.stock_id ORDER BY score DESC, f.stock_id LIMIT 100"""


@query("x1_disposition_risk", _RISK)
def x1(spark: SparkSession, d: str) -> DataFrame:
    return disposition.disposition_risk(bars(spark, d), stocks(spark, d), adapters.disposition_announcements(spark, d), ASOF)


@query(
    "x2_drop_signals",
    f"""WITH a AS (SELECT * FROM disp QUALIFY row_number() OVER (PARTITION BY stock_id, period_start ORDER BY announce_date, announcement_id) = 1), p AS (SELECT stock_id, date, close_price FROM bars WHERE date <= DATE '{ASOF}'),
    pk AS (SELECT a.stock_id, period_start, announcement_id, period_end, max(close_price) AS peak, first(date ORDER BY close_price DESC, date) AS peak_date FROM a JOIN p ON a.stock_id = p.stock_id AND p.date BETWEEN period_start - 30 AND period_start + 5 GROUP BY 1, 2, 3, 4),
    b AS (SELECT pk.*, (SELECT arg_max(close_price, date) FROM p WHERE p.stock_id = pk.stock_id AND p.date <= pk.period_start - 30) AS base_close FROM pk), r AS (SELECT *, round((peak - base_close) * 100 / base_close, 2) AS rise_pct FROM b WHERE base_close IS NOT NULL),
    h AS (SELECT r.stock_id, period_start, min(date) AS trigger_date, arg_min(close_price, date) AS trigger_close FROM r JOIN p ON r.stock_id = p.stock_id AND p.date BETWEEN period_start AND least(period_end, DATE '{ASOF}') WHERE rise_pct >= 20 AND round(close_price, 4) <= round(peak * 0.7, 4) GROUP BY 1, 2)
    SELECT r.stock_id, r.period_start, announcement_id, period_end, peak, peak_date, base_close, rise_pct, trigger_date, trigger_close, (SELECT arg_max(close_price, date) FROM p WHERE p.stock_id = r.stock_id) AS current_close, CAST(DATE '{ASOF}' - trigger_date <= 7 AS INTEGER) AS fresh FROM r JOIN h ON r.stock_id = h.stock_id AND r.period_start = h.period_start""",
)
def x2(spark: SparkSession, d: str) -> DataFrame:
    return disposition.drop_signals(bars(spark, d), adapters.disposition_announcements(spark, d), ASOF)


@query(
    "x3_oversold",
    f"""WITH a AS (SELECT * FROM disp WHERE period_start <= DATE '{ASOF}' QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY period_start DESC, announcement_id DESC) = 1),
    o AS (SELECT a.stock_id, announcement_id, period_start, period_end, max(close_price) AS peak, arg_max(close_price, date) AS close_now FROM a JOIN bars p ON a.stock_id = p.stock_id AND p.date BETWEEN period_start - 30 AND DATE '{ASOF}' GROUP BY 1, 2, 3, 4)
    SELECT *, {_PHASE.format(ASOF)} AS phase, DATE '{ASOF}' - period_start AS days_in, period_end - DATE '{ASOF}' AS days_left FROM (SELECT *, round((close_now - peak) * 100 / peak, 2) AS drop_pct FROM o) WHERE drop_pct <= -10""",
)
def x3(spark: SparkSession, d: str) -> DataFrame:
    return disposition.oversold(bars(spark, d), adapters.disposition_announcements(spark, d), ASOF, least=10)


_TRADE = f"t AS (SELECT *, round((exit_close - close_price) * 100 / close_price, 2) AS ret FROM (SELECT f.stock_id, f.date, f.close_price, exit_close, exit_date FROM (SELECT * FROM ({BREAKOUTS}) WHERE break_20 = 1) f JOIN (SELECT stock_id, date, lead(close_price, 5) OVER w AS exit_close, lead(date, 5) OVER w AS exit_date FROM bars WINDOW w AS (PARTITION BY stock_id ORDER BY date)) e ON f.stock_id = e.stock_id AND f.date = e.date WHERE exit_close IS NOT NULL))"


@query("x4_backtest", f"WITH {_TRADE} SELECT * FROM t")
def x4(spark: SparkSession, d: str) -> DataFrame:
    prices = bars(spark, d)
    return disposition.breakout_backtest(technical.breakouts(prices), prices, 20, 5)


@query("x4_backtest_monthly", f"WITH {_TRADE} SELECT strftime(date, '%Y-%m') AS month, count(*) AS trades, round(avg(ret), 4) AS avg_ret, round(avg(CAST(ret > 0 AS INTEGER)) * 100, 2) AS win_rate FROM t GROUP BY 1")
def x4b(spark: SparkSession, d: str) -> DataFrame:
    return disposition.backtest_monthly(x4(spark, d))


# Margin -----------------------------------------------------------------------------------------

_AVG_COST = f"SELECT stock_id, round(avg(close_price), 4) AS avg_cost, count(*) AS n FROM (SELECT * FROM bars WHERE date <= DATE '{ASOF}' QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) <= 60) GROUP BY 1"


@query("a7_adv20", f"SELECT stock_id, avg(volume) AS adv, count(*) AS n FROM (SELECT * FROM bars WHERE date < DATE '{ASOF}' AND volume > 0 QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) <= 20) GROUP BY 1 HAVING count(*) >= 10")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return margin.adv(bars(spark, d), ASOF)


@query("a8_market_adv20", "SELECT round(avg(value), 4) AS market_adv, count(*) AS days FROM (SELECT date, sum(trade_value) AS value FROM bars WHERE stock_id IN (SELECT stock_id FROM instruments WHERE market = 'twse') GROUP BY 1 ORDER BY 1 DESC LIMIT 20)")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return margin.market_adv(bars(spark, d), stocks(spark, d).where("market = 'twse'"))


@query("a9_avg_cost", _AVG_COST)
def a9(spark: SparkSession, d: str) -> DataFrame:
    return margin.avg_cost(bars(spark, d), ASOF)


_MP = "FROM margin m JOIN bars b ON m.stock_id = b.stock_id AND m.date = b.date JOIN instruments i ON m.stock_id = i.stock_id"


@query("a24_margin_market", f"""SELECT m.date, round(sum(balance * close_price * 1000) / 1e12, 6) AS market_value, round(sum(CASE WHEN market = 'twse' THEN balance * balance / CAST("limit" AS DOUBLE) END) / sum(CASE WHEN market = 'twse' THEN balance END) * 100, 4) AS utilisation, round(sum(short_balance) / 1e4, 4) AS short_balance, round(sum(short_balance) * 100.0 / sum(balance), 4) AS short_pct {_MP} GROUP BY 1""")
def a24(spark: SparkSession, d: str) -> DataFrame:
    return margin.margin_market(adapters.margin(spark, d), bars(spark, d), stocks(spark, d))


@query(
    "a25_maintenance_distribution",
    f"""WITH c AS ({_AVG_COST}), r AS (SELECT m.date, balance * avg_cost * rate AS loan, balance * close_price AS value, round(close_price / (avg_cost * rate), 6) AS ratio FROM (SELECT m.*, close_price, CASE WHEN market = 'twse' THEN 0.6 ELSE 0.5 END AS rate {_MP}) m JOIN c ON m.stock_id = c.stock_id)
    SELECT date, round(sum(value) * 100 / sum(loan), 4) AS wavg, round(sum(CASE WHEN ratio < 1.4 THEN loan ELSE 0 END) * 100 / sum(loan), 4) AS under_140, round(sum(CASE WHEN ratio < 1.3 THEN loan ELSE 0 END) * 100 / sum(loan), 4) AS under_130 FROM r GROUP BY 1""",
)
def a25(spark: SparkSession, d: str) -> DataFrame:
    return margin.maintenance_distribution(adapters.margin(spark, d), bars(spark, d), margin.avg_cost(bars(spark, d), ASOF), stocks(spark, d))


@query(
    "x5_margin_scan",
    COST_ROLL + ", " + _TRIM.format(src="bars", n=60, step=0.35).removeprefix("WITH ")
    + f""", q AS (SELECT b.stock_id, name, b.date, close_price, balance, coalesce(round(c.cost, 2), avg_close) AS cost FROM bars b JOIN (SELECT stock_id, arg_max(balance, date) AS balance FROM margin GROUP BY 1) m ON b.stock_id = m.stock_id LEFT JOIN rolled c ON b.stock_id = c.stock_id LEFT JOIN trimmed t ON b.stock_id = t.stock_id JOIN instruments i ON b.stock_id = i.stock_id WHERE balance > 0 AND NOT starts_with(b.stock_id, '91') AND b.date = ({_COMPLETE})),
    p AS (SELECT *, CASE WHEN cost > 0 THEN round(close_price / (cost * 0.6) * 100, 2) END AS ratio FROM q) SELECT *, CASE WHEN ratio IS NULL THEN 'na' WHEN ratio < 130 THEN 'danger' WHEN ratio < 166.67 THEN 'warn' ELSE 'safe' END AS level FROM p""",
)
def x5(spark: SparkSession, d: str) -> DataFrame:
    prices, balances = stored(bars(spark, d).select("stock_id", "date", "close_price")), stored(adapters.margin(spark, d).select("stock_id", "date", "buy", "balance"))
    rolled = recursive.roll_cost(cost_seed(prices), balances, prices)
    return margin.margin_scan(prices, stocks(spark, d), balances, rolled)


@query(
    "x5_margin_scan_average",
    _TRIM.format(src="bars", n=60, step=0.35)
    + f""", q AS (SELECT b.stock_id, name, date, close_price, balance, avg_close AS cost, CASE WHEN avg_close > 0 THEN round(close_price / (avg_close * 0.6) * 100, 2) END AS ratio FROM bars b JOIN (SELECT stock_id, arg_max(balance, date) AS balance FROM margin GROUP BY 1) m ON b.stock_id = m.stock_id JOIN trimmed t ON b.stock_id = t.stock_id JOIN instruments i ON b.stock_id = i.stock_id WHERE balance > 0 AND NOT starts_with(b.stock_id, '91') AND date = ({_COMPLETE}))
    SELECT *, CASE WHEN ratio IS NULL THEN 'na' WHEN ratio < 130 THEN 'danger' WHEN ratio < 166.67 THEN 'warn' ELSE 'safe' END AS level FROM q""",
)
def x5b(spark: SparkSession, d: str) -> DataFrame:
    none = spark.createDataFrame([], "stock_id string, cost double")
    return margin.margin_scan(bars(spark, d), stocks(spark, d), adapters.margin(spark, d), none)


@query("x19_margin_usage", """SELECT m.stock_id, name, market, date, balance, "limit", round(balance * 100.0 / "limit", 2) AS use_rate, change, short_balance, close_price FROM (SELECT *, balance - lag(balance) OVER (PARTITION BY stock_id ORDER BY date) AS change, row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) AS rk FROM margin) m JOIN instruments i ON m.stock_id = i.stock_id LEFT JOIN (SELECT stock_id, arg_max(close_price, date) AS close_price FROM bars GROUP BY 1) c ON m.stock_id = c.stock_id WHERE rk = 1 ORDER BY use_rate DESC, m.stock_id LIMIT 50""")
def x19(spark: SparkSession, d: str) -> DataFrame:
    return margin.margin_usage(adapters.margin(spark, d), stocks(spark, d), bars(spark, d))


# Indicators ---------------------------------------------------------------------------------------

POSITIONS = {"click": 80.0, "error": 20.0, "view": 60.0}


@query("a29_indicator_latest", "SELECT indicator, max(date) AS date, arg_max(value, date) AS value, CASE indicator WHEN 'click' THEN 80.0 WHEN 'error' THEN 20.0 WHEN 'view' THEN 60.0 ELSE 50.0 END AS position FROM macro GROUP BY 1")
def a29(spark: SparkSession, d: str) -> DataFrame:
    return macro.indicator_latest(adapters.macro_indicators(spark, d), POSITIONS)


@query("a26_strength_daily", "SELECT stock_id, CAST(snapshot_ts AS DATE) AS date, max(last_price) AS high, min(last_price) AS low, arg_max(last_price, row(snapshot_ts, event_id)) AS last, count(*) AS ticks FROM snaps GROUP BY 1, 2")
def a26(spark: SparkSession, d: str) -> DataFrame:
    return macro.strength_daily(adapters.intraday_snapshots(spark, d))


_COLOUR = "CASE WHEN value < 95 THEN 'GREEN' WHEN value >= 105 THEN 'RED' ELSE 'YELLOW' END"
VOTES = {"click": 0.4, "error": 0.35, "view": 0.25}


@query("x11_macro_signals", "SELECT date, indicator, value, CASE WHEN indicator NOT IN ('click', 'error', 'view') THEN NULL ELSE " + _COLOUR + " END AS colour FROM macro")
def x11(spark: SparkSession, d: str) -> DataFrame:
    return macro.macro_signals(adapters.macro_indicators(spark, d), {k: (95.0, 105.0) for k in VOTES})


@query(
    "x7_position_vote",
    f"""WITH s AS (SELECT date, indicator, {_COLOUR} AS c FROM macro WHERE indicator IN ('click', 'error', 'view')), w AS (SELECT date, {', '.join(f"coalesce(max(c) FILTER (indicator = '{n}'), 'YELLOW') AS {n}_c" for n in VOTES)} FROM s GROUP BY 1),
    v AS (SELECT *, round_even(round({' + '.join(f"CASE {n}_c WHEN 'GREEN' THEN 90.0 WHEN 'RED' THEN 15.0 ELSE 50.0 END * {wt}" for n, wt in VOTES.items())}, 6), 0) AS raw FROM w), p AS (SELECT *, least(raw, CASE WHEN error_c = 'RED' THEN 30.0 ELSE 100.0 END) AS position FROM v)
    SELECT date, raw, position, CASE WHEN position >= 80 THEN 'FULL' WHEN position >= 60 THEN 'HIGH' WHEN position >= 40 THEN 'HALF' WHEN position >= 20 THEN 'LOW' ELSE 'CASH' END AS level, {', '.join(f"{' + '.join(f'CAST({n}_c = {c!r} AS INTEGER)' for n in VOTES)} AS {c.lower()}s" for c in ('GREEN', 'YELLOW', 'RED'))} FROM p""",
)
def x7(spark: SparkSession, d: str) -> DataFrame:
    colours = x11(spark, d).where("colour IS NOT NULL").select("date", "indicator", "colour")
    return macro.position_vote(colours, VOTES, {("error", "RED"): 30.0}, {"GREEN": 90.0, "YELLOW": 50.0, "RED": 15.0})


@query(
    "x20_pair_strength",
    """WITH q AS (SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS minute, event_type, round(avg(value), 4) AS price FROM events GROUP BY 1, 2, 3), c AS (SELECT date, minute, event_type, (price - first_value(price) OVER w) * 100 / first_value(price) OVER w AS c FROM q WINDOW w AS (PARTITION BY event_type, date ORDER BY minute ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT a.date, a.minute, round(a.c - b.c, 4) AS strength FROM c a JOIN c b ON a.date = b.date AND a.minute = b.minute WHERE a.event_type = 'click' AND b.event_type = 'view') SELECT *, round(avg(strength) OVER (PARTITION BY date ORDER BY minute ROWS 2 PRECEDING), 6) AS smoothed, CASE WHEN strength > 0 THEN 'red' WHEN strength < 0 THEN 'green' ELSE 'grey' END AS colour FROM s""",
)
def x20(spark: SparkSession, d: str) -> DataFrame:
    events = adapters.table(spark, d, "events")
    one = lambda kind: events.where(F.col("event_type") == kind).groupBy(F.col("ts").cast("date").alias("date"), F.hour("ts").alias("minute")).agg(F.round(F.avg("value"), 4).alias("price"))
    return macro.pair_strength(one("click"), one("view"))


# Audits -------------------------------------------------------------------------------------------

_KLINE = """WITH a AS (SELECT *, CASE WHEN lead(date, 4) OVER w - date <= 30 THEN date END AS dense FROM sparse WINDOW w AS (PARTITION BY stock_id ORDER BY date)), a2 AS (SELECT *, min(dense) OVER (PARTITION BY stock_id) AS start FROM a),
  p1 AS (SELECT stock_id, date, 'early' AS reason FROM a2 WHERE start IS NOT NULL AND date < start), l1 AS (SELECT * FROM a2 WHERE start IS NULL OR date >= start),
  b AS (SELECT *, coalesce(coalesce(date - lag(date) OVER w, 1000000) > 60 AND lead(date) OVER w - date > 60 AND count(*) OVER (PARTITION BY stock_id) >= 3, false) AS lone FROM l1 WINDOW w AS (PARTITION BY stock_id ORDER BY date)),
  p2 AS (SELECT stock_id, date, 'isolated' AS reason FROM b WHERE lone), l2 AS (SELECT *, count(*) OVER s AS n, min(date) OVER s AS d0, max(date) OVER s AS d1 FROM b WHERE NOT lone AND volume > 0 WINDOW s AS (PARTITION BY stock_id, open_price, high_price, low_price, close_price, volume))
  SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT stock_id, date, 'frozen' FROM l2 WHERE n >= 2 AND d1 - d0 >= 30 AND date < d1"""


@query("x12_clean_kline", _KLINE)
def x12(spark: SparkSession, d: str) -> DataFrame:
    return quality.clean_kline(adapters.daily_prices_sparse(spark, d), repeats=2)


_ADJ = """SELECT *, row_number() OVER w AS rn, lag(a) OVER w AS pa FROM (SELECT *, last_value(close_price) OVER (PARTITION BY stock_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  / exp(coalesce(sum(ln(CASE WHEN 1 + coalesce(change_pct, 0) / 100 > 0 THEN 1 + coalesce(change_pct, 0) / 100 ELSE 1 END)) OVER (PARTITION BY stock_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS a FROM bars) WINDOW w AS (PARTITION BY stock_id ORDER BY date)"""
_REAL = "length(stock_id) = 4 AND regexp_matches(stock_id, '^[1-9]')"
_STRANGE = "SELECT stock_id, max(date) AS d FROM flows WHERE stock_id NOT IN (SELECT stock_id FROM instruments) GROUP BY 1"
_CHECKS = {
    "q1_null_close": "SELECT count(*) FROM b WHERE close_price IS NULL", "q2_close_not_positive": "SELECT count(*) FROM b WHERE close_price <= 0", "q3_no_volume": "SELECT count(*) FROM b WHERE coalesce(volume, 0) = 0", "q4_large_change": f"SELECT count(*) FROM b WHERE abs(change_pct) > 11 AND rn > 5 AND {_REAL}",
    "q5_adjusted_drift": "SELECT count(*) FROM b WHERE pa > 0 AND abs((a / pa - 1) * 100 - change_pct) > 5", "q6_adjusted_missing": "SELECT count(*) FROM b WHERE a IS NULL", "q7_high_under_low": "SELECT count(*) FROM b WHERE high_price < low_price", "q8_all_zero_flows": "SELECT count(*) FROM flows WHERE foreign_buy = 0 AND sitc_buy = 0 AND dealer_buy = 0",
    "q9_no_volume_real": f"SELECT count(*) FROM b WHERE volume = 0 AND {_REAL}", "q10_duplicate_ids": "SELECT count(*) - count(DISTINCT stock_id) FROM instruments", "q11_orphan_bars": "SELECT count(DISTINCT stock_id) FROM bars WHERE stock_id NOT IN (SELECT stock_id FROM instruments)",
    "q12_unknown_recent": f"SELECT count(*) FROM ({_STRANGE}) WHERE d >= (SELECT max(date) FROM flows) - INTERVAL 6 MONTH", "q13_unknown_old": f"SELECT count(*) FROM ({_STRANGE}) WHERE d < (SELECT max(date) FROM flows) - INTERVAL 6 MONTH",
}


@query("x14_bar_checks", f"WITH b AS ({_ADJ}), c AS ({' UNION ALL '.join(f'SELECT {k!r} AS \"check\", ({v}) AS n' for k, v in _CHECKS.items())}) SELECT *, CASE WHEN n = 0 THEN 'ok' WHEN regexp_matches(\"check\", '^q(2|7|10)_') THEN 'error' ELSE 'warn' END AS severity FROM c")
def x14(spark: SparkSession, d: str) -> DataFrame:
    return quality.bar_checks(bars(spark, d), stocks(spark, d), net(spark, d))


@query("x14_coverage", "WITH last AS (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 10), k AS (SELECT count(*) AS stocks FROM instruments) SELECT date, count(*) AS n, any_value(stocks) AS stocks, round(count(*) * 100.0 / any_value(stocks), 2) AS coverage FROM bars, k WHERE date IN (SELECT date FROM last) AND close_price IS NOT NULL GROUP BY 1")
def x14c(spark: SparkSession, d: str) -> DataFrame:
    return quality.coverage(bars(spark, d), stocks(spark, d))


@query("x14_indicator_freshness", "SELECT indicator, count(*) AS n, max(date) AS last_date, CAST((SELECT max(date) FROM macro) - max(date) AS INTEGER) AS lag, CASE WHEN (SELECT max(date) FROM macro) - max(date) <= 1 THEN 'ok' WHEN (SELECT max(date) FROM macro) - max(date) <= 3 THEN 'warn' ELSE 'error' END AS status FROM macro GROUP BY 1")
def x14d(spark: SparkSession, d: str) -> DataFrame:
    return quality.indicator_freshness(adapters.macro_indicators(spark, d))


@query(
    "x14_freshness",
    "WITH cal AS (SELECT DISTINCT date FROM bars), t AS (SELECT 'bars' AS name, date FROM bars UNION ALL SELECT 'announcements', announce_date FROM disp UNION ALL SELECT 'indicators', date FROM macro), s AS (SELECT name, count(*) AS n, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS days FROM t GROUP BY 1), l AS (SELECT *, (SELECT count(*) FROM cal WHERE cal.date > s.last_date) AS lag FROM s) SELECT *, CASE WHEN lag <= 1 THEN 'ok' WHEN lag <= 3 THEN 'warn' ELSE 'error' END AS status FROM l",
)
def x14b(spark: SparkSession, d: str) -> DataFrame:
    prices = bars(spark, d)
    tables = {"bars": prices, "announcements": adapters.disposition_announcements(spark, d).withColumnRenamed("announce_date", "date"), "indicators": adapters.macro_indicators(spark, d)}
    return quality.freshness(tables, prices.select("date").distinct())


@query("x15_missing_dates", "SELECT CAST(x AS DATE) AS date, count(stock_id) AS n, CASE WHEN count(stock_id) = 0 THEN 'missing' ELSE 'partial' END AS kind FROM range(DATE '1998-01-01', DATE '1999-01-01', INTERVAL 1 DAY) t(x) LEFT JOIN sparse ON date = CAST(x AS DATE) WHERE isodow(x) <= 5 GROUP BY 1 HAVING count(stock_id) < 20")
def x15(spark: SparkSession, d: str) -> DataFrame:
    return quality.missing_dates(adapters.daily_prices_sparse(spark, d), quality.business_days(spark, "1998-01-01", "1998-12-31"), 20)


@query(
    "x10_credit_light",
    "WITH h AS (SELECT a.date, a.close_price / b.close_price AS ratio FROM bars a JOIN bars b ON a.date = b.date WHERE a.stock_id = '1' AND b.stock_id = '2'), r AS (SELECT date, ratio, list(ratio) OVER (ORDER BY date ROWS 188 PRECEDING) AS l FROM h), i AS (SELECT date, CASE WHEN len(l) >= 189 THEN 1 - (len(list_filter(l, lambda v: v < ratio)) + (len(list_filter(l, lambda v: v = ratio)) + 1) / 2.0) / len(l) END AS x FROM r), g AS (SELECT *, x - lag(x, 5) OVER (ORDER BY date) AS d FROM i), c AS (SELECT date, round(x, 4) AS indicator, CASE WHEN x IS NULL THEN NULL WHEN x < 0.28 THEN CASE WHEN coalesce(d > 0, false) AND x > 0.28 * 0.9 THEN 'YELLOW' ELSE 'GREEN' END WHEN x >= 0.32 THEN CASE WHEN coalesce(d < 0, false) AND x < 0.32 * 1.1 THEN 'YELLOW' ELSE 'RED' END WHEN coalesce(d > 0, false) THEN 'RED' WHEN coalesce(d < 0, false) THEN 'GREEN' ELSE 'YELLOW' END AS light FROM g) SELECT *, lag(light) OVER (ORDER BY date) AS signal FROM c",
)
def x10(spark: SparkSession, d: str) -> DataFrame:
    prices = bars(spark, d)
    one = lambda s, out: prices.where(F.col("stock_id") == s).select("date", F.col("close_price").alias(out))
    ratio = one("1", "a").join(one("2", "b"), "date").select(F.lit("credit").alias("series"), "date", (F.col("a") / F.col("b")).alias("ratio"))
    ranked = technical.rolling_percentile(ratio, "ratio", 189, "mean", key="series").withColumn("x", 1 - F.col("pctile"))
    return technical.traffic_light(ranked, "x").select("date", F.round("x", 4).alias("indicator"), "light", "signal")


_LIGHTED = "".join(ORACLES["x10_credit_light"].partition("h AS (SELECT a.date")[1:])


@query(
    "x10_credit_backtest",
    f"""WITH credit AS (WITH {_LIGHTED}), k AS (SELECT c.date, close_price / lag(close_price) OVER w - 1 AS r, CASE WHEN signal = 'GREEN' THEN 1.0 ELSE 0.0 END AS p FROM credit c JOIN bars b ON c.date = b.date AND b.stock_id = '1' WHERE signal IS NOT NULL WINDOW w AS (ORDER BY c.date)),
    x AS (SELECT date, p, coalesce(r * p - 0.00005 * abs(p - lag(p) OVER (ORDER BY date)), 0) AS strat, coalesce(r, 0) AS bh FROM k), u AS (SELECT date, p, 'strat' AS strategy, strat AS ret FROM x UNION ALL SELECT date, p, 'bh', bh FROM x),
    e AS (SELECT *, product(1 + ret) OVER (PARTITION BY strategy ORDER BY date) AS equity FROM u), f AS (SELECT *, equity / max(equity) OVER (PARTITION BY strategy ORDER BY date) - 1 AS fall FROM e),
    a AS (SELECT strategy, count(*) AS n, pow(arg_max(equity, date), 252.0 / count(*)) - 1 AS c, stddev_samp(ret) AS sd, avg(ret) AS mean, min(fall) AS mdd, avg(p) AS tim FROM f GROUP BY 1 HAVING count(*) >= 40)
    SELECT 'credit' AS series, strategy, n, round(c, 4) AS cagr, round(sd * sqrt(252.0), 4) AS vol, CASE WHEN sd > 0 THEN round(mean * sqrt(252.0) / sd, 4) ELSE 0.0 END AS sharpe, round(mdd, 4) AS max_drawdown, CASE WHEN mdd <> 0 THEN round(c / abs(mdd), 4) ELSE 0.0 END AS calmar, round(tim, 4) AS time_in_market FROM a""",
)
def x10b(spark: SparkSession, d: str) -> DataFrame:
    """The credit light followed on the same day against holding instrument 1; 40 rows are enough for weekly bars."""
    price = bars(spark, d).where(F.col("stock_id") == "1").select("date", "close_price")
    rows = x10(spark, d).where("signal IS NOT NULL").join(price, "date").withColumn("series", F.lit("credit"))
    return technical.light_backtest(rows, least=40)
