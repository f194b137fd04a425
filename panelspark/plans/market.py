"""Queries of flows, holders, brokers, breadth, options and futures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import derivatives, flows
from panelspark.sources import adapters

from .registry import query
from .series import rounded

bars, stocks, net = adapters.daily_prices, adapters.instruments, adapters.institutional

_RANK = """WITH dates AS (SELECT DISTINCT date FROM flows{asof} ORDER BY date DESC LIMIT {n}), s AS (SELECT f.stock_id, CAST(sum({col}) AS BIGINT) AS net FROM flows f WHERE date IN (SELECT date FROM dates) GROUP BY 1),
  j AS (SELECT s.stock_id, net, name, market FROM s JOIN instruments i ON s.stock_id = i.stock_id{market}), c AS (SELECT stock_id, arg_max(close_price, date) AS last_close FROM bars GROUP BY 1),
  u AS ((SELECT *, 'buy' AS side FROM j WHERE net > 0 ORDER BY net DESC, stock_id LIMIT {k}) UNION ALL (SELECT *, 'sell' AS side FROM j WHERE net < 0 ORDER BY net, stock_id LIMIT {k}))
  SELECT u.*, last_close FROM u LEFT JOIN c USING (stock_id)"""


@query("a1_flow_ranking", _RANK.format(asof="", n=5, col="foreign_buy", market="", k=50))
def a1(spark: SparkSession, d: str) -> DataFrame:
    return flows.flow_ranking(net(spark, d), stocks(spark, d), bars(spark, d), "foreign_buy")


@query("a1_flow_ranking_asof", _RANK.format(asof=" WHERE date <= DATE '1999-06-30'", n=20, col="total_buy", market=" WHERE market = 'twse'", k=10))
def a1b(spark: SparkSession, d: str) -> DataFrame:
    return flows.flow_ranking(net(spark, d), stocks(spark, d), bars(spark, d), "total_buy", 20, "1999-06-30", "twse", 10)


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in flows.INVESTORS)


@query("a2_flow_totals", f"SELECT f.date, market, {_SUMS}, CAST(sum(total_buy) AS BIGINT) AS total_buy FROM flows f JOIN instruments i ON f.stock_id = i.stock_id WHERE f.date IN (SELECT DISTINCT date FROM flows ORDER BY date DESC LIMIT 20) GROUP BY 1, 2")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return flows.flow_totals(net(spark, d), stocks(spark, d))


@query("a3_sector_summary", "SELECT sector, count(*) AS n, round(avg(change_pct), 2) AS avg_change, count(*) FILTER (change_pct > 0) AS up, count(*) FILTER (change_pct < 0) AS down FROM bars b JOIN instruments i ON b.stock_id = i.stock_id WHERE date = (SELECT max(date) FROM bars) AND trim(sector) <> '' GROUP BY 1")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return flows.sector_summary(bars(spark, d), stocks(spark, d))


def _regime(adr: str) -> str:
    return f"CASE WHEN {adr} > 2 THEN 'STRONG_BULL' WHEN {adr} > 1 THEN 'BULL' WHEN {adr} > 0.8 THEN 'NEUTRAL' WHEN {adr} > 0.5 THEN 'BEAR' ELSE 'CRASH' END"


_LAYER = f"""SELECT *, round(adr / (adr + 1), 4) AS score, {_regime("adr")} AS regime FROM (SELECT *, n - adv - dec AS unchanged, CASE WHEN dec > 0 THEN round(adv / dec, 3) WHEN adv > 0 THEN 10.0 ELSE 1.0 END AS adr
  FROM (SELECT date, count(*) AS n, count(*) FILTER (coalesce(change_pct, 0) > 0.1) AS adv, count(*) FILTER (coalesce(change_pct, 0) < -0.1) AS dec, count(*) FILTER (coalesce(change_pct, 0) >= 9.5) AS limit_up, count(*) FILTER (coalesce(change_pct, 0) <= -9.5) AS limit_down FROM bars b JOIN instruments i ON b.stock_id = i.stock_id WHERE market = 'twse' AND close_price IS NOT NULL AND volume > 0 GROUP BY 1))"""


@query("a4_breadth_layer", _LAYER)
def a4(spark: SparkSession, d: str) -> DataFrame:
    return flows.breadth_layer(bars(spark, d).join(stocks(spark, d).where("market = 'twse'"), "stock_id"))


def _layer(name: str, inside: str) -> str:
    return ", ".join(f"count(*) FILTER (({inside}) AND {cond}) AS {name}_{what}" for what, cond in (("adv", "chg > 0.1"), ("dec", "chg < -0.1"), ("limit_up", "chg >= 9.5"), ("limit_down", "chg <= -9.5")))


_ADR = "CASE WHEN {0}_dec > 0 THEN round({0}_adv / {0}_dec, 3) WHEN {0}_adv > 0 THEN 10.0 ELSE 1.0 END AS {0}_adr"
_BREADTH = f"""WITH r AS (SELECT b.*, coalesce(change_pct, 0.0) AS chg, row_number() OVER (PARTITION BY date ORDER BY trade_value DESC NULLS LAST, b.stock_id) AS v, row_number() OVER (PARTITION BY date ORDER BY volume DESC NULLS LAST, b.stock_id) AS q FROM bars b JOIN instruments i ON b.stock_id = i.stock_id WHERE close_price IS NOT NULL AND volume > 0),
  p AS (SELECT date, count(*) AS n, {_layer("layer", "v <= 200")}, {_layer("hot", "v <= 100 OR q <= 100")}, {_layer("full", "true")} FROM r GROUP BY 1),
  a AS (SELECT *, {", ".join(_ADR.format(x) for x in ("layer", "hot", "full"))} FROM p),
  s AS (SELECT *, {", ".join(f"round({x}_adr / ({x}_adr + 1), 4) AS {x}_score" for x in ("layer", "hot", "full"))} FROM a),
  t AS (SELECT *, {", ".join(f"{_regime(x + '_adr')} AS {x}_regime" for x in ("layer", "hot", "full"))}, round(round(layer_score * 0.4 + hot_score * 0.3 + full_score * 0.3, 8), 4) AS score, {" + ".join(f"CAST({x}_score > 0.55 AS INTEGER)" for x in ("layer", "hot", "full"))} AS vote_bull, {" + ".join(f"CAST({x}_score < 0.45 AS INTEGER)" for x in ("layer", "hot", "full"))} AS vote_bear FROM s),
  breadth AS (SELECT *, CASE WHEN vote_bull = 3 AND score > 0.65 THEN 'STRONG_BULL' WHEN vote_bear = 3 AND score < 0.35 THEN 'CRASH' WHEN vote_bull >= 2 AND score > 0.55 THEN 'BULL' WHEN vote_bear >= 2 AND score < 0.45 THEN 'BEAR' ELSE 'NEUTRAL' END AS regime FROM t)"""


@query("a5_breadth_daily", f"{_BREADTH} SELECT * FROM breadth")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return flows.breadth_daily(bars(spark, d), stocks(spark, d))


@query("a6_breadth_full_market", "SELECT *, round(adr / (adr + 1), 4) AS score FROM (SELECT *, CASE WHEN dec > 0 THEN round(adv / dec, 3) WHEN adv > 0 THEN 10.0 ELSE 1.0 END AS adr FROM (SELECT date, count(*) FILTER (change_pct > 0.1) AS adv, count(*) FILTER (change_pct < -0.1) AS dec, count(*) FILTER (change_pct BETWEEN -0.1 AND 0.1) AS flat FROM bars GROUP BY 1))")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return flows.breadth_full_market(bars(spark, d))


_GROUPS = """SELECT stock_id, sca_date, round(coalesce(sum(pct) FILTER (band BETWEEN 1 AND 3), 0), 4) AS retail, round(coalesce(sum(pct) FILTER (band BETWEEN 4 AND 10), 0), 4) AS mid, round(coalesce(sum(pct) FILTER (band BETWEEN 11 AND 14), 0), 4) AS big,
  round(coalesce(sum(pct) FILTER (band = 15), 0), 4) AS giant, max(holders) FILTER (contains(band_label, '合')) AS holders FROM holders GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY sca_date DESC) <= 52"""


@query("a10_concentration", _GROUPS)
def a10(spark: SparkSession, d: str) -> DataFrame:
    return flows.concentration(adapters.holder_distribution(spark, d))


@query(
    "a11_concentration_change",
    """WITH ds AS (SELECT DISTINCT sca_date FROM holders), n AS (SELECT max(sca_date) AS x FROM ds), t AS (SELECT sca_date AS x FROM ds ORDER BY 1 DESC LIMIT 1 OFFSET 4),
    p AS (SELECT stock_id, sum(coalesce(pct, 0)) FILTER (sca_date = (SELECT x FROM n)) AS a, sum(coalesce(pct, 0)) FILTER (sca_date = (SELECT x FROM t)) AS b FROM holders WHERE band BETWEEN 11 AND 15 GROUP BY 1),
    q AS (SELECT stock_id, round(a, 4) AS pct_now, round(b, 4) AS pct_then, round(a - b, 4) AS delta FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
    (SELECT *, 'buy' AS side FROM q ORDER BY delta DESC, stock_id LIMIT 50) UNION ALL (SELECT *, 'sell' AS side FROM q ORDER BY delta, stock_id DESC LIMIT 50)""",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    return flows.concentration_change(adapters.holder_distribution(spark, d))


@query("a12_broker_top", "SELECT * FROM (SELECT *, CASE WHEN net_volume > 0 THEN 'buy' ELSE 'sell' END AS side, row_number() OVER (PARTITION BY stock_id, date, net_volume > 0 ORDER BY abs(net_volume) DESC, broker_name) AS rank FROM brokers WHERE net_volume <> 0) WHERE rank <= 15")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return flows.broker_top(adapters.broker_trades(spark, d))


@query("a13_dataset_profile", "SELECT market, count(*) AS n, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS days, count(DISTINCT b.stock_id) AS stocks FROM bars b JOIN instruments i ON b.stock_id = i.stock_id GROUP BY 1")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return flows.dataset_profile(bars(spark, d).join(stocks(spark, d), "stock_id"), ["market"])


_FM = "FROM flows f JOIN instruments i ON f.stock_id = i.stock_id"


@query("a14_coverage_pivot", f"SELECT year(date) AS year, {', '.join(f'count(DISTINCT date) FILTER (market = {m!r}) AS {m}_days, count(DISTINCT f.stock_id) FILTER (market = {m!r}) AS {m}_stocks' for m in ('tpex', 'twse'))} {_FM} GROUP BY 1")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return flows.coverage_pivot(net(spark, d), stocks(spark, d))


@query("a15_stocks_index", f"SELECT f.stock_id, name, market, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS days, {_SUMS} {_FM} GROUP BY 1, 2, 3")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return flows.stocks_index(net(spark, d), stocks(spark, d))


@query("a16_trading_calendar", f"SELECT date, count(*) FILTER (market = 'twse') AS twse_rows, count(*) FILTER (market = 'tpex') AS tpex_rows, year(date) AS year, month(date) AS month, isodow(date) - 1 AS weekday {_FM} GROUP BY date")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return flows.trading_calendar(net(spark, d), stocks(spark, d))


def _wall(cp: str, name: str) -> str:
    return f"coalesce((SELECT strike FROM options o WHERE o.date = k.date AND o.contract = k.contract AND cp = '{cp}' ORDER BY oi DESC, strike LIMIT 1), 0.0) AS {name}"


_WALLS = f"""walls AS (SELECT date, contract, {_wall("C", "resistance")}, {_wall("P", "support")}, call_total, put_total, expiry, CASE WHEN call_total > 0 THEN round(put_total / call_total, 4) ELSE 0.0 END AS pc_ratio
  FROM (SELECT date, contract, CAST(coalesce(sum(oi) FILTER (cp = 'C'), 0) AS BIGINT) AS call_total, CAST(coalesce(sum(oi) FILTER (cp = 'P'), 0) AS BIGINT) AS put_total, max(expiry) AS expiry FROM options GROUP BY 1, 2) k)"""


@query("a17_option_walls", f"WITH {_WALLS} SELECT * FROM walls")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return derivatives.option_walls(adapters.option_daily(spark, d))


_PAIN = """strikes AS (SELECT DISTINCT date, contract, strike FROM options), pains AS (SELECT k.date, k.contract, k.strike, sum(CASE WHEN cp = 'C' THEN oi * greatest(k.strike - o.strike, 0) ELSE oi * greatest(o.strike - k.strike, 0) END) AS pain
  FROM strikes k JOIN options o ON k.date = o.date AND k.contract = o.contract GROUP BY 1, 2, 3), pain AS (SELECT date, contract, strike AS max_pain, pain FROM (SELECT *, row_number() OVER (PARTITION BY date, contract ORDER BY pain, strike) AS rn FROM pains) WHERE rn = 1)"""


@query("a18_max_pain", f"WITH {_PAIN} SELECT * FROM pain")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return derivatives.max_pain(adapters.option_daily(spark, d))


@query(
    "a19_option_chain",
    f"""WITH {_WALLS}, {_PAIN}, sides AS (SELECT date, contract, strike, CAST(sum(oi) FILTER (cp = 'C') AS BIGINT) AS call_oi, CAST(sum(oi) FILTER (cp = 'P') AS BIGINT) AS put_oi FROM options GROUP BY 1, 2, 3)
    SELECT s.*, CAST(strike = resistance AS INTEGER) AS is_resistance, CAST(strike = support AS INTEGER) AS is_support, CAST(strike = max_pain AS INTEGER) AS is_max_pain FROM sides s JOIN walls w ON s.date = w.date AND s.contract = w.contract JOIN pain p ON s.date = p.date AND s.contract = p.contract""",
)
def a19(spark: SparkSession, d: str) -> DataFrame:
    return derivatives.option_chain(adapters.option_daily(spark, d))


@query("a17_default_contract", "SELECT date, coalesce((SELECT contract FROM options b WHERE b.date = a.date AND b.expiry >= b.date ORDER BY expiry, contract LIMIT 1), (SELECT contract FROM options b WHERE b.date = a.date ORDER BY expiry DESC, contract DESC LIMIT 1)) AS contract FROM (SELECT DISTINCT date FROM options) a")
def a17b(spark: SparkSession, d: str) -> DataFrame:
    return derivatives.default_contract(adapters.option_daily(spark, d))


@query(
    "a20_large_trader_net",
    """WITH p AS (SELECT date, product_code, max(top10_buy) FILTER (trader_type = 0) AS b0, max(top10_buy) FILTER (trader_type = 1) AS b1, max(top10_sell) FILTER (trader_type = 0) AS s0, max(top10_sell) FILTER (trader_type = 1) AS s1, max(top5_buy) FILTER (trader_type = 0) AS b5, max(top5_sell) FILTER (trader_type = 0) AS s5, max(market_oi) FILTER (trader_type = 0) AS oi FROM ltrader GROUP BY 1, 2),
    r AS (SELECT p.*, m.stock_id, is_mini, lots_per_contract AS lots, (b0 - coalesce(b1, 0)) - (s0 - coalesce(s1, 0)) AS net FROM p JOIN fmap m ON p.product_code = m.product_code WHERE b0 IS NOT NULL),
    g AS (SELECT stock_id, date, round(sum(net * lots), 1) AS net_lots, CAST(sum(CASE WHEN is_mini = 0 THEN net ELSE 0 END) AS BIGINT) AS main_net, CAST(sum(CASE WHEN is_mini = 1 THEN net ELSE 0 END) AS BIGINT) AS mini_net,
      first({'code': product_code, 'b5': b5, 's5': s5, 'b': b0, 's': s0, 'net': net, 'oi': oi} ORDER BY is_mini, oi * lots DESC, product_code DESC) AS m FROM r GROUP BY 1, 2)
    SELECT stock_id, date, net_lots, main_net, mini_net, m.code AS main_code, m.oi AS market_oi, CASE WHEN m.oi > 0 THEN round(m.b5 * 100 / m.oi, 2) END AS top5_buy_pct, CASE WHEN m.oi > 0 THEN round(m.s5 * 100 / m.oi, 2) END AS top5_sell_pct, CASE WHEN m.oi > 0 THEN round(m.b * 100 / m.oi, 2) END AS top10_buy_pct,
      CASE WHEN m.oi > 0 THEN round(m.s * 100 / m.oi, 2) END AS top10_sell_pct, CASE WHEN m.oi > 0 THEN round((m.b - m.s) * 100 / m.oi, 2) END AS net_pct, CASE WHEN m.oi > 0 THEN round(m.net * 100 / m.oi, 2) END AS big_net_pct FROM g QUALIFY dense_rank() OVER (PARTITION BY stock_id ORDER BY date DESC) <= 20""",
)
def a20(spark: SparkSession, d: str) -> DataFrame:
    return derivatives.large_trader_net(adapters.futures_large_trader(spark, d), adapters.stock_futures_map(spark, d))


def positions(spark: SparkSession, d: str) -> DataFrame:
    """Long and short interest per date, investor class and option side, from monthly line items."""
    name = F.create_map(*[F.lit(x) for kv in (("R", "外資及陸資"), ("A", "投信"), ("N", "自營商")) for x in kv])
    rows = adapters.table(spark, d, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("date"), name[F.col("l_returnflag")].alias("investor"), F.when(F.col("l_linenumber") % 2 == 0, "C").otherwise("P").alias("cp"))
    return rows.agg(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0)).cast("long").alias("long_oi"), F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0)).cast("long").alias("short_oi"))


_POSN = """WITH pn AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CASE l_returnflag WHEN 'R' THEN '外資及陸資' WHEN 'A' THEN '投信' WHEN 'N' THEN '自營商' END AS investor, CASE WHEN l_linenumber % 2 = 0 THEN 'C' ELSE 'P' END AS cp,
  CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS BIGINT) AS long_oi, CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS BIGINT) AS short_oi FROM lineitem GROUP BY 1, 2, 3)"""


@query("a21_futures_oi_net", f"{_POSN} SELECT date, {', '.join(f'CAST(coalesce(sum(long_oi - short_oi) FILTER (contains(investor, {w!r})), 0) AS BIGINT) AS {n}' for w, n in (('外資', 'foreign_net'), ('投信', 'sitc_net'), ('自營', 'dealer_net')))}, CAST(sum(long_oi - short_oi) AS BIGINT) AS total_net FROM pn GROUP BY 1")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return derivatives.futures_oi_net(positions(spark, d))


@query("a22_retail_ratio", f"{_POSN} SELECT n.date, coalesce(oi, 0) AS oi, CASE WHEN coalesce(oi, 0) > 0 THEN round(-net * 100 / oi, 2) ELSE 0.0 END AS retail_ratio FROM (SELECT date, CAST(sum(long_oi - short_oi) AS BIGINT) AS net FROM pn GROUP BY 1) n LEFT JOIN (SELECT date, CAST(sum(oi) AS BIGINT) AS oi FROM options WHERE cp = 'C' AND oi > 0 GROUP BY 1) o ON n.date = o.date")
def a22(spark: SparkSession, d: str) -> DataFrame:
    daily = adapters.option_daily(spark, d).withColumn("session", F.when(F.col("cp") == "C", "position").otherwise("after_hours"))
    return derivatives.retail_ratio(positions(spark, d), daily)


@query("a23_put_call_ratio", f"{_POSN} SELECT *, CASE WHEN calls > 0 THEN round(puts / calls, 4) ELSE 0.0 END AS ratio FROM (SELECT date, CAST(coalesce(sum(long_oi + short_oi) FILTER (cp = 'P'), 0) AS BIGINT) AS puts, CAST(coalesce(sum(long_oi + short_oi) FILTER (cp = 'C'), 0) AS BIGINT) AS calls FROM pn GROUP BY 1)")
def a23(spark: SparkSession, d: str) -> DataFrame:
    return derivatives.put_call_ratio(positions(spark, d))


@query(
    "a27_inst_cost_vwap",
    """WITH r AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) <= 20), j AS (SELECT r.stock_id, (high_price + low_price) / 2 AS mid, foreign_buy, sitc_buy, dealer_buy FROM r JOIN flows f ON r.stock_id = f.stock_id AND r.date = f.date),
    l AS (UNPIVOT j ON foreign_buy, sitc_buy, dealer_buy INTO NAME investor VALUE net) SELECT stock_id, investor, round(sum(mid * net) / sum(net), 6) AS cost, count(*) AS days_buying FROM l WHERE net > 0 GROUP BY 1, 2""",
)
def a27(spark: SparkSession, d: str) -> DataFrame:
    return flows.inst_cost_vwap(bars(spark, d), net(spark, d))


@query("a28_flow_totals_20", f"SELECT stock_id, {_SUMS} FROM (SELECT * FROM flows QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) <= 20) GROUP BY 1")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return flows.flow_totals_per_stock(net(spark, d))


@query("a30_quality_extremes", "WITH l AS (UNPIVOT (SELECT stock_id, date, foreign_buy, sitc_buy, dealer_buy FROM flows) ON foreign_buy, sitc_buy, dealer_buy INTO NAME measure VALUE value) SELECT *, row_number() OVER (PARTITION BY measure ORDER BY abs(value) DESC, stock_id, date) AS rank FROM l QUALIFY rank <= 5")
def a30(spark: SparkSession, d: str) -> DataFrame:
    return flows.quality_extremes(net(spark, d))


@query("a31_rollup_profile", f"SELECT market, year(date) AS year, count(*) AS n, count(DISTINCT f.stock_id) AS stocks, CAST(sum(total_buy) AS BIGINT) AS total_buy, CAST(grouping_id(market, year(date)) AS INTEGER) AS level {_FM} GROUP BY ROLLUP (market, year(date))")
def a31(spark: SparkSession, d: str) -> DataFrame:
    return flows.rollup_profile(net(spark, d), stocks(spark, d))


@query("a32_recent_dates", "SELECT DISTINCT date FROM flows ORDER BY date DESC LIMIT 10 OFFSET 4")
def a32(spark: SparkSession, d: str) -> DataFrame:
    return flows.recent_dates(net(spark, d), 10, offset=4)


@query("t3_heat_map", "SELECT b.*, name, market, sector, row_number() OVER (PARTITION BY sector ORDER BY volume DESC, b.stock_id) AS rank FROM bars b JOIN instruments i ON b.stock_id = i.stock_id WHERE date = (SELECT max(date) FROM bars) QUALIFY rank <= 10")
def t3(spark: SparkSession, d: str) -> DataFrame:
    return flows.heat_map(bars(spark, d), stocks(spark, d))


_LIM = "SELECT b.stock_id, date, change_pct, net FROM bars b JOIN (SELECT stock_id, CAST(sum(foreign_buy) AS BIGINT) AS net FROM flows WHERE date >= (SELECT max(date) FROM bars) - 5 GROUP BY 1) s ON b.stock_id = s.stock_id WHERE date = (SELECT max(date) FROM bars)"


@query("t7_limit_anomalies", f"(SELECT *, 'up_sold' AS kind FROM ({_LIM}) WHERE change_pct >= 9.5 AND net < 0 ORDER BY net, stock_id LIMIT 15) UNION ALL (SELECT *, 'down_bought' AS kind FROM ({_LIM}) WHERE change_pct <= -9.5 AND net > 0 ORDER BY net DESC, stock_id LIMIT 15)")
def t7(spark: SparkSession, d: str) -> DataFrame:
    return flows.limit_anomalies(bars(spark, d), net(spark, d))


@query("p5_consensus_buying", "SELECT * FROM flows WHERE foreign_buy > 0 AND sitc_buy > 0 AND dealer_buy > 0")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return net(spark, d).where("foreign_buy > 0 AND sitc_buy > 0 AND dealer_buy > 0")


@query("p8_enrich_dates", "SELECT *, year(date) AS year, month(date) AS month, quarter(date) AS quarter, isodow(date) - 1 AS weekday, CASE WHEN abs(foreign_buy) = greatest(abs(foreign_buy), abs(sitc_buy), abs(dealer_buy)) THEN 'foreign' WHEN abs(sitc_buy) = greatest(abs(foreign_buy), abs(sitc_buy), abs(dealer_buy)) THEN 'sitc' ELSE 'dealer' END AS dominant FROM flows")
def p8(spark: SparkSession, d: str) -> DataFrame:
    return flows.enrich_dates(net(spark, d))


@query("x13_clean_flows", "SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(w) AS BIGINT) AS formula_errors, CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(u) AS BIGINT) AS nulls, CAST(sum(i) AS BIGINT) AS bad_ids, CAST(sum(z) AS BIGINT) AS all_zero FROM (SELECT count(*) AS n, count(*) FILTER (total_buy <> foreign_buy + sitc_buy + dealer_buy) AS w, count(*) FILTER (total_buy IS NULL) AS u, count(*) FILTER (NOT regexp_full_match(stock_id, '\\d{1,4}')) AS i, count(*) FILTER (foreign_buy = 0 AND sitc_buy = 0 AND dealer_buy = 0) AS z FROM flows GROUP BY stock_id, date)")
def x13(spark: SparkSession, d: str) -> DataFrame:
    return flows.clean_flows(net(spark, d))


@query("s14_flow_package", f"SELECT date, market, f.stock_id, name, {', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in (*flows.INVESTORS, 'total_buy'))} {_FM} WHERE foreign_buy <> 0 OR sitc_buy <> 0 OR dealer_buy <> 0")
def s14(spark: SparkSession, d: str) -> DataFrame:
    return flows.export_flow_package(net(spark, d), stocks(spark, d))


_DISP_NOW = "SELECT DISTINCT stock_id FROM disp WHERE period_start <= DATE '2000-01-03' AND period_end >= DATE '2000-01-03'"


@query(
    "x6_futures_basis",
    f"""WITH fut AS (SELECT m.stock_id, p_brand AS product_code, round(avg(100 + 1.2 * (l_quantity - 25)), 2) AS price, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey JOIN fmap m ON m.product_code = p_brand GROUP BY 1, 2),
    near AS (SELECT * FROM fut QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY volume DESC, product_code DESC) = 1), live AS (SELECT CAST(user_id AS VARCHAR) AS stock_id, arg_max(value, row(ts, event_id)) AS price FROM events WHERE user_id % 2 = 0 GROUP BY 1),
    lastc AS (SELECT stock_id, arg_max(close_price, date) AS last_close FROM bars GROUP BY 1),
    j AS (SELECT n.stock_id, name, product_code, n.price AS futures_price, coalesce(l.price, last_close) AS spot, CAST(l.price IS NULL AS INTEGER) AS spot_stale, CAST(r.stock_id IS NOT NULL AS INTEGER) AS restricted FROM near n LEFT JOIN live l USING (stock_id) LEFT JOIN lastc USING (stock_id) LEFT JOIN instruments i USING (stock_id) LEFT JOIN ({_DISP_NOW}) r ON n.stock_id = r.stock_id)
    SELECT *, round(futures_price - spot, 4) AS basis, CASE WHEN spot <> 0 THEN round(round(futures_price - spot, 4) * 100 / spot, 2) END AS basis_pct, CASE WHEN spot IS NULL THEN 'no_spot' WHEN round(futures_price - spot, 4) > 0 THEN 'contango' WHEN round(futures_price - spot, 4) < 0 THEN 'backwardation' ELSE 'flat' END AS status FROM j""",
)
def x6(spark: SparkSession, d: str) -> DataFrame:
    lineitem, part = adapters.table(spark, d, "lineitem"), adapters.table(spark, d, "part").select("p_partkey", "p_brand")
    per = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("product_code")).agg(F.round(F.avg(100 + 1.2 * (F.col("l_quantity") - 25)), 2).alias("price"), F.sum("l_quantity").cast("long").alias("volume"))
    futures = per.join(adapters.stock_futures_map(spark, d), "product_code").select("stock_id", "product_code", "price", "volume")
    live = adapters.table(spark, d, "events").where("user_id % 2 = 0").groupBy(F.col("user_id").cast("string").alias("stock_id")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"))
    day = F.lit("2000-01-03").cast("date")
    restricted = adapters.disposition_announcements(spark, d).where((F.col("period_start") <= day) & (F.col("period_end") >= day)).select("stock_id")
    return derivatives.futures_basis(futures, live, bars(spark, d), stocks(spark, d), restricted)


@query(
    "x18_night_session_spread",
    """WITH q AS (SELECT CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linestatus = 'F' THEN 'day' ELSE 'night' END AS session, l_returnflag || CASE WHEN l_linenumber = 7 THEN '/' ELSE '' END AS contract, round(avg(100 + 1.2 * (l_quantity - 25)), 2) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY 1, 2, 3),
    b AS (SELECT * FROM q WHERE NOT contains(contract, '/') AND close > 0 QUALIFY row_number() OVER (PARTITION BY date, session ORDER BY volume DESC, contract DESC) = 1),
    t AS (SELECT date, max(close) FILTER (session = 'day') AS dc, max(close) FILTER (session = 'night') AS nc FROM b GROUP BY 1), u AS (SELECT *, last_value(dc IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS base FROM t)
    SELECT date, nc AS night_close, base AS day_close, round(nc - base, 4) AS spread, round((nc - base) * 100 / base, 2) AS spread_pct FROM u WHERE nc IS NOT NULL AND base IS NOT NULL""",
)
def x18(spark: SparkSession, d: str) -> DataFrame:
    contract = F.concat("l_returnflag", F.when(F.col("l_linenumber") == 7, "/").otherwise(""))
    rows = adapters.table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"), F.when(F.col("l_linestatus") == "F", "day").otherwise("night").alias("session"), contract.alias("contract")).agg(F.round(F.avg(100 + 1.2 * (F.col("l_quantity") - 25)), 2).alias("close"), F.sum("l_quantity").cast("long").alias("volume"))
    return derivatives.night_session_spread(rows)
