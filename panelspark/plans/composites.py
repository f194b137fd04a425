"""Queries of composite jobs: rate colours, the vote of six indicators, the stress index, pair strength, basis and option tables, lags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators import correlation, derivatives, flows, macro, margin, technical
from panelspark.sources import adapters

from .events import _AVG_COST, _MP, ASOF, screener, x10
from .market import _BREADTH, _PAIN, _WALLS, bars, net, stocks
from .registry import ORACLES, query
from .storage import stored

_RATES = """ranked AS (SELECT *, list(value) OVER (PARTITION BY indicator ORDER BY date ROWS 250 PRECEDING) AS l FROM macro5), places AS (SELECT date, indicator, value, CASE WHEN indicator = 'DOLLAR' THEN CASE WHEN len(l) >= 21 THEN round(len(list_filter(l, lambda v: v < value)) * 100.0 / len(l), 1) ELSE 50.0 END END AS pctile FROM ranked),
  rates AS (SELECT *, CASE indicator WHEN 'T10Y3M' THEN CASE WHEN value > 1.0 THEN 'GREEN' WHEN value > 0.0 THEN 'YELLOW' ELSE 'RED' END WHEN 'CP_SPREAD' THEN CASE WHEN value < 0.3 THEN 'GREEN' WHEN value < 0.8 THEN 'YELLOW' ELSE 'RED' END
    WHEN 'DOLLAR' THEN CASE WHEN pctile > 70 THEN 'RED' WHEN pctile < 30 THEN 'GREEN' ELSE 'YELLOW' END WHEN 'COR3M' THEN CASE WHEN value > 30 THEN 'RED' WHEN value < 20 THEN 'GREEN' ELSE 'YELLOW' END ELSE CASE WHEN value > 120 THEN 'RED' WHEN value < 80 THEN 'GREEN' ELSE 'YELLOW' END END AS colour FROM places)"""
_LIGHT = "".join(ORACLES["x10_credit_light"].partition("h AS (SELECT a.date")[1:])
_CREDIT = f"credit AS (WITH {_LIGHT})"
_SIX = _BREADTH + ", " + _RATES + ", " + _CREDIT


@query("x11_macro_rules", f"WITH {_RATES} SELECT * FROM rates")
def x11b(spark: SparkSession, d: str) -> DataFrame:
    return macro.rate_signals(adapters.rates(spark, d))


def _case(column: str, values: dict[str, float]) -> str:
    return f"CASE {column} {' '.join(f'WHEN {k!r} THEN {v}' for k, v in values.items())} ELSE 50.0 END"


_NAMES = list(macro.VOTE_WEIGHTS)
_COLOURED = {n: f"CASE WHEN {n} IN ('GREEN', 'STRONG_BULL', 'BULL') THEN 'GREEN' WHEN {n} IN ('RED', 'BEAR', 'CRASH') THEN 'RED' ELSE 'YELLOW' END" for n in _NAMES}


@query(
    "x7_position_vote_six",
    f"""{_SIX}, st AS (SELECT date, 'credit' AS k, signal AS s FROM credit WHERE signal IS NOT NULL UNION ALL SELECT date, 'breadth', regime FROM breadth UNION ALL SELECT date, indicator, colour FROM rates WHERE indicator <> 'MOVE'),
    wide AS (SELECT date, {', '.join(f"max(s) FILTER (k = '{n}') AS {n}" for n in _NAMES)} FROM st GROUP BY 1), f AS (SELECT date, {', '.join(f"last_value({n} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS {n}" for n in _NAMES)} FROM wide),
    v AS (SELECT *, round_even(round({' + '.join(f"{_case(n, macro.VOTE_POSITIONS[n])} * {w}" for n, w in macro.VOTE_WEIGHTS.items())}, 6), 0) AS raw FROM f),
    p1 AS (SELECT *, CASE WHEN credit = 'RED' THEN least(raw, 50.0) ELSE raw END AS a FROM v), p2 AS (SELECT *, CASE WHEN breadth = 'CRASH' THEN least(a, 30.0) ELSE a END AS b FROM p1), p3 AS (SELECT *, CASE WHEN T10Y3M = 'RED' THEN least(b, 50.0) ELSE b END AS c FROM p2), p4 AS (SELECT *, CASE WHEN CP_SPREAD = 'RED' THEN least(c, 40.0) ELSE c END AS position FROM p3)
    SELECT date, raw, position, concat_ws(',', CASE WHEN a < raw THEN 'credit' END, CASE WHEN b < a THEN 'breadth' END, CASE WHEN c < b THEN 'T10Y3M' END, CASE WHEN position < c THEN 'CP_SPREAD' END) AS capped_by, CASE WHEN position >= 80 THEN 'FULL' WHEN position >= 60 THEN 'HIGH' WHEN position >= 40 THEN 'HALF' WHEN position >= 20 THEN 'LOW' ELSE 'CASH' END AS level,
    {', '.join(f"{' + '.join(f'CAST({e} = {c!r} AS INTEGER)' for e in _COLOURED.values())} AS {c.lower()}s" for c in ('GREEN', 'YELLOW', 'RED'))} FROM p4""",
)
def x7b(spark: SparkSession, d: str) -> DataFrame:
    credit = x10(spark, d).where("signal IS NOT NULL").select("date", F.lit("credit").alias("indicator"), F.col("signal").alias("status"))
    breadth = flows.breadth_daily(bars(spark, d), stocks(spark, d)).select("date", F.lit("breadth").alias("indicator"), F.col("regime").alias("status"))
    rates = macro.rate_signals(adapters.rates(spark, d)).where("indicator <> 'MOVE'").select("date", "indicator", F.col("colour").alias("status"))
    return macro.six_vote(credit.unionByName(breadth).unionByName(rates))


PAIRS = [("credit", "breadth"), ("regime", "credit"), ("COR3M", "MOVE"), ("T10Y3M", "credit"), ("DOLLAR", "breadth")]
_SERIES = f"""{_SIX}, sr AS (SELECT date, 'credit' AS s, indicator AS v FROM credit WHERE indicator IS NOT NULL UNION ALL SELECT date, 'breadth', score FROM breadth UNION ALL SELECT date, 'regime', round(round(least(avg(high_price - low_price) / 20, 2.0), 10), 4) FROM bars GROUP BY 1 UNION ALL SELECT date, indicator, value FROM macro5),
  pr AS (SELECT a.s || ':' || b.s AS series, a.date, a.v AS x, b.v AS y FROM sr a JOIN sr b ON a.date = b.date WHERE (a.s, b.s) IN ({', '.join(map(str, PAIRS))})), big AS (SELECT *, count(*) OVER (PARTITION BY series) AS n0, row_number() OVER (PARTITION BY series ORDER BY date) AS i FROM pr)"""


def indicator_series(spark: SparkSession, d: str) -> DataFrame:
    """The eight series of the correlation job: date, series, value."""
    prices = bars(spark, d)
    one = lambda df, name, value: df.select("date", F.lit(name).alias("series"), value.alias("value")).where("value IS NOT NULL")
    rows = one(x10(spark, d), "credit", F.col("indicator")).unionByName(one(flows.breadth_daily(prices, stocks(spark, d)), "breadth", F.col("score")))
    error = prices.groupBy("date").agg(F.avg(F.col("high_price") - F.col("low_price")).alias("e"))
    rows = rows.unionByName(one(error, "regime", F.round(F.round(F.least(F.col("e") / 20, F.lit(2.0)), 10), 4)))
    return rows.unionByName(adapters.rates(spark, d).select("date", F.col("indicator").alias("series"), "value"))


_DIMENSIONS = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in correlation.DIMENSIONS.items()) + " END"
_READING = "CASE WHEN r IS NULL THEN '" + correlation.TOO_SHORT + "' " + " ".join(f"WHEN abs(r) >= {least} THEN replace('{text}', '{{}}', CASE WHEN r > 0 THEN '{correlation.POSITIVE}' ELSE '{correlation.NEGATIVE}' END)" for least, text in correlation.READINGS) + f" ELSE '{correlation.UNRELATED}' END"


@query(
    "x8_indicator_correlation",
    f"""{_SERIES}, c AS (SELECT a.s AS a, b.s AS b, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(CASE WHEN stddev_samp(a.v) = 0 OR stddev_samp(b.v) = 0 THEN 0 ELSE corr(a.v, b.v) END, 4) END AS r FROM sr a JOIN sr b ON a.date = b.date AND a.s < b.s GROUP BY 1, 2)
    SELECT a, b, n, r, CASE WHEN r IS NULL THEN NULL WHEN abs(r) >= 0.6 THEN 'high' WHEN abs(r) >= 0.3 THEN 'moderate' ELSE 'low' END AS bucket, {_READING} AS reading, {_DIMENSIONS.format('a')} IS NOT DISTINCT FROM {_DIMENSIONS.format('b')} AS same_dimension FROM c""",
)
def x8(spark: SparkSession, d: str) -> DataFrame:
    return correlation.correlation_matrix(indicator_series(spark, d))


@query(
    "x8_instrument_correlation",
    "SELECT a.stock_id AS a, b.stock_id AS b, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(CASE WHEN stddev_samp(a.change_pct) = 0 OR stddev_samp(b.change_pct) = 0 THEN 0 ELSE corr(a.change_pct, b.change_pct) END, 4) END AS r FROM bars a JOIN bars b ON a.date = b.date AND a.stock_id < b.stock_id WHERE a.change_pct IS NOT NULL AND b.change_pct IS NOT NULL GROUP BY 1, 2",
)
def x8d(spark: SparkSession, d: str) -> DataFrame:
    """Changes of all instruments against one another."""
    rows = stored(bars(spark, d).select("date", F.col("stock_id").alias("series"), F.col("change_pct").alias("value")))
    return correlation.pair_correlations(rows)


@query(
    "x8_lags",
    f"{_SERIES} SELECT a.series, CAST(k AS INTEGER) AS lag, count(*) AS n, round(coalesce(CASE WHEN isnan(corr(a.x, b.y)) THEN 0 ELSE corr(a.x, b.y) END, 0), 4) AS r FROM big a JOIN range(-5, 6) t(k) ON true JOIN big b ON a.series = b.series AND b.i = a.i + k WHERE a.n0 >= 10 GROUP BY 1, 2 HAVING count(*) >= 5",
)
def x8b(spark: SparkSession, d: str) -> DataFrame:
    return technical.lag_corr(macro.focus_pairs(indicator_series(spark, d), PAIRS, 10), "x", "y")


@query(
    "x8_granger",
    f"{_SERIES} "
    + " UNION ALL ".join(
        f"SELECT series, {k} AS lag, round(coalesce((avg(pow(y - my, 2)) - avg(pow(y - (0.7 * my + 0.3 * mx), 2))) * 100 / nullif(avg(pow(y - my, 2)), 0), 0), 2) AS improvement FROM (SELECT *, avg(y) OVER w AS my, avg(x) OVER w AS mx FROM big WHERE n0 >= 15 WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)) WHERE i > {k} GROUP BY 1"
        for k in (1, 2, 3)
    ),
)
def x8c(spark: SparkSession, d: str) -> DataFrame:
    return technical.granger_lite(macro.focus_pairs(indicator_series(spark, d), PAIRS, 15), "x", "y")


# Stress index ---------------------------------------------------------------------------------------

BASELINE = "1998-01-05"


def _pctl(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN round(round(len(list_filter(list({x}) OVER w, lambda v: v <= {x})) * 100.0 / nullif(count({x}) OVER w, 0), 8), 4) / 100 END"


_STRESS = f"""WITH cost AS ({_AVG_COST}), mp AS (SELECT m.date, balance, "limit" AS lim, close_price, market, m.stock_id, CASE WHEN market = 'twse' THEN 0.6 ELSE 0.5 END AS rate {_MP}),
  mm AS (SELECT date, round(sum(balance * close_price * 1000) / 1e12, 6) AS margin_total, round(sum(CASE WHEN market = 'twse' THEN balance * balance / CAST(lim AS DOUBLE) END) / sum(CASE WHEN market = 'twse' THEN balance END) * 100, 4) AS margin_util FROM mp GROUP BY 1),
  md AS (SELECT date, -round(sum(balance * close_price) * 100 / sum(balance * avg_cost * rate), 4) AS maint_inverse, round(sum(CASE WHEN round(close_price / (avg_cost * rate), 6) < 1.4 THEN balance * avg_cost * rate ELSE 0 END) * 100 / sum(balance * avg_cost * rate), 4) AS low140 FROM mp JOIN cost ON mp.stock_id = cost.stock_id GROUP BY 1),
  mk0 AS (SELECT date, round(avg(close_price), 4) AS close_price, CAST(sum(trade_value) AS BIGINT) AS turn_val FROM bars GROUP BY 1), mk1 AS (SELECT *, ln(close_price / lag(close_price) OVER (ORDER BY date)) AS r FROM mk0),
  mk AS (SELECT date, turn_val, CASE WHEN count(r) OVER (ORDER BY date ROWS 19 PRECEDING) >= 20 THEN round(stddev_pop(r) OVER (ORDER BY date ROWS 19 PRECEDING) * sqrt(252.0) * 100, 4) END AS rv20 FROM mk1),
  fo AS (SELECT date, sum(f) OVER (ORDER BY date ROWS 19 PRECEDING) AS f20 FROM (SELECT date, sum(foreign_buy) AS f FROM flows GROUP BY 1)),
  al AS (SELECT mk.date, margin_total, margin_util, maint_inverse, low140, turn_val, rv20, f20, round(margin_total * 1000000 / turn_val, 6) AS turn_heat FROM mk LEFT JOIN mm USING (date) LEFT JOIN md USING (date) LEFT JOIN fo USING (date)),
  un AS (SELECT date, CASE WHEN pk > bs THEN round((margin_total - bs) / (pk - bs), 4) ELSE 0.0 END AS u FROM (SELECT date, margin_total, first_value(margin_total) OVER w AS bs, max(margin_total) OVER w AS pk FROM al WHERE date >= DATE '{BASELINE}' AND margin_total IS NOT NULL WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))),
  d5 AS (SELECT date, (margin_total - lag(margin_total, 5) OVER (ORDER BY date)) * 100 / lag(margin_total, 5) OVER (ORDER BY date) AS d FROM al WHERE margin_total IS NOT NULL),
  zs AS (SELECT date, CASE WHEN stddev_pop(f20) OVER w > 0 THEN -(f20 - avg(f20) OVER w) / stddev_pop(f20) OVER w END AS z FROM al WHERE f20 IS NOT NULL WINDOW w AS (ORDER BY date ROWS 1249 PRECEDING)),
  pc AS (SELECT date, {', '.join(f"{_pctl(x)} AS {x}" for x in ("margin_total", "turn_heat", "margin_util", "maint_inverse", "low140", "rv20", "turn_val"))} FROM al WINDOW w AS (ORDER BY date ROWS 1249 PRECEDING))"""


@query(
    "x9_deleveraging_index",
    f"""{_STRESS} SELECT pc.date, round(round({' + '.join(f"coalesce({x}, 0.0) * {macro.STRESS_WEIGHTS[x]}" for x in ("margin_total", "turn_heat", "margin_util", "maint_inverse", "low140", "rv20", "turn_val"))} + coalesce(u, 0.0) * 22.0 + CASE WHEN d5.date IS NULL THEN 0.0 WHEN d IS NULL THEN 0.5 ELSE round(greatest(0.0, least(1.0, 0.5 + d / 8)), 4) END * 8.0
    + CASE WHEN zs.date IS NULL THEN 0.0 WHEN z IS NULL THEN 0.5 ELSE round(greatest(0.0, least(1.0, 0.5 + z / 4)), 4) END * 10.0, 8), 2) AS score FROM pc LEFT JOIN un USING (date) LEFT JOIN d5 USING (date) LEFT JOIN zs USING (date)""",
)
def x9(spark: SparkSession, d: str) -> DataFrame:
    prices, names, balances = bars(spark, d), stocks(spark, d), adapters.margin(spark, d)
    market = margin.margin_market(balances, prices, names).select("date", F.col("market_value").alias("margin_total"), F.col("utilisation").alias("margin_util"))
    loans = margin.maintenance_distribution(balances, prices, margin.avg_cost(prices, ASOF), names).select("date", (-F.col("wavg")).alias("maint_inverse"), F.col("under_140").alias("low140"))
    index = prices.groupBy("date").agg(F.round(F.avg("close_price"), 4).alias("close_price"), F.sum("trade_value").alias("turn_val")).withColumn("series", F.lit("market"))
    index = technical.realised_vol(index, 20, key="series").select("date", "turn_val", F.col("realised_vol").alias("rv20"))
    recent = Window.partitionBy("series").orderBy("date").rowsBetween(-19, 0)
    foreign = net(spark, d).groupBy("date").agg(F.sum("foreign_buy").alias("f")).withColumn("series", F.lit("market")).select("date", F.sum("f").over(recent).alias("f20"))
    rows = index.join(market, "date", "left").join(loans, "date", "left").join(foreign, "date", "left").withColumns({"series": F.lit("market"), "turn_heat": F.round(F.try_divide(F.col("margin_total") * 1000000, F.col("turn_val")), 6)})
    return macro.stress_index(rows, BASELINE)


# Options, futures, selections -----------------------------------------------------------------------

_QUOTES = "quoted AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_linestatus AS contract, CAST(p_size * 100 AS DOUBLE) AS strike, CASE WHEN l_returnflag = 'R' THEN 'C' ELSE 'P' END AS cp, round(100 + 1.2 * (avg(l_quantity) - 25), 2) AS close, count(*) AS volume, CAST(sum(l_quantity) AS BIGINT) AS oi FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)"


def _side(cp: str, name: str) -> str:
    pick = lambda c: f"max({c}) FILTER (cp = '{cp}')"
    return f"{pick('close')} AS {name}_close, {pick('round(close - 100, 2)')} AS {name}_change, {pick('round(close - 100, 2)')} AS {name}_change_pct, coalesce({pick('volume')}, 0) AS {name}_volume, coalesce({pick('oi')}, 0) AS {name}_oi"


@query(
    "a19_option_table",
    f"WITH {_WALLS}, {_PAIN}, {_QUOTES}, t AS (SELECT date, contract, strike, {_side('C', 'call')}, {_side('P', 'put')} FROM quoted GROUP BY 1, 2, 3) SELECT t.*, CAST(strike = resistance AS INTEGER) AS is_resistance, CAST(strike = support AS INTEGER) AS is_support, CAST(strike = max_pain AS INTEGER) AS is_max_pain FROM t JOIN walls w ON t.date = w.date AND t.contract = w.contract JOIN pain p ON t.date = p.date AND t.contract = p.contract",
)
def a19b(spark: SparkSession, d: str) -> DataFrame:
    rows = derivatives.option_table(adapters.option_quotes(spark, d))
    flat = [F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("call", "put") for f in ("close", "change", "change_pct", "volume", "oi")]
    return rows.select("date", "contract", "strike", *flat, "is_resistance", "is_support", "is_max_pain")


ACTIONS = {"1-URGENT": "人工管制", "2-HIGH": "第一次處置", "3-MEDIUM": "第二次處置", "4-NOT SPECIFIED": "第三次處置"}
_BASIS = f"""WITH fut AS (SELECT m.stock_id, p_brand AS product_code, round(avg(100 + 1.2 * (l_quantity - 25)), 2) AS price, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey JOIN fmap m ON m.product_code = p_brand GROUP BY 1, 2),
  near AS (SELECT * FROM fut QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY volume DESC, product_code DESC) = 1), live AS (SELECT CAST(user_id AS VARCHAR) AS stock_id, arg_max(value, row(ts, event_id)) AS price FROM events WHERE user_id % 2 = 0 GROUP BY 1), lastc AS (SELECT stock_id, arg_max(close_price, date) AS last_close FROM bars GROUP BY 1),
  acted AS (SELECT stock_id, period_start, period_end, CASE action {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items())} ELSE action END AS action FROM disp WHERE period_start <= DATE '2000-01-03' AND period_end >= DATE '2000-01-03'),
  res AS (SELECT * FROM acted QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY period_start DESC, action DESC, period_end DESC) = 1),
  j AS (SELECT n.stock_id, name, product_code, n.price AS futures_price, coalesce(l.price, last_close) AS spot, CAST(l.price IS NULL AS INTEGER) AS spot_stale, CAST(r.stock_id IS NOT NULL AS INTEGER) AS restricted, period_start, period_end, action FROM near n LEFT JOIN live l USING (stock_id) LEFT JOIN lastc USING (stock_id) LEFT JOIN instruments i USING (stock_id) LEFT JOIN res r ON n.stock_id = r.stock_id),
  k AS (SELECT *, CASE WHEN spot <> 0 THEN futures_price - spot END AS b FROM j),
  basis AS (SELECT stock_id, name, product_code, futures_price, spot, spot_stale, round(round(b, 6), 2) AS basis, round(round(b * 100 / spot, 7), 3) AS basis_pct, CASE WHEN b > 0 THEN 'contango' WHEN b < 0 THEN 'backwardation' WHEN b = 0 THEN 'flat' ELSE 'no_spot' END AS status, restricted, period_start, period_end,
    CASE WHEN contains(action, '人工') THEN 60 WHEN contains(action, '第一次') THEN 5 WHEN contains(action, '第二次') OR contains(action, '第三次') THEN 20 END AS match_minutes, CASE WHEN contains(action, '人工') THEN '人工管制·每60分撮合' WHEN contains(action, '第一次') THEN '第一次處置·每5分撮合' WHEN contains(action, '第二次') THEN '第二次處置·每20分撮合' WHEN contains(action, '第三次') THEN action || '·每20分撮合' ELSE action END AS match_label FROM k)"""


@query("x6_basis_report", f"{_BASIS} SELECT * FROM basis")
def x6b(spark: SparkSession, d: str) -> DataFrame:
    lineitem, part = adapters.table(spark, d, "lineitem"), adapters.table(spark, d, "part").select("p_partkey", "p_brand")
    per = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("product_code")).agg(F.round(F.avg(100 + 1.2 * (F.col("l_quantity") - 25)), 2).alias("price"), F.sum("l_quantity").cast("long").alias("volume"))
    futures = per.join(adapters.stock_futures_map(spark, d), "product_code").select("stock_id", "product_code", "price", "volume")
    live = adapters.table(spark, d, "events").where("user_id % 2 = 0").groupBy(F.col("user_id").cast("string").alias("stock_id")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"))
    day = F.lit("2000-01-03").cast("date")
    words = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    restricted = adapters.disposition_announcements(spark, d).where((F.col("period_start") <= day) & (F.col("period_end") >= day)).withColumn("action", F.coalesce(words[F.col("action")], "action"))
    return derivatives.basis_report(futures, live, bars(spark, d), stocks(spark, d), restricted)


@query("x6_basis_counts", f"{_BASIS} SELECT {', '.join(f'count(*) FILTER (status = {s!r}) AS {s}' for s in ('contango', 'backwardation', 'flat', 'no_spot'))}, count(*) FILTER (restricted = 1) AS restricted, count(*) FILTER (spot_stale = 0) AS spot_realtime, count(*) FILTER (spot_stale = 1 AND spot IS NOT NULL) AS spot_stale, count(*) AS total FROM basis")
def x6c(spark: SparkSession, d: str) -> DataFrame:
    return derivatives.basis_counts(x6b(spark, d))


@query(
    "p1_screener_trust",
    "SELECT b.stock_id, name, market, b.date, close_price, change_pct, volume, coalesce(foreign_buy, 0) AS foreign_buy, coalesce(sitc_buy, 0) AS sitc_buy FROM bars b JOIN instruments i ON b.stock_id = i.stock_id LEFT JOIN flows f ON b.stock_id = f.stock_id AND b.date = f.date WHERE b.date = (SELECT max(date) FROM bars) AND sitc_buy < 0 AND close_price <= 129 AND change_pct <= 60 ORDER BY volume DESC, b.stock_id LIMIT 200",
)
def p1b(spark: SparkSession, d: str) -> DataFrame:
    prices = bars(spark, d)
    return screener(prices, stocks(spark, d), net(spark, d), technical.breakouts(prices), max_price=129, max_change=60, sitc=-1, consec_foreign=3, market="all")


_LEG = "SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS minute, event_type, CASE WHEN hour(ts) % 3 > 0 THEN round(min(value), 4) END AS bid, CASE WHEN hour(ts) % 4 > 0 THEN round(max(value), 4) END AS ask, arg_max(value, row(ts, event_id)) AS close, CASE WHEN day(ts) % 2 = 0 THEN round(avg(value), 4) END AS ref, arg_min(value, row(ts, event_id)) AS open FROM events GROUP BY CAST(ts AS DATE), hour(ts), day(ts), event_type"


QUOTED_STRENGTH = f"""WITH leg AS ({_LEG}), ch AS (SELECT *, CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 ELSE close END AS price, CASE WHEN ref > 0 THEN ref ELSE open END AS base, CASE WHEN ref > 0 THEN 'ref' ELSE 'open' END AS src FROM leg), c AS (SELECT *, coalesce((price - base) * 100 / nullif(base, 0), 0) AS chg FROM ch),
    s AS (SELECT a.date, a.minute, CAST(round(CAST(a.price AS DECIMAL(18, 6)), 2) AS DOUBLE) AS a_price, CAST(round(CAST(b.price AS DECIMAL(18, 6)), 2) AS DOUBLE) AS b_price, CASE WHEN a.src = b.src THEN a.src ELSE 'mixed' END AS base_source, a.chg AS x, b.chg AS y, a.chg - b.chg AS raw FROM c a JOIN c b ON a.date = b.date AND a.minute = b.minute WHERE a.event_type = 'click' AND b.event_type = 'view'), m AS (SELECT *, avg(raw) OVER (PARTITION BY date ORDER BY minute ROWS 2 PRECEDING) AS z FROM s)
    SELECT date, minute, a_price, b_price, base_source, round(x, 4) AS a_change, round(y, 4) AS b_change, round(raw, 4) AS strength_raw, round(z, 4) AS strength, CASE WHEN round(z, 10) > 0 THEN 'red' WHEN round(z, 10) < 0 THEN 'green' ELSE 'flat' END AS colour FROM m"""


@query("x20_quoted_strength", QUOTED_STRENGTH)
def x20b(spark: SparkSession, d: str) -> DataFrame:
    first = F.struct("ts", "event_id")
    rows = adapters.table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("date"), F.hour("ts").alias("minute"), "event_type")
    legs = rows.agg(F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"), F.max_by("value", first).alias("close"), F.round(F.avg("value"), 4).alias("mean"), F.min_by("value", first).alias("open"))
    legs = legs.select("date", "minute", "event_type", F.when(F.col("minute") % 3 > 0, F.col("low")).alias("bid"), F.when(F.col("minute") % 4 > 0, F.col("high")).alias("ask"), "close", F.when(F.day("date") % 2 == 0, F.col("mean")).alias("ref"), "open")
    leg = lambda kind: legs.where(F.col("event_type") == kind).drop("event_type")
    return macro.quoted_strength(leg("click"), leg("view"))
