"""Queries of the window and time-series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators import recursive, technical
from panelspark.sources import adapters

from .registry import query
from .storage import stored

bars = adapters.daily_prices


def series(df: DataFrame, key: str = "stock_id") -> DataFrame:
    return df.withColumnRenamed(key, "series")


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


_FLAGS = ", ".join(f"CASE WHEN close_price > max(high_price) OVER (PARTITION BY stock_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS break_{n}" for n in technical.DAYS)
_ANY = "break_5 + break_10 + break_20 + break_60 + break_120 + break_240 > 0"
BREAKOUTS = f"SELECT * FROM (SELECT stock_id, date, close_price, volume, change_pct, {_FLAGS} FROM bars) WHERE {_ANY}"


@query("w1_breakouts", BREAKOUTS)
def w1(spark: SparkSession, d: str) -> DataFrame:
    return technical.breakouts(bars(spark, d))


_CAL = ", ".join(f"CASE WHEN day > {n} AND close_price > max(high_price) OVER (PARTITION BY stock_id ORDER BY day RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS break_{n}" for n in technical.DAYS)


@query("w2_breakouts_calendar", f"WITH cal AS (SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM bars)) SELECT stock_id, date, close_price, break_5, break_10, break_20, break_60, break_120, break_240 FROM (SELECT *, {_CAL} FROM bars JOIN cal USING (date)) WHERE {_ANY}")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return technical.breakouts_calendar(bars(spark, d))


@query("w3_change_pct", "SELECT stock_id, date, close_price, change_pct FROM bars")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).select("stock_id", "date", "close_price", "change_pct")


@query(
    "w4_adjust_prices",
    """SELECT stock_id, date, round(a, 4) AS adj_close, round(open_price * a / close_price, 4) AS adj_open, round(high_price * a / close_price, 4) AS adj_high, round(low_price * a / close_price, 4) AS adj_low FROM (
    SELECT *, last_value(close_price) OVER (PARTITION BY stock_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
      / exp(coalesce(sum(ln(CASE WHEN 1 + coalesce(change_pct, 0) / 100 > 0 THEN 1 + coalesce(change_pct, 0) / 100 ELSE 1 END)) OVER (PARTITION BY stock_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS a FROM bars)""",
)
def w4(spark: SparkSession, d: str) -> DataFrame:
    out = technical.adjust_prices(bars(spark, d)).select("stock_id", "date", "adj_close", "adj_open", "adj_high", "adj_low")
    return rounded(out, "adj_close", "adj_open", "adj_high", "adj_low")


def _w(n: int) -> str:
    return f"OVER (PARTITION BY stock_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(
    "w5_moving_averages",
    f"""SELECT stock_id, date, {', '.join(f'CASE WHEN count(close_price) {_w(n)} >= {n} THEN round(avg(close_price) {_w(n)}, 2) END AS sma_{n}' for n in (5, 20, 60))},
    CASE WHEN count(close_price) {_w(20)} >= 20 THEN round(avg(close_price) {_w(20)} + 2 * stddev_pop(close_price) {_w(20)}, 2) END AS boll_upper,
    CASE WHEN count(close_price) {_w(20)} >= 20 THEN round(avg(close_price) {_w(20)} - 2 * stddev_pop(close_price) {_w(20)}, 2) END AS boll_lower FROM bars""",
)
def w5(spark: SparkSession, d: str) -> DataFrame:
    return technical.moving_averages(bars(spark, d)).select("stock_id", "date", "sma_5", "sma_20", "sma_60", "boll_upper", "boll_lower")


_NUMBERED = "n AS MATERIALIZED (SELECT stock_id, date, close_price, high_price, low_price, row_number() OVER (PARTITION BY stock_id ORDER BY date) AS i, max(high_price) OVER (PARTITION BY stock_id ORDER BY date ROWS 8 PRECEDING) AS hi, min(low_price) OVER (PARTITION BY stock_id ORDER BY date ROWS 8 PRECEDING) AS lo, close_price - lag(close_price) OVER (PARTITION BY stock_id ORDER BY date) AS step FROM bars WHERE close_price IS NOT NULL)"
_MACD = f"""WITH RECURSIVE {_NUMBERED}, r AS (SELECT stock_id, date, i, close_price AS a, close_price AS b, CAST(0 AS DOUBLE) AS s FROM n WHERE i = 1 UNION ALL
  SELECT n.stock_id, n.date, n.i, r.a * (1 - 2 / 13) + n.close_price * (2 / 13), r.b * (1 - 2 / 27) + n.close_price * (2 / 27), r.s * 0.8 + round(round(r.a * (1 - 2 / 13) + n.close_price * (2 / 13), 2) - round(r.b * (1 - 2 / 27) + n.close_price * (2 / 27), 2), 2) * 0.2 FROM r JOIN n ON n.stock_id = r.stock_id AND n.i = r.i + 1)
  SELECT stock_id, date, round(a, 2) AS ema_fast, round(b, 2) AS ema_slow, round(round(a, 2) - round(b, 2), 2) AS dif, round(s, 2) AS signal, round(round(round(a, 2) - round(b, 2), 2) - round(s, 2), 2) AS hist FROM r"""


@query("w6_macd", _MACD)
def w6(spark: SparkSession, d: str) -> DataFrame:
    return recursive.macd(bars(spark, d))


_RSV = "CASE WHEN n.hi > n.lo THEN (n.close_price - n.lo) / (n.hi - n.lo) * 100 ELSE 50.0 END"


@query(
    "w7_kd",
    f"""WITH RECURSIVE {_NUMBERED}, r AS (SELECT stock_id, CAST(8 AS BIGINT) AS i, CAST(50 AS DOUBLE) AS k, CAST(50 AS DOUBLE) AS d FROM n WHERE i = 8 UNION ALL SELECT n.stock_id, n.i, r.k * (2 / 3) + {_RSV} / 3, r.d * (2 / 3) + (r.k * (2 / 3) + {_RSV} / 3) / 3 FROM r JOIN n ON n.stock_id = r.stock_id AND n.i = r.i + 1)
    SELECT n.stock_id, n.date, round(k, 2) AS k, round(d, 2) AS d FROM n LEFT JOIN r ON n.stock_id = r.stock_id AND n.i = r.i AND r.i >= 9""",
)
def w7(spark: SparkSession, d: str) -> DataFrame:
    return recursive.kd(bars(spark, d))


@query(
    "w8_rsi",
    f"""WITH RECURSIVE {_NUMBERED}, r AS (SELECT stock_id, CAST(15 AS BIGINT) AS i, sum(greatest(step, 0)) / 14 AS g, sum(greatest(-step, 0)) / 14 AS s FROM n WHERE i BETWEEN 2 AND 15 GROUP BY 1 HAVING count(*) = 14
    UNION ALL SELECT n.stock_id, n.i, (r.g * 13 + greatest(n.step, 0)) / 14, (r.s * 13 + greatest(-n.step, 0)) / 14 FROM r JOIN n ON n.stock_id = r.stock_id AND n.i = r.i + 1)
    SELECT n.stock_id, n.date, round(CASE WHEN s = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / s) END, 2) AS rsi FROM n LEFT JOIN r ON n.stock_id = r.stock_id AND n.i = r.i""",
)
def w8(spark: SparkSession, d: str) -> DataFrame:
    return recursive.rsi(bars(spark, d))


@query(
    "w9_streaks",
    """WITH dates AS (SELECT DISTINCT date FROM flows ORDER BY date DESC LIMIT 20), r AS (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) AS rk FROM flows WHERE date IN (SELECT date FROM dates)),
    b AS (SELECT *, min(CASE WHEN NOT coalesce(foreign_buy > 0, false) THEN rk END) OVER (PARTITION BY stock_id) AS broken FROM r)
    SELECT stock_id, count(*) AS days, CAST(sum(foreign_buy) AS BIGINT) AS total FROM b WHERE broken IS NULL OR rk < broken GROUP BY 1 HAVING count(*) >= 2 ORDER BY days DESC, abs(total) DESC, stock_id LIMIT 100""",
)
def w9(spark: SparkSession, d: str) -> DataFrame:
    return technical.streaks(adapters.institutional(spark, d), "foreign_buy", 1, min_days=2)


@query(
    "w10_streak_current",
    """WITH s AS (SELECT stock_id AS series, date, CASE WHEN change_pct > 0 THEN 'UP' ELSE 'DOWN' END AS signal FROM bars), i AS (SELECT *, sum(c) OVER (PARTITION BY series ORDER BY date) AS island FROM (SELECT *, coalesce(CAST(signal <> lag(signal) OVER (PARTITION BY series ORDER BY date) AS INTEGER), 1) AS c FROM s))
    SELECT series, first(signal) AS signal, count(*) AS days, min(date) AS since FROM i QUALIFY island = max(island) OVER (PARTITION BY series) GROUP BY series, island""".replace("SELECT series, first(signal) AS signal, count(*) AS days, min(date) AS since FROM i QUALIFY island = max(island) OVER (PARTITION BY series) GROUP BY series, island", "SELECT series, first(signal) AS signal, count(*) AS days, min(date) AS since FROM i WHERE (series, island) IN (SELECT (series, max(island)) FROM i GROUP BY series) GROUP BY series, island"),
)
def w10(spark: SparkSession, d: str) -> DataFrame:
    return technical.streak_current(series(bars(spark, d)).select("series", "date", F.when(F.col("change_pct") > 0, "UP").otherwise("DOWN").alias("signal")))


def _rank_sql(n: int, value: str, got: str) -> str:
    return f"SELECT stock_id, date, CASE WHEN {value} IS NOT NULL THEN {got} END AS pctile FROM (SELECT stock_id, date, {value}, list({value}) FILTER ({value} IS NOT NULL) {_w(n)} AS a FROM bars)"


@query("w11_percentile_weak", _rank_sql(250, "change_pct", "round(len(list_filter(a, lambda v: v <= change_pct)) * 100.0 / len(a), 4)"))
def w11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(technical.rolling_percentile(bars(spark, d), "change_pct", 250).select("stock_id", "date", "pctile"), "pctile")


@query("w12_percentile_strict", _rank_sql(251, "close_price", "CASE WHEN len(a) >= 21 THEN round(len(list_filter(a, lambda v: v < close_price)) * 100.0 / len(a), 1) ELSE 50.0 END"))
def w12(spark: SparkSession, d: str) -> DataFrame:
    return technical.rolling_percentile(bars(spark, d), "close_price", 251, "strict", least=21).select("stock_id", "date", "pctile")


_MEAN_RANK = "CASE WHEN len(a) >= 39 THEN (len(list_filter(a, lambda v: v < close_price)) + (len(list_filter(a, lambda v: v = close_price)) + 1) / 2.0) / len(a) END"


@query("w13_rank_mean", _rank_sql(189, "close_price", f"round({_MEAN_RANK.replace('39', '189')}, 4)"))
def w13(spark: SparkSession, d: str) -> DataFrame:
    return rounded(technical.rolling_percentile(bars(spark, d), "close_price", 189, "mean").select("stock_id", "date", "pctile"), "pctile")


@query("w14_cume_dist", "SELECT indicator AS series, date, value, round(cume_dist() OVER (PARTITION BY indicator ORDER BY value) * 100, 1) AS pctile FROM macro")
def w14(spark: SparkSession, d: str) -> DataFrame:
    return technical.cume_dist_pct(series(adapters.macro_indicators(spark, d), "indicator"), "value")


_LIGHT = """CASE WHEN x IS NULL THEN NULL WHEN x < 0.28 THEN CASE WHEN coalesce(d > 0, false) AND x > 0.28 * 0.9 THEN 'YELLOW' ELSE 'GREEN' END
  WHEN x >= 0.32 THEN CASE WHEN coalesce(d < 0, false) AND x < 0.32 * 1.1 THEN 'YELLOW' ELSE 'RED' END
  WHEN coalesce(d > 0, false) THEN 'RED' WHEN coalesce(d < 0, false) THEN 'GREEN' ELSE 'YELLOW' END"""
_IND = f"SELECT stock_id AS series, date, 1 - pctile AS x FROM ({_rank_sql(39, 'close_price', _MEAN_RANK)})"


def indicator(spark: SparkSession, d: str) -> DataFrame:
    ranked = technical.rolling_percentile(bars(spark, d), "close_price", 39, "mean")
    return series(ranked).select("series", "date", (1 - F.col("pctile")).alias("x"))


@query(
    "w15_traffic_light",
    f"WITH ind AS ({_IND}), l AS (SELECT series, date, {_LIGHT} AS light FROM (SELECT *, x - lag(x, 5) OVER (PARTITION BY series ORDER BY date) AS d FROM ind)) SELECT *, lag(light) OVER (PARTITION BY series ORDER BY date) AS signal FROM l",
)
def w15(spark: SparkSession, d: str) -> DataFrame:
    return technical.traffic_light(indicator(spark, d), "x").select("series", "date", "light", "signal")


@query(
    "w16_realised_vol",
    f"SELECT stock_id, date, CASE WHEN count(r) {_w(20)} >= 20 THEN round(stddev_pop(r) {_w(20)} * sqrt(252.0) * 100, 4) END AS realised_vol FROM (SELECT *, ln(close_price / lag(close_price) OVER (PARTITION BY stock_id ORDER BY date)) AS r FROM bars)",
)
def w16(spark: SparkSession, d: str) -> DataFrame:
    return technical.realised_vol(bars(spark, d)).select("stock_id", "date", "realised_vol")


@query(
    "w17_flow_zscore",
    f"SELECT stock_id, date, round(z, 4) AS z, round(greatest(0.0, least(1.0, 0.5 + z / 4)), 4) AS subscore FROM (SELECT stock_id, date, CASE WHEN s > 0 THEN -(foreign_buy - m) / s END AS z FROM (SELECT *, avg(foreign_buy) {_w(250)} AS m, stddev_pop(foreign_buy) {_w(250)} AS s FROM flows))".replace("round(greatest(0.0, least(1.0, 0.5 + z / 4)), 4)", "CASE WHEN z IS NULL THEN 0.5 ELSE round(greatest(0.0, least(1.0, 0.5 + z / 4)), 4) END"),
)
def w17(spark: SparkSession, d: str) -> DataFrame:
    return technical.pressure(adapters.institutional(spark, d), "foreign_buy", 250).select("stock_id", "date", "z", "subscore")


@query(
    "w18_momentum",
    "SELECT stock_id, date, round(m, 4) AS d, CASE WHEN m IS NULL THEN 0.5 ELSE round(greatest(0.0, least(1.0, 0.5 + m / 8)), 4) END AS subscore FROM (SELECT *, (close_price - p) * 100 / p AS m FROM (SELECT *, lag(close_price, 5) OVER (PARTITION BY stock_id ORDER BY date) AS p FROM bars))",
)
def w18(spark: SparkSession, d: str) -> DataFrame:
    return technical.momentum(bars(spark, d), "close_price").select("stock_id", "date", "d", "subscore")


@query(
    "w19_unwind",
    """WITH r AS (SELECT indicator AS series, date, value FROM macro WHERE date >= DATE '2024-01-08' AND value IS NOT NULL), o AS (SELECT series, arg_min(value, date) AS base_value, max(value) AS peak, arg_max(value, date) AS current, max(date) AS asof FROM r GROUP BY 1)
    SELECT o.*, (SELECT min(date) FROM r WHERE r.series = o.series AND r.value = o.peak) AS peak_date, round(current - base_value, 4) AS excess_now, round(peak - base_value, 4) AS excess_peak, CASE WHEN peak <> base_value THEN round((peak - current) / (peak - base_value), 4) END AS unwound FROM o""",
)
def w19(spark: SparkSession, d: str) -> DataFrame:
    return technical.unwind(series(adapters.macro_indicators(spark, d), "indicator"), "value", "2024-01-08")


@query("w20_last_valid", "SELECT stock_id, max(date) AS date, arg_max(change_pct, date) AS change_pct FROM bars WHERE change_pct IS NOT NULL GROUP BY 1")
def w20(spark: SparkSession, d: str) -> DataFrame:
    return technical.last_valid(bars(spark, d), "change_pct", "stock_id")


RETURNS, GAPS = (5, 10, 20, 60, 120), (20, 60, 120, 250)
FEATURES = (*(f"ret_{n}" for n in RETURNS), *(f"gap_{n}" for n in GAPS), "vol_ratio", "bar_range", "upper_shadow", "lower_shadow", "rel_volume")


def features(spark: SparkSession, d: str) -> DataFrame:
    return technical.technical_features(bars(spark, d), RETURNS, GAPS)


_L = "lag(close_price, {0}) OVER (PARTITION BY stock_id ORDER BY date)"


@query(
    "w21_features",
    f"""SELECT stock_id, date, {', '.join(f'round(round(close_price / {_L.format(n)} - 1, 10), 6) AS ret_{n}' for n in RETURNS)},
    {', '.join(f'CASE WHEN count(close_price) {_w(n)} >= {n} THEN round(round(close_price / avg(close_price) {_w(n)} - 1, 10), 6) END AS gap_{n}' for n in GAPS)},
    round(round((CASE WHEN count(r) {_w(20)} >= 20 THEN stddev_samp(r) {_w(20)} END) / nullif(CASE WHEN count(r) {_w(60)} >= 60 THEN stddev_samp(r) {_w(60)} END, 0), 10), 6) AS vol_ratio,
    round(round((high_price - low_price) / close_price, 10), 6) AS bar_range, round(round((high_price - greatest(open_price, close_price)) / close_price, 10), 6) AS upper_shadow, round(round((least(open_price, close_price) - low_price) / close_price, 10), 6) AS lower_shadow,
    CASE WHEN count(volume) {_w(60)} >= 60 THEN round(round(volume / avg(volume) {_w(60)}, 10), 6) END AS rel_volume FROM (SELECT *, close_price / {_L.format(1)} - 1 AS r FROM bars)""",
)
def w21(spark: SparkSession, d: str) -> DataFrame:
    exact = rounded(features(spark, d).select("stock_id", "date", *FEATURES), *FEATURES, places=10)
    return rounded(exact, *FEATURES, places=6)  # averages summed in another order end at the same side of a tie


def lasso(spark: SparkSession, d: str) -> DataFrame:
    """All 14 features, refit at every row; weekly bars are too few for 756 rows, but 250 leave out no row that has all features."""
    return recursive.rolling_lasso_signal(features(spark, d), list(FEATURES), window=250)


@query("w22_rolling_lasso")
def w22(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lasso(spark, d), "signal", places=6)


#: A signal that SQL can restate: the gap to the 20-bar average, faded.
def gap_signal(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("stock_id", "date", "close_price", F.round(-F.col("gap_20"), 6).alias("signal"))


def positions(spark: SparkSession, d: str) -> DataFrame:
    return technical.to_position(gap_signal(spark, d), regime=40, vol=20)


_SIG = f"SELECT stock_id, date, close_price, round(-CASE WHEN count(close_price) {_w(20)} >= 20 THEN close_price / avg(close_price) {_w(20)} - 1 END, 6) AS signal FROM bars"
_POS = f"""WITH sig AS ({_SIG}), p1 AS (SELECT *, close_price / {_L.format(1)} - 1 AS r, CASE WHEN count(close_price) {_w(40)} >= 40 THEN round(avg(close_price) {_w(40)}, 6) END AS trend, CASE WHEN signal > 0.025 THEN 1 WHEN signal < -0.025 THEN -1 ELSE 0 END AS raw FROM sig),
  p2 AS (SELECT *, 0.16 / ((CASE WHEN count(r) {_w(20)} >= 20 THEN nullif(stddev_samp(r) {_w(20)}, 0) END) * sqrt(252.0)) AS sc FROM p1),
  p3 AS (SELECT *, last_value(CASE WHEN sc IS NOT NULL THEN greatest(0.0, least(3.0, sc)) END IGNORE NULLS) OVER (PARTITION BY stock_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS scale FROM p2),
  p4 AS (SELECT *, CASE WHEN (raw > 0 AND close_price < trend) OR (raw < 0 AND close_price > trend) THEN 0 ELSE raw END AS side FROM p3),
  pos AS (SELECT stock_id, date, close_price, signal, side, round(side * coalesce(scale, 0.0), 6) AS position FROM p4)"""


@query("w23_position", f"{_POS} SELECT stock_id, date, side, position FROM pos")
def w23(spark: SparkSession, d: str) -> DataFrame:
    return positions(spark, d).select("stock_id", "date", "side", "position")


_EQ = f"""{_POS}, e1 AS (SELECT *, coalesce(close_price / {_L.format(1)} - 1, 0) * coalesce(lag(position) OVER (PARTITION BY stock_id ORDER BY date), 0) - abs(position - coalesce(lag(position) OVER (PARTITION BY stock_id ORDER BY date), 0)) * 0.0005 AS net_ret FROM pos),
  eq AS (SELECT *, exp(sum(ln(1 + net_ret)) OVER (PARTITION BY stock_id ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM e1)"""


@query("w24_equity", f"{_EQ} SELECT stock_id, date, round(net_ret, 6) AS net_ret, round(equity, 4) AS equity FROM eq")
def w24(spark: SparkSession, d: str) -> DataFrame:
    return technical.strategy_equity(positions(spark, d)).select("stock_id", "date", F.round("net_ret", 6).alias("net_ret"), F.round("equity", 4).alias("equity"))


_BAR = "WINDOW w AS (PARTITION BY stock_id ORDER BY date)"
_RETURNS = f"""m0 AS (SELECT *, lag(side) OVER w AS ps, lag(position) OVER w AS pp, close_price / lag(close_price) OVER w - 1 AS r FROM pos {_BAR}),
  m1 AS (SELECT *, CAST(side <> 0 AND coalesce(side <> lag(side) OVER w, true) AS INTEGER) AS entered FROM m0 WHERE r IS NOT NULL {_BAR}),
  u AS (SELECT stock_id, date, side, entered, 'strat' AS strategy, r * ps - abs(side - ps) * 0.0005 AS ret FROM m1 UNION ALL SELECT stock_id, date, side, entered, 'vol', r * pp - abs(position - pp) * 0.0005 FROM m1 UNION ALL SELECT stock_id, date, side, entered, 'bh', r FROM m1),
  q AS (SELECT *, product(1 + ret) OVER (PARTITION BY stock_id, strategy ORDER BY date) AS equity FROM u)"""


@query(
    "w25_metrics",
    f"""{_POS}, {_RETURNS}, dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY stock_id, strategy ORDER BY date) - 1 AS fall FROM q),
    a AS (SELECT stock_id, strategy, count(*) AS n, arg_max(equity, date) AS fin, avg(ret) AS mean, stddev_samp(ret) AS sd, min(fall) AS mdd, sum(entered) AS switches, avg(CAST(side <> 0 AS INTEGER)) AS tim, coalesce(count(*) FILTER (ret > 0) / nullif(count(*) FILTER (ret <> 0), 0), 0) AS wr FROM dd GROUP BY 1, 2 HAVING count(*) >= 50),
    c AS (SELECT *, CASE WHEN fin > 0 THEN pow(fin, 252.0 / n) - 1 ELSE -1 END AS cagr_ FROM a)
    SELECT stock_id, strategy, n, round(cagr_, 4) AS cagr, round(sd * sqrt(252.0), 4) AS vol, CASE WHEN sd > 0 THEN round(mean / sd * sqrt(252.0), 4) ELSE 0.0 END AS sharpe, round(mdd, 4) AS max_drawdown, CASE WHEN mdd < 0 THEN round(cagr_ / -mdd, 4) ELSE 0.0 END AS calmar, round(wr, 4) AS win_rate, CAST(switches AS BIGINT) AS switches, round(tim, 4) AS time_in_market FROM c""",
)
def w25(spark: SparkSession, d: str) -> DataFrame:
    return technical.performance_metrics(positions(spark, d))


_TRADES = f"""{_POS}, rn AS (SELECT *, sum(c) OVER (PARTITION BY stock_id ORDER BY date) AS run FROM (SELECT *, coalesce(CAST(side <> lag(side) OVER (PARTITION BY stock_id ORDER BY date) AS INTEGER), 1) AS c FROM pos)),
  ru AS (SELECT stock_id, run, CAST(any_value(side) AS INTEGER) AS side, min(date) AS entry_date, arg_min(close_price, date) AS entry_price, count(*) AS bars_ FROM rn GROUP BY 1, 2),
  cl AS (SELECT *, lead(entry_date) OVER (PARTITION BY stock_id ORDER BY run) AS exit_date, lead(entry_price) OVER (PARTITION BY stock_id ORDER BY run) AS exit_price FROM ru),
  tr AS (SELECT stock_id, side, entry_date, entry_price, bars_ AS n_bars, exit_date, exit_price, side * (exit_price - entry_price) / entry_price - 0.001 AS pnl FROM cl WHERE side <> 0 AND exit_date IS NOT NULL)"""


@query("w26_trades", f"{_TRADES} SELECT stock_id, side, entry_date, exit_date, n_bars, round(entry_price, 4) AS entry_price, round(exit_price, 4) AS exit_price, round(pnl, 6) AS pnl FROM tr")
def w26(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(technical.trades(positions(spark, d)).withColumnRenamed("bars", "n_bars"), "entry_price", "exit_price"), "pnl", places=6)


@query(
    "w26_trade_summary",
    f"""{_TRADES}, s AS (SELECT stock_id, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS w, coalesce(avg(pnl) FILTER (pnl < 0), 0) AS l, avg(n_bars) AS hold, max(pnl) AS b, min(pnl) AS o, count(*) FILTER (side > 0) AS longs, count(*) FILTER (side < 0) AS shorts, count(*) FILTER (side > 0 AND pnl > 0) AS lw, count(*) FILTER (side < 0 AND pnl > 0) AS sw FROM tr GROUP BY 1),
    r AS (SELECT *, coalesce(wins / nullif(wins + losses, 0), 0) AS wr FROM s)
    SELECT stock_id, trades, wins, losses, round(wr, 4) AS win_rate, round(w, 6) AS avg_win, round(l, 6) AS avg_loss, round(abs(coalesce(w / nullif(l, 0), 0)), 4) AS payoff, round(wr * w + (1 - wr) * l, 6) AS expectancy, round(hold, 4) AS hold_bars, round(b, 6) AS best, round(o, 6) AS worst,
      longs, round(coalesce(lw / nullif(longs, 0), 0), 4) AS long_win_rate, shorts, round(coalesce(sw / nullif(shorts, 0), 0), 4) AS short_win_rate FROM r""",
)
def w26b(spark: SparkSession, d: str) -> DataFrame:
    return technical.trade_summary(technical.trades(positions(spark, d)))


_TRIM_ALL = """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) AS rk FROM {src}) WHERE rk <= {n}),
  j AS (SELECT *, CASE WHEN o IS NULL THEN false ELSE o <= 0 OR close_price <= 0 OR abs(close_price - o) > {step} * o END AS brk FROM (SELECT *, lag(close_price) OVER (PARTITION BY stock_id ORDER BY date) AS o FROM r)),
  l AS (SELECT *, min(rk) FILTER (brk) OVER (PARTITION BY stock_id) AS lst FROM j), trimmed AS (SELECT stock_id, round(avg(close_price), 4) AS avg_close, count(*) AS n_bars FROM l WHERE lst IS NULL OR rk <= lst GROUP BY 1)"""
_TRIM = _TRIM_ALL.replace("{src})", "{src} WHERE date >= (SELECT min(date) FROM (SELECT DISTINCT date FROM {src} ORDER BY date DESC LIMIT greatest({n} + 5, CAST(ceil({n} * 1.6) AS INTEGER)))))", 1)


@query("w27_trim_recent", _TRIM_ALL.format(src="sparse", n=60, step=0.35) + " SELECT * FROM trimmed")
def w27(spark: SparkSession, d: str) -> DataFrame:
    """Of every instrument, whatever the age of its bars."""
    return technical.trim_recent_continuous(adapters.daily_prices_sparse(spark, d), bounded=False).withColumnRenamed("bars", "n_bars")


@query("w27_bulk_average", _TRIM.format(src="sparse", n=60, step=0.35) + " SELECT * FROM trimmed")
def w27b(spark: SparkSession, d: str) -> DataFrame:
    """Of the instruments that trade in the market's last dates, as the margin scan takes it."""
    return technical.trim_recent_continuous(adapters.daily_prices_sparse(spark, d)).withColumnRenamed("bars", "n_bars")


def cost_seed(prices: DataFrame) -> DataFrame:
    """Cost seeds: each instrument's first close."""
    return prices.groupBy("stock_id").agg(F.min_by("close_price", "date").alias("cost"), F.min("date").alias("seed_date"))


COST_ROLL = """WITH RECURSIVE seeds AS (SELECT stock_id, arg_min(close_price, date) AS cost, min(date) AS seed_date FROM bars GROUP BY 1),
  d AS MATERIALIZED (SELECT m.stock_id, buy, balance, close_price, cost, row_number() OVER (PARTITION BY m.stock_id ORDER BY m.date) AS i FROM margin m JOIN bars b ON m.stock_id = b.stock_id AND m.date = b.date JOIN seeds s ON m.stock_id = s.stock_id WHERE m.date > seed_date),
  roll AS (SELECT stock_id, CAST(0 AS BIGINT) AS i, cost FROM d WHERE i = 1 UNION ALL SELECT d.stock_id, d.i, CASE WHEN d.balance > 0 AND d.buy IS NOT NULL AND d.close_price IS NOT NULL THEN r.cost + least(1.0, greatest(0.0, d.buy / d.balance)) * (d.close_price - r.cost) ELSE r.cost END FROM roll r JOIN d ON d.stock_id = r.stock_id AND d.i = r.i + 1 WHERE d.i <= 400),
  rolled AS (SELECT stock_id, arg_max(cost, i) AS cost, max(i) AS days FROM roll GROUP BY 1)"""


@query("w28_roll_cost", COST_ROLL + " SELECT stock_id, round(cost, 4) AS cost, days FROM rolled")
def w28(spark: SparkSession, d: str) -> DataFrame:
    prices = stored(bars(spark, d).select("stock_id", "date", "close_price"))
    return rounded(recursive.roll_cost(cost_seed(prices), adapters.margin(spark, d), prices), "cost")


@query(
    "w30_risk_features",
    f"""SELECT stock_id, date, close_price, change_pct, round((close_price - b) * 100 / b, 2) AS cum_ret, round(a6, 4) AS avg_short, round(a60, 4) AS avg_long, rs AS run_sum FROM (
    SELECT *, {_L.format(5)} AS b, avg(volume) {_w(6)} AS a6, CASE WHEN count(volume) {_w(60)} >= 60 THEN avg(volume) {_w(60)} END AS a60,
    CASE WHEN (min(change_pct) {_w(3)} > 0 OR max(change_pct) {_w(3)} < 0) AND count(change_pct) {_w(3)} >= 3 THEN round(sum(change_pct) {_w(3)}, 2) ELSE 0.0 END AS rs,
    count(*) OVER (PARTITION BY stock_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS n, row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) AS rk FROM bars) WHERE rk = 1 AND n >= 6""",
)
def w30(spark: SparkSession, d: str) -> DataFrame:
    return technical.risk_features(bars(spark, d))


_COMPLETE = "SELECT coalesce(max(date) FILTER (n >= 0.9 * b), min(date)) AS date FROM (SELECT *, lag(n) OVER (ORDER BY date) AS b FROM (SELECT date, count(close_price) AS n FROM bars GROUP BY 1 ORDER BY date DESC LIMIT 8))"


@query("w31_complete_date", _COMPLETE)
def w31(spark: SparkSession, d: str) -> DataFrame:
    return technical.complete_date(bars(spark, d))


@query(
    "w32_lag_corr",
    """WITH p AS (SELECT b.stock_id, b.date, change_pct AS x, CAST(foreign_buy AS DOUBLE) AS y FROM bars b JOIN flows f ON b.stock_id = f.stock_id AND b.date = f.date WHERE change_pct IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY date) AS i FROM p)
    SELECT a.stock_id AS series, k AS lag, count(*) AS n, round(coalesce(CASE WHEN isnan(corr(a.x, b.y)) THEN 0 ELSE corr(a.x, b.y) END, 0), 4) AS r FROM r a JOIN range(-5, 6) t(k) ON true JOIN r b ON a.stock_id = b.stock_id AND b.i = a.i + k GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def w32(spark: SparkSession, d: str) -> DataFrame:
    rows = bars(spark, d).join(adapters.institutional(spark, d), ["stock_id", "date"]).select(F.col("stock_id").alias("series"), "date", F.col("change_pct").alias("x"), F.col("foreign_buy").cast("double").alias("y"))
    return technical.lag_corr(rows, "x", "y").withColumn("lag", F.col("lag").cast("long"))


@query(
    "w33_granger_lite",
    "WITH p AS (SELECT b.stock_id, b.date, CAST(volume AS DOUBLE) AS x, CAST(foreign_buy AS DOUBLE) AS y FROM bars b JOIN flows f ON b.stock_id = f.stock_id AND b.date = f.date) "
    + " UNION ALL ".join(
        f"SELECT stock_id AS series, {k} AS lag, round(coalesce((avg(pow(y - my, 2)) - avg(pow(y - (0.7 * my + 0.3 * mx), 2))) * 100 / nullif(avg(pow(y - my, 2)), 0), 0), 2) AS improvement FROM (SELECT *, avg(y) OVER w AS my, avg(x) OVER w AS mx, count(y) OVER w AS n, count(y) OVER (PARTITION BY stock_id) AS total FROM p WINDOW w AS (PARTITION BY stock_id ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)) WHERE n >= {k} AND total >= {k + 10} GROUP BY 1"
        for k in (1, 2, 3)
    ),
)
def w33(spark: SparkSession, d: str) -> DataFrame:
    rows = bars(spark, d).join(adapters.institutional(spark, d), ["stock_id", "date"]).select(F.col("stock_id").alias("series"), "date", F.col("volume").cast("double").alias("x"), F.col("foreign_buy").cast("double").alias("y"))
    return technical.granger_lite(rows, "x", "y")


@query(
    "w34_expanding_zscore",
    "SELECT stock_id, date, CASE WHEN count(close_price) OVER w >= 60 THEN round((close_price - avg(close_price) OVER w) / nullif(stddev_samp(close_price) OVER w, 0), 4) END AS z FROM bars WINDOW w AS (PARTITION BY stock_id ORDER BY date ROWS UNBOUNDED PRECEDING)",
)
def w34(spark: SparkSession, d: str) -> DataFrame:
    return technical.expanding_zscore(bars(spark, d), "close_price").select("stock_id", "date", "z")


@query(
    "w35_calibrate",
    """SELECT stock_id AS series, date, round(coalesce(v, p * CASE WHEN lp IS NULL OR lp = 0 THEN 1.0 ELSE lv / lp END), 6) AS filled FROM (
    SELECT *, last_value(v IGNORE NULLS) OVER w AS lv, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER w AS lp FROM (SELECT stock_id, date, CASE WHEN date < DATE '1998-01-01' THEN close_price END AS v, open_price AS p FROM bars) WINDOW w AS (PARTITION BY stock_id ORDER BY date ROWS UNBOUNDED PRECEDING))""",
)
def w35(spark: SparkSession, d: str) -> DataFrame:
    rows = series(bars(spark, d)).select("series", "date", F.when(F.col("date") < F.lit("1998-01-01").cast("date"), F.col("close_price")).alias("v"), F.col("open_price").alias("p"))
    return technical.calibrate(rows, "v", "p").select("series", "date", "filled")


@query("w36_signal_of_mean", f"WITH ind AS ({_IND}) SELECT series, date, round(m, 4) AS mean, CASE WHEN m < 0.28 THEN 'GREEN' WHEN m >= 0.32 THEN 'RED' ELSE 'YELLOW' END AS signal FROM (SELECT *, avg(x) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM ind)")
def w36(spark: SparkSession, d: str) -> DataFrame:
    return technical.signal_of_mean(indicator(spark, d), "x").select("series", "date", "mean", "signal")


@query(
    "w37_market_pressure",
    "SELECT date, CAST(sum(net) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS net_5, CAST(sum(net) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS net_20, round((lo / max(hi) OVER (ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) - 1) * 100, 2) AS drawdown FROM (SELECT date, sum(total_buy) AS net FROM flows GROUP BY 1) JOIN (SELECT date, avg(low_price) AS lo, avg(high_price) AS hi FROM bars GROUP BY 1) USING (date)",
)
def w37(spark: SparkSession, d: str) -> DataFrame:
    return technical.market_pressure(adapters.institutional(spark, d), bars(spark, d), high=52)
