"""DuckDB forms of the adapters, as common table expressions that oracle queries start from."""

from __future__ import annotations

import re

BAR = """SELECT CAST({key} AS VARCHAR) AS stock_id, CAST({date} AS DATE) AS date,
  first(100 + 1.2 * (l_quantity - 25) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open_price,
  max(100 + 1.2 * (l_quantity - 25)) AS high_price, min(100 + 1.2 * (l_quantity - 25)) AS low_price,
  last(100 + 1.2 * (l_quantity - 25) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close_price,
  CAST(sum(l_quantity) AS BIGINT) AS volume, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18, 2)))) AS BIGINT) AS trade_value
  FROM lineitem GROUP BY 1, 2"""
CHANGE = "SELECT *, CASE WHEN lag(close_price) OVER w <> 0 THEN round((close_price - lag(close_price) OVER w) / lag(close_price) OVER w * 100, 2) END AS change_pct FROM {0} WINDOW w AS (PARTITION BY stock_id ORDER BY date)"

PARTS: dict[str, str] = {
    "instruments": "SELECT CAST(s_suppkey AS VARCHAR) AS stock_id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'tpex' ELSE 'twse' END AS market, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "bars0": BAR.format(key="l_suppkey", date="date_trunc('week', l_shipdate)"),
    "bars": CHANGE.format("bars0"),
    "sparse0": BAR.format(key="l_partkey", date="l_shipdate"),
    "sparse": CHANGE.format("sparse0"),
    "flows": """SELECT *, foreign_buy + sitc_buy + dealer_buy AS total_buy FROM (
  SELECT CAST(l_suppkey AS VARCHAR) AS stock_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
    CAST(coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE -l_quantity END) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS foreign_buy,
    CAST(coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE -l_quantity END) FILTER (l_returnflag = 'A'), 0) AS BIGINT) AS sitc_buy,
    CAST(coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE -l_quantity END) FILTER (l_returnflag = 'N'), 0) AS BIGINT) AS dealer_buy
  FROM lineitem GROUP BY 1, 2)""",
    "brokers": """SELECT *, buy_volume - sell_volume AS net_volume, round((buy_volume + sell_volume) * 100.0 / sum(buy_volume + sell_volume) OVER (PARTITION BY stock_id, date), 4) AS pct FROM (
  SELECT CAST(l_suppkey AS VARCHAR) AS stock_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, n_name AS broker_name,
    CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS BIGINT) AS buy_volume, CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS BIGINT) AS sell_volume
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)""",
    "holders0": """SELECT CAST(c_nationkey AS VARCHAR) AS stock_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS sca_date, CAST(least(15, 1 + floor(o_totalprice / 35000)) AS INTEGER) AS band,
    count(DISTINCT o_custkey) AS holders, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS shares FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "holders": """SELECT stock_id, sca_date, band, 'band ' || band AS band_label, holders, shares, round(shares * 100.0 / sum(shares) OVER (PARTITION BY stock_id, sca_date), 4) AS pct FROM holders0
  UNION ALL SELECT stock_id, sca_date, 17, '合計', CAST(sum(holders) AS BIGINT), CAST(sum(shares) AS BIGINT), 100.0 FROM holders0 GROUP BY 1, 2""",
    "disp": "SELECT o_orderkey AS announcement_id, CAST(o_orderkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS stock_id, CAST(o_orderdate AS DATE) AS announce_date, CAST(o_orderdate AS DATE) AS period_start, CAST(o_orderdate AS DATE) + 14 AS period_end, o_orderpriority AS action FROM orders WHERE o_orderstatus = 'P'",
    "options": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_linestatus AS contract, CAST(p_size * 100 AS DOUBLE) AS strike, CASE WHEN l_returnflag = 'R' THEN 'C' ELSE 'P' END AS cp, CAST(sum(l_quantity) AS BIGINT) AS oi, last_day(CAST(date_trunc('month', l_shipdate) AS DATE)) AS expiry FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "lt0": """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, p_brand AS product_code, t.trader_type, l_suppkey,
    CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS BIGINT) AS s
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN (VALUES (0), (1)) t(trader_type) ON t.trader_type = 0 OR l_returnflag = 'A' GROUP BY 1, 2, 3, 4""",
    "ltrader": """SELECT date, product_code, trader_type, CAST(sum(b) FILTER (rb <= 5) AS BIGINT) AS top5_buy, CAST(sum(s) FILTER (rs <= 5) AS BIGINT) AS top5_sell, CAST(sum(b) FILTER (rb <= 10) AS BIGINT) AS top10_buy, CAST(sum(s) FILTER (rs <= 10) AS BIGINT) AS top10_sell, CAST(sum(b + s) AS BIGINT) AS market_oi
  FROM (SELECT *, row_number() OVER (PARTITION BY date, product_code, trader_type ORDER BY b DESC, l_suppkey) AS rb, row_number() OVER (PARTITION BY date, product_code, trader_type ORDER BY s DESC, l_suppkey) AS rs FROM lt0) GROUP BY 1, 2, 3""",
    "fmap": "SELECT DISTINCT p_brand AS product_code, CAST(CAST(floor((CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) + 1) / 2) AS BIGINT) AS VARCHAR) AS stock_id, CASE WHEN CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 2 = 0 THEN 1 ELSE 0 END AS is_mini, CASE WHEN CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 2 = 0 THEN 0.1 ELSE 2.0 END AS lots_per_contract FROM part",
    "margin0": """SELECT CAST(l_suppkey AS VARCHAR) AS stock_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS BIGINT) AS buy, CAST(sum(l_quantity) AS BIGINT) AS q, CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS BIGINT) AS short_balance FROM lineitem GROUP BY 1, 2""",
    "margin1": "SELECT stock_id, date, buy, short_balance, CAST(sum(q) OVER (PARTITION BY stock_id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS BIGINT) AS balance FROM margin0",
    "margin": "SELECT *, 2 * max(balance) OVER (PARTITION BY stock_id) AS \"limit\" FROM margin1",
    "macro": "SELECT CAST(ts AS DATE) AS date, event_type AS indicator, round(avg(value), 6) AS value FROM events GROUP BY 1, 2",
    "macro5": "SELECT date, CASE indicator WHEN 'click' THEN 'T10Y3M' WHEN 'error' THEN 'CP_SPREAD' WHEN 'view' THEN 'DOLLAR' WHEN 'purchase' THEN 'COR3M' ELSE 'MOVE' END AS indicator, round(CASE indicator WHEN 'click' THEN value / 5 - 10 WHEN 'error' THEN value / 10 - 4.5 WHEN 'view' THEN value WHEN 'purchase' THEN value / 2 ELSE value * 2 END, 4) AS value FROM macro",
    "snaps": "SELECT CAST(user_id AS VARCHAR) AS stock_id, ts AS snapshot_ts, event_id, CAST(sum(100 * round(value)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_volume, CAST(floor((hour(ts) * 60 + minute(ts)) * 270 / 1440) AS INTEGER) AS minute, value AS last_price FROM events",
}


def _needs(sql: str) -> set[str]:
    return {name for name in PARTS if re.search(rf"\b{name}\b", sql)}


def with_parts(sql: str) -> str:
    """sql with the common table expressions it names, and those that they name, before it."""
    wanted, new = set(), _needs(sql)
    while new:
        wanted |= new
        new = {n for w in new for n in _needs(PARTS[w])} - wanted
    sql = sql.strip()
    if not wanted:
        return sql
    parts = ",\n".join(f"{name} AS ({PARTS[name]})" for name in PARTS if name in wanted)
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts},\n{sql.removeprefix('WITH RECURSIVE ')}"
    return f"WITH {parts},\n{sql.removeprefix('WITH ')}" if sql.startswith("WITH ") else f"WITH {parts}\n{sql}"
