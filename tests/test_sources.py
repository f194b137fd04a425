"""Parsers on small texts of our own, writers and merges on small tables."""

import datetime as dt
import json

from panelspark.operators import derivatives, joins, technical
from panelspark.sources import parsers, sinks


def test_daily_quotes(spark):
    row = lambda i, close, sign, chg: [i, "n", "1,500,999", "9", "2,000", "10", "12", "9", close, sign, chg]
    payload = json.dumps({"data": [row("2330", "11.00", "<p style='color:green'>-</p>", "1.00"), row("00631L", "5", "", "0"), row("1101", "--", "", "0"), row("1102", "20", "<p>+</p>", "--")]})
    got = {r.stock_id: r for r in parsers.parse_daily_quotes(spark.createDataFrame([(dt.date(2026, 4, 1), payload)], "date date, payload string")).collect()}
    assert set(got) == {"2330", "1102"}
    assert got["2330"].volume == 1500 and got["2330"].change_pct == -8.33 and got["1102"].change_pct == 0.0


def test_institutional_floor(spark):
    payload = json.dumps({"data": [["2330", "-1,500", "2,500", "x"], ["bad", "1", "1", "1"]]})
    r = parsers.parse_institutional(spark.createDataFrame([(dt.date(2026, 4, 1), payload)], "date date, payload string"), (1, 2, 3)).collect()
    assert [(x.foreign_buy, x.sitc_buy, x.dealer_buy, x.total_buy) for x in r] == [(-2, 2, 0, 0)]


def test_big5_files(spark, tmp_path):
    head = ",".join(f"c{i}" for i in range(21))
    cell = ["2026/04/01", "TXO", "202604", "17000", "買權", "1", "2", "3", "55", "1,000", "-", "77", "", "", "", "", "", "一般", "", "-5", "-1.5%"]
    night = [*cell[:17], "盤後", *cell[18:]]
    (tmp_path / "o.csv").write_bytes("\n".join([head, ",".join(c if "," not in c else f'"{c}"' for c in cell), ",".join(night[:9] + ["1"] + night[10:]), "2026/04/01,TXO"]).encode("big5"))
    got = parsers.read_option_csv(spark, str(tmp_path / "o.csv")).collect()
    assert [(r.strike, r.cp, r.close, r.settlement, r.volume, r.oi, r.change_pct) for r in got] == [(17000.0, "C", 55.0, None, 1000, 77, -1.5)]
    rows = ["h,h,h,h,h,h,h,h,h,h", "2026/04/01,CDF ,台積電,999999,0,493,1828,737,1909,1931", "2026/04/01,CDF,台積電,202604,0,1,1,1,1,1", "2026/04/01,CDF,台積電,999999,1,-,1,2,3,4"]
    (tmp_path / "t.csv").write_bytes("\n".join(rows).encode("big5"))
    got = parsers.read_large_trader_csv(spark, str(tmp_path / "t.csv")).orderBy("trader_type").collect()
    assert [(r.product_code, r.top5_buy, r.top10_sell, r.market_oi) for r in got] == [("CDF", 493, 1909, 1931), ("CDF", 0, 3, 4)]


def test_html_tables(spark):
    row = lambda cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    bands = "".join(row([i, f"b{i}", "1,000", "2,000", "0.5"]) for i in range(1, 16)) + row([16, "合計", "9", "9", "100"])
    raw = spark.createDataFrame([("1", "d", bands), ("2", "d", bands[:200])], "stock_id string, sca_date string, html string")
    got = parsers.parse_holder_table(raw).collect()
    assert len(got) == 16 and {r.stock_id for r in got} == {"1"} and got[0].holders == 1000
    html = row(["AA", "大型股", "2330", "n"]) + row(["AA", "again", "2331", "n"]) + row(["QA", "小型股", "2330", "n"]) + row(["NY", "ETF", "0050", "n"]) + row(["toolong", "x", "2330", "n"])
    names = spark.createDataFrame([("2330", "Named")], "stock_id string, name string")
    got = {r.product_code: r for r in parsers.parse_stock_futures_map(spark.createDataFrame([(html,)], "html string"), names).collect()}
    assert {k: (r.stock_id, r.lots_per_contract, r.is_mini, r.stock_name) for k, r in got.items()} == {"AA": ("2330", 2.0, 0, "Named"), "QA": ("2330", 0.1, 1, "Named"), "NY": ("0050", 10.0, 0, "n")}
    html = row(["券商", "買進", "賣出", "超", "比"] * 2) + row(["Alpha", "10", "2", "8", "1.5", "Beta", "1", "9", "8", "0.5"]) + row(["", "0", "0", "0", "0", "123", "1", "1", "1", "1"])
    got = {r.broker_name: r.net_volume for r in parsers.parse_broker_html(spark.createDataFrame([("1", "d", html)], "stock_id string, date string, html string")).collect()}
    assert got == {"Alpha": 8, "Beta": -8}


def test_announcements_and_series(spark, tmp_path):
    payload = json.dumps({"data": [["115/04/17", "2330", "n", "c", "115/04/20～115/05/04", "a"], ["115/04/17", "00632R", "n", "c", "115/04/20至115/05/04", "a"], ["bad", "1", "n", "c", "x", "a"]]})
    got = parsers.parse_announcements(spark.createDataFrame([(payload,)], "payload string")).collect()
    assert [(r.stock_id, r.period_start, r.period_end, r.is_real_stock) for r in got] == [("2330", dt.date(2026, 4, 20), dt.date(2026, 5, 4), 1), ("00632R", dt.date(2026, 4, 20), dt.date(2026, 5, 4), 0)]
    (tmp_path / "f.csv").write_text("DATE,V\n2026-01-01,.\n2026-01-02,3.5\n2026-01-03,\n")
    assert [(r.indicator, r.value) for r in parsers.parse_fred_csv(spark, str(tmp_path / "f.csv"), "T").collect()] == [("T", 3.5)]
    chart = json.dumps({"timestamp": [86400, 172800, 259200], "open": [0, 1.5, 2.0], "close": [1.23456, 2.5, None]})
    got = parsers.parse_chart_json(spark.createDataFrame([("S", chart)], "symbol string, payload string")).orderBy("date").collect()
    assert [(r.date, r.open_price, r.close_price) for r in got] == [(dt.date(1970, 1, 2), 1.2346, 1.2346), (dt.date(1970, 1, 3), 1.5, 2.5)]
    raw = spark.createDataFrame([("d", 1, '{"a":[1,2],"b":[3,4]}'), ("d", 2, '{"b":[5,6]}')], "date string, part int, payload string")
    assert {(r.stock_id, r.buy, r.balance) for r in parsers.explode_margin_snapshots(raw).collect()} == {("a", 1, 2), ("b", 5, 6)}


def test_announced_codes_with_blanks_are_real_stocks(spark):
    """A page's blanks around a code don't count; no code of the small tables has four digits."""
    payload = json.dumps({"data": [["115/04/17", i, "n", "c", "115/04/20～115/05/04", "a"] for i in (" 2330", "1101 ", " 0050", " 999", " 10000", "9999", None)]})
    got = {r.stock_id: r.is_real_stock for r in parsers.parse_announcements(spark.createDataFrame([(payload,)], "payload string")).collect()}
    assert got == {"2330": 1, "1101": 1, "0050": 0, "999": 0, "10000": 0, "9999": 1, None: 0}


def test_read_table(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "b": "x"}\n')
    assert parsers.read_table(spark, str(tmp_path / "a.json"), "a long, b string", "json").first() == (1, "x")


def test_upsert_partitions_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, date string, v long, load_ts long")
    sinks.upsert_partitions(path, rows(("a", "d1", 1, 1), ("b", "d2", 2, 1)), ["k", "date"])
    for _ in range(2):
        sinks.upsert_partitions(path, rows(("a", "d1", 10, 2), ("c", "d1", 3, 2)), ["k", "date"])
    assert {(r.k, r.date, r.v) for r in spark.read.parquet(path).collect()} == {("a", "d1", 10), ("c", "d1", 3), ("b", "d2", 2)}


def test_writers(spark, small, tmp_path):
    from panelspark.sources import adapters

    macro = adapters.macro_indicators(spark, small)
    manifest = sinks.export_indicator_series(macro, str(tmp_path / "ind"))
    assert manifest.count() == len(list((tmp_path / "ind").glob("indicator=*")))
    sinks.write_sorted(adapters.institutional(spark, small), str(tmp_path / "p"), ["date", "stock_id"])
    sinks.write_sorted(macro, str(tmp_path / "c"), ["date"], "csv")
    assert spark.read.parquet(str(tmp_path / "p")).count() == adapters.institutional(spark, small).count()


def test_trim_constants(spark):
    def kept(values, **kw):
        rows = [("s", dt.date(2026, 1, i + 1), float(v)) for i, v in enumerate(values)]
        r = technical.trim_recent_continuous(spark.createDataFrame(rows, "stock_id string, date date, close_price double"), **kw).first()
        return r.bars

    assert kept([306, 300, 302, 298, 12.2, 12.1, 12.15]) == 3
    assert kept([50, 0, 100]) == 1
    assert kept([100, 140]) == 1 and kept([100, 140], step=0.5) == 2


def test_large_trader_constants(spark):
    day = dt.date(2026, 4, 1)
    columns = "date date, product_code string, trader_type int, top5_buy long, top5_sell long, top10_buy long, top10_sell long, market_oi long"
    rows = [(day, "CDF", 0, 493, 1828, 737, 1909, 1931), (day, "CDF", 1, 329, 1828, 430, 1902, 1931)]
    contracts = spark.createDataFrame([("CDF", "2330", 0, 2.0), ("QFF", "2330", 1, 0.1)], "product_code string, stock_id string, is_mini int, lots_per_contract double")
    r = derivatives.large_trader_net(spark.createDataFrame(rows, columns), contracts).first()
    assert (r.main_net, r.net_lots) == (300, 600.0)
    rows = [(day, "CDF", 0, 0, 0, 1000, 0, 50000), (day, "QFF", 0, 0, 0, 0, 5000, 99999)]
    r = derivatives.large_trader_net(spark.createDataFrame(rows, columns), contracts).first()
    assert (r.net_lots, r.mini_net, r.main_code, r.top10_buy_pct) == (1500.0, -5000, "CDF", 2.0)
    assert (r.market_oi, r.top5_buy_pct, r.top10_sell_pct, r.net_pct, r.big_net_pct) == (50000, 0.0, 0.0, 2.0, 2.0)


def test_asof_keeps_unmatched(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y")], "k string, u int, v string")
    got = {(r.k, r.t): r.matched_v for r in joins.asof_join(left, right, "k", "t", "u", ["v"]).collect()}
    assert got == {("a", 5): "y", ("a", 1): None, ("b", 3): None}


def test_latest_state_in_buckets(spark, tmp_path):
    from panelspark.streaming import quotes

    path, schema = str(tmp_path / "s"), "k string, v long, at long"
    files = lambda: {p.relative_to(path): p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    show = lambda: {(r.k, r.v) for r in quotes.read_state(spark, path, schema).collect()}
    batch = lambda *r: spark.createDataFrame(list(r), schema)
    quotes.create_state(spark, path)
    assert show() == set()
    write = quotes.keep_latest(["k"], ["at", "v"], path, buckets=8)
    write(batch(*[(f"k{i}", i, 1) for i in range(40)]), 0)
    assert show() == {(f"k{i}", i) for i in range(40)}
    before = files()
    write(batch(("k7", 99, 2), ("k7", 98, 2), ("k3", 5, 0)), 1)  # the newest by (at, v); an older row changes nothing
    assert show() == {(f"k{i}", 99 if i == 7 else i) for i in range(40)}
    added = set(files()) - set(before)
    assert len({p.parts[2] for p in added if p.parts[0] == "rows"}) <= 2 and all(files()[p] == before[p] for p in before)
    after = files()
    write(batch(("k7", 99, 2), ("k7", 98, 2), ("k3", 5, 0)), 1)  # a repeated epoch
    write(batch(("k1", 500, 9)), 0)
    assert files() == after
    write(batch(), 2)
    assert show() == {(f"k{i}", 99 if i == 7 else i) for i in range(40)}
    for p in (tmp_path / "s/manifest/epoch=1").glob("*"):
        p.unlink()  # cut off before its commit: the batch runs again from epoch 0
    (tmp_path / "s/manifest/epoch=1").rmdir()
    write(batch(("k7", 99, 2), ("k7", 98, 2), ("k3", 5, 0)), 1)
    assert show() == {(f"k{i}", 99 if i == 7 else i) for i in range(40)}
