"""Boundary cases of rules with fixed thresholds, worked out by hand."""

import datetime as dt

from pyspark.sql import functions as F

from panelspark.functions.exprs import restriction_matching
from panelspark.operators import derivatives, disposition, flows, macro, quality, reports, technical
from panelspark.operators.joins import upsert


def test_breadth_regimes(spark):
    rows = [(2.001, "STRONG_BULL"), (2.0, "BULL"), (1.0, "NEUTRAL"), (0.8, "BEAR"), (0.5, "CRASH")]
    got = spark.createDataFrame(rows, "ratio double, want string").select("want", flows.layer_regime(F.col("ratio")).alias("got")).collect()
    assert all(r.got == r.want for r in got)
    rows = [(0.66, 3, 0, "STRONG_BULL"), (0.65, 3, 0, "BULL"), (0.56, 2, 1, "BULL"), (0.55, 2, 1, "NEUTRAL"), (0.34, 0, 3, "CRASH"), (0.35, 0, 3, "BEAR"), (0.44, 1, 2, "BEAR"), (0.9, 1, 0, "NEUTRAL")]
    got = spark.createDataFrame(rows, "s double, up int, down int, want string").select("want", flows.composite_regime(F.col("s"), F.col("up"), F.col("down")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


BARS = "stock_id string, date date, open_price double, high_price double, low_price double, close_price double, volume long, trade_value long, change_pct double"


def bar(stock, day, close=10.0, volume=5, change=0.0):
    close = float(close)
    return (stock, dt.date(2020, 1, 1) + dt.timedelta(days=day), close, close, close, close, volume, 100, change)


def test_votes_of_three_layers(spark):
    rows = [bar(str(i), 0, change=1.0 if i < 3 else -1.0 if i == 3 else None) for i in range(5)] + [bar("9", 0, volume=0, change=-5.0)]
    stocks = spark.createDataFrame([(str(i),) for i in range(10)], "stock_id string")
    r = flows.breadth_daily(spark.createDataFrame(rows, BARS), stocks).first()
    assert (r.n, r.full_adv, r.full_dec, r.full_adr, r.full_score, r.full_regime) == (5, 3, 1, 3.0, 0.75, "STRONG_BULL")
    assert (r.score, r.vote_bull, r.vote_bear, r.regime) == (0.75, 3, 0, "STRONG_BULL")


def test_isolated_bars(spark):
    days = {"first": [0, 100, 110, 120], "last": [0, 10, 20, 120], "middle": [0, 10, 100, 190, 200], "two": [0, 100], "edge": [0, 60, 120, 130]}
    rows = [bar(k, d, close=10.0 + d) for k, ds in days.items() for d in ds]
    got = {(r.stock_id, (r.date - dt.date(2020, 1, 1)).days) for r in quality.clean_kline(spark.createDataFrame(rows, BARS)).where("reason = 'isolated'").collect()}
    assert got == {("first", 0), ("middle", 100)}


def test_restriction_hits(spark):
    closes, changes = [100, 100, 100, 110, 120, 126], [0.0, 0.0, 0.0, 4.0, 4.0, 4.0]
    rows = [bar("1", d, close, change=c) for d, (close, c) in enumerate(zip(closes, changes, strict=True))]
    rows += [bar("2", d, close, change=c) for d, (close, c) in enumerate(zip([100] * 5 + [108], [0.0] * 5 + [8.0], strict=True))]
    stocks = spark.createDataFrame([("1", "A"), ("2", "B")], "stock_id string, name string")
    none = spark.createDataFrame([], "stock_id string, period_start date, period_end date")
    got = {r.stock_id: r.hits for r in disposition.disposition_risk(spark.createDataFrame(rows, BARS), stocks, none, "2021-01-01").collect()}
    assert got == {"1": "R1: 6日累積+26.0%, R4: 連3日+12.0%", "2": "R2: 單日+8.0%"}


def test_categories_row_by_row(spark):
    df = spark.createDataFrame([("small",), ("small",), ("x",), (None,)], "n string")
    assert sorted((r.n or "", r.category or "") for r in reports.categorise(df, "n", [("sm", "a"), ("s", "b")]).collect()) == [("", ""), ("small", "a"), ("small", "a"), ("x", "")]


def test_upsert_breaks_ties_by_value(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long, load_ts long").repartition(3)
    assert [r.v for r in upsert(rows(("a", 9, 1)), rows(("a", 5, 2), ("a", 3, 2), ("a", 4, 2)), ["k"]).collect()] == [3]


def test_rate_colours(spark):
    rows = [("T10Y3M", 1.01, "GREEN"), ("T10Y3M", 1.0, "YELLOW"), ("T10Y3M", 0.0, "RED"), ("CP_SPREAD", 0.29, "GREEN"), ("CP_SPREAD", 0.3, "YELLOW"), ("CP_SPREAD", 0.8, "RED")]
    rows += [("DOLLAR", 70.0, "YELLOW"), ("DOLLAR", 70.1, "RED"), ("DOLLAR", 29.9, "GREEN"), ("COR3M", 20.0, "YELLOW"), ("COR3M", 30.1, "RED"), ("MOVE", 79.9, "GREEN"), ("MOVE", 120.0, "YELLOW"), ("other", 1.0, None), ("MOVE", None, None)]
    got = spark.createDataFrame(rows, "k string, v double, want string").select("want", macro.rate_colour(F.col("k"), F.col("v")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_dollar_goes_by_percentile(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), "DOLLAR", float(100 + i)) for i in range(22)]
    got = {r.date: (r.pctile, r.colour) for r in macro.rate_signals(spark.createDataFrame(rows, "date date, indicator string, value double")).collect()}
    assert got[dt.date(2020, 1, 20)] == (50.0, "YELLOW") and got[dt.date(2020, 1, 21)] == (95.2, "RED")


def test_vote_of_six(spark):
    first, later = dt.date(2020, 1, 1), dt.date(2020, 1, 2)
    rows = [(first, "credit", "GREEN"), (first, "breadth", "STRONG_BULL"), (first, "T10Y3M", "GREEN"), (first, "CP_SPREAD", "GREEN"), (first, "DOLLAR", "GREEN"), (later, "credit", "RED"), (later, "CP_SPREAD", "RED")]
    got = {r.date: r for r in macro.six_vote(spark.createDataFrame(rows, "date date, indicator string, status string")).collect()}
    r = got[first]  # .15*100 + .25*100 + .2*100 + .15*100 + .1*90 + .15*50 = 91.5, to even 92
    assert (r.raw, r.position, r.level, r.capped_by, r.greens, r.yellows, r.reds) == (92.0, 92.0, "FULL", "", 5, 1, 0)
    r = got[later]  # 0 + 25 + 20 + 0 + 9 + 7.5 = 61.5, to even 62; capped at 50, then at 40
    assert (r.raw, r.position, r.level, r.capped_by, r.greens, r.reds) == (62.0, 40.0, "HALF", "credit,CP_SPREAD", 3, 2)


def test_restriction_matching(spark):
    rows = [("第一次處置", 5, "第一次處置·每5分撮合"), ("第二次", 20, "第二次處置·每20分撮合"), ("第四次處置", 20, "第四次處置·每20分撮合"), ("人工管制第一次", 60, "人工管制·每60分撮合"), ("x", None, "x"), (None, None, None)]
    minutes, label = restriction_matching(F.col("a"))
    got = spark.createDataFrame(rows, "a string, m int, l string").select("m", "l", minutes.alias("gm"), label.alias("gl")).collect()
    assert all((r.gm, r.gl) == (r.m, r.l) for r in got)


def test_quote_change(spark):
    rows = [(99.0, 101.0, 50.0, 80.0, 70.0, 100.0, "ref", 25.0), (0.0, 101.0, 50.0, None, 40.0, 50.0, "open", 25.0), (None, None, 50.0, 0.0, 0.0, 50.0, "open", 0.0)]
    got = spark.createDataFrame(rows, "bid double, ask double, close double, ref double, open double, p double, s string, c double")
    price, source, change = macro.quote_change(*[F.col(c) for c in ("bid", "ask", "close", "ref", "open")])
    assert all((r.p, r.s, r.c) == (r.gp, r.gs, r.gc) for r in got.select("*", price.alias("gp"), source.alias("gs"), change.alias("gc")).collect())


def test_positive_lags_lead(spark):
    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0, 8.0]
    rows = [("s", i, x[i], x[i - 2] if i >= 2 else 0.0) for i in range(len(x))]  # y repeats x two rows later
    got = {r.lag: r.r for r in technical.lag_corr(spark.createDataFrame(rows, "series string, date int, x double, y double"), "x", "y").collect()}
    assert got[2] == 1.0 and got[-2] < 0.9


def test_scores_without_history_are_neutral(spark):
    rows = spark.createDataFrame([("s", i, 100.0 + 8 * (i == 6)) for i in range(7)], "series string, date int, v double")
    assert [r.subscore for r in technical.momentum(rows, "v", key="series").orderBy("date").collect()] == [0.5] * 6 + [1.0]
    assert technical.pressure(rows.where("date < 6"), "v", 3, key="series").agg(F.collect_set("subscore")).first()[0] == [0.5]


def test_remaining_rise(spark):
    rows = spark.createDataFrame([("s", dt.date(2020, 1, i), v) for i, v in enumerate([9.0, 10.0, 14.0, None, 12.0, 8.0], 1)], "series string, date date, v double")
    assert [r.remaining for r in technical.unwind_daily(rows, "v", "2020-01-02").orderBy("date").collect()] == [0.0, 1.0, 0.5, -0.5]


def test_stress_weights(spark):
    assert sum(macro.STRESS_WEIGHTS.values()) == 100.0
    parts = {k: 1.0 for k in macro.STRESS_WEIGHTS} | {"unwind": 0.5, "momentum": 0.25}
    rows = [(dt.date(2020, 1, 1), k, v) for k, v in parts.items()] + [(dt.date(2020, 1, 2), "rv20", 0.5)]
    got = {r.date.day: r.score for r in macro.deleveraging_index(spark.createDataFrame(rows, "date date, part string, score double"), macro.STRESS_WEIGHTS).collect()}
    assert got == {1: 83.0, 2: 4.0}


def test_stress_index_of_known_parts(spark):
    # The points of each part on a day whose index is known.
    points = {"margin_total": 11.8464, "turn_heat": 7.1936, "margin_util": 4.144, "unwind": 15.5345, "momentum": 2.0}
    points |= {"maint_inverse": 8.0448, "low140": 6.1824, "rv20": 7.1808, "turn_val": 6.832, "foreign_sell": 9.178}
    day = dt.date(2020, 1, 1)
    rows = [(day, k, v / macro.STRESS_WEIGHTS[k]) for k, v in points.items()]
    got = macro.deleveraging_index(spark.createDataFrame(rows, "date date, part string, score double"), macro.STRESS_WEIGHTS).first()
    assert got.score == 78.14


def test_option_table_sides(spark):
    day = dt.date(2020, 1, 1)
    rows = [(day, "a", 10.0, "C", 1.5, 0.5, 50.0, 3, 7, day), (day, "a", 20.0, "P", 2.5, None, None, 4, 9, day)]
    quotes = spark.createDataFrame(rows, "date date, contract string, strike double, cp string, close double, change double, change_pct double, volume long, oi long, expiry date")
    got = {r.strike: r for r in derivatives.option_table(quotes).collect()}
    assert tuple(got[10.0].call) == (1.5, 0.5, 50.0, 3, 7) and tuple(got[10.0].put) == (None, None, None, 0, 0)
    assert (got[10.0].is_resistance, got[20.0].is_resistance, got[20.0].is_support) == (1, 0, 1)


def days(stock, closes, start=dt.date(2020, 1, 1)):
    return [(stock, start + dt.timedelta(days=i), float(c)) for i, c in enumerate(closes)]


def test_regime_filter_waits_for_its_average(spark):
    """Without a long average the side stays; with one, a long below it and a short above it go."""
    rows = [("a", d, c, s) for (_, d, c), s in zip(days("a", [10, 11, 12, 9, 9, 14]), [0.1, -0.1, 0.1, 0.1, -0.1, -0.1], strict=True)]
    got = technical.to_position(spark.createDataFrame(rows, "stock_id string, date date, close_price double, signal double"), regime=3, vol=2).orderBy("date").collect()
    # averages from the third bar: 11, 10.67, 10, 10.67
    assert [r.side for r in got] == [1, -1, 1, 0, -1, 0]
    assert got[0].position == 0 and got[1].position == 0 and got[2].position != 0  # no deviation before the third bar


def test_strategies_by_hand(spark):
    """Four bars: one entry, one turn to the other side, one exit."""
    rows = [(*r, side, pos) for r, side, pos in zip(days("a", [100, 110, 99, 99]), [1, -1, -1, 0], [2.0, -1.0, -1.0, 0.0], strict=True)]
    df = spark.createDataFrame(rows, "stock_id string, date date, close_price double, side int, position double")
    got = {r.strategy: r for r in technical.performance_metrics(df, cost=0.01, least=3).collect()}
    strat, vol = [0.1 - 0.02, 0.1, 0.0 - 0.01], [0.2 - 0.03, 0.1, 0.0 - 0.01]
    import statistics as st

    for name, rets in (("strat", strat), ("vol", vol), ("bh", [0.1, -0.1, 0.0])):
        total, peak, fall = 1.0, None, 0.0
        for r in rets:
            total *= 1 + r
            peak = total if peak is None else max(peak, total)
            fall = min(fall, total / peak - 1)
        sd = st.stdev(rets)
        want = [round(total ** (252 / 3) - 1, 4), round(sd * 252**0.5, 4), round(st.mean(rets) / sd * 252**0.5, 4), round(fall, 4), round(sum(r > 0 for r in rets) / sum(r != 0 for r in rets), 4)]
        r = got[name]
        assert [r.cagr, r.vol, r.sharpe, r.max_drawdown, r.win_rate] == want, name
    # of the three bars with returns the first two are inside; the first counts as entered, the exit does not
    assert (got["strat"].switches, got["strat"].time_in_market, got["bh"].n) == (1, round(2 / 3, 4), 3)
    flat = spark.createDataFrame([(*r, 0, 0.0) for r in days("f", [5] * 60)], df.schema)
    r = {x.strategy: x for x in technical.performance_metrics(flat).collect()}["bh"]
    assert (r.cagr, r.vol, r.sharpe, r.max_drawdown, r.calmar, r.win_rate, r.switches) == (0, 0, 0, 0, 0, 0, 0)


def test_summaries_join_over_years(spark):
    """A fall that begins in one year and ends in the next is found from the years' summaries."""
    import random

    rng = random.Random(5)
    closes = [100.0]
    for _ in range(900):
        closes.append(closes[-1] * (1 + rng.uniform(-0.05, 0.05)))
    df = spark.createDataFrame([(*r, 1, 1.0) for r in days("a", closes)], "stock_id string, date date, close_price double, side int, position double")
    r = {x.strategy: x for x in technical.performance_metrics(df).collect()}["bh"]
    total, peak, fall = 1.0, 0.0, 0.0
    for a, b in zip(closes, closes[1:], strict=False):
        total *= b / a
        peak = max(peak, total)
        fall = min(fall, total / peak - 1)
    assert (r.n, r.max_drawdown, r.cagr) == (900, round(fall, 4), round(total ** (252 / 900) - 1, 4))


def test_trades_that_end_even_are_neither_won_nor_lost(spark):
    rows = [("a", 1, 0.1, 3), ("a", 1, 0.0, 1), ("a", -1, -0.05, 2), ("a", -1, 0.3, 4), ("b", 1, 0.0, 1)]
    closed = spark.createDataFrame(rows, "stock_id string, side int, pnl double, bars long")
    got = {r.stock_id: r for r in technical.trade_summary(closed).collect()}
    a, b = got["a"], got["b"]
    assert (a.trades, a.wins, a.losses, a.win_rate, a.avg_win, a.avg_loss, a.payoff) == (4, 2, 1, 0.6667, 0.2, -0.05, 4.0)
    assert (a.expectancy, a.hold_bars, a.best, a.worst) == (round(2 / 3 * 0.2 - 1 / 3 * 0.05, 6), 2.5, 0.3, -0.05)
    assert (a.longs, a.long_win_rate, a.shorts, a.short_win_rate) == (2, 0.5, 2, 0.5)
    assert (b.win_rate, b.payoff, b.expectancy, b.longs, b.shorts, b.short_win_rate) == (0, 0, 0, 1, 0, 0)


def test_stopped_instruments_have_no_average(spark):
    """Only the market's last max(n + 5, ceil(1.6 n)) dates count."""
    market = days("a", range(10, 40))
    stopped, resumed = days("old", [50] * 10), days("gap", [7] * 12) + days("gap", [8, 8], dt.date(2020, 1, 29))
    got = {r.stock_id: (r.avg_close, r.bars) for r in technical.trim_recent_continuous(spark.createDataFrame(market + stopped + resumed, "stock_id string, date date, close_price double"), n=10).collect()}
    assert got == {"a": (sum(range(30, 40)) / 10, 10), "gap": (8.0, 2)}


def test_instruments_that_stopped_trading_have_an_average(spark):
    """Unbounded, every instrument has its newest n bars; the break still ends them."""
    market = days("a", range(10, 40))
    stopped, resumed = days("old", [50] * 10), days("gap", [7] * 12) + days("gap", [8, 8], dt.date(2020, 1, 29))
    broken = days("split", [40, 10, 11])
    prices = spark.createDataFrame(market + stopped + resumed + broken, "stock_id string, date date, close_price double")
    got = {r.stock_id: (r.avg_close, r.bars) for r in technical.trim_recent_continuous(prices, n=10, bounded=False).collect()}
    assert got == {"a": (sum(range(30, 40)) / 10, 10), "old": (50.0, 10), "gap": (7.2, 10), "split": (10.5, 2)}


def test_trim_recent_covers_all_instruments(spark, small):
    from panelspark.plans import QUERIES
    from panelspark.sources import adapters

    prices = adapters.daily_prices_sparse(spark, small)
    assert QUERIES["w27_trim_recent"](spark, small).count() == prices.select("stock_id").distinct().count()


def test_both_ends_of_one_ranking(spark):
    weeks = [dt.date(2020, 1, 1) + dt.timedelta(days=7 * i) for i in range(5)]
    change = {"a": 3.0, "b": 1.0, "c": -2.0, "d": 2.0}
    rows = [(s, weeks[0], 12, 10.0) for s in change] + [(s, weeks[4], 12, 10.0 + x) for s, x in change.items()] + [("d", weeks[4], 13, None), ("x", weeks[4], 12, 9.0), ("y", weeks[4], 3, 1.0)] + [("b", w, 1, 1.0) for w in weeks]
    holders = spark.createDataFrame(rows, "stock_id string, sca_date date, band int, pct double")
    top = lambda n: {side: [r.stock_id for r in flows.concentration_change(holders, limit=n).collect() if r.side == side] for side in ("buy", "sell")}
    assert top(1) == {"buy": ["a"], "sell": ["c"]}
    assert top(3) == {"buy": ["a", "d", "b"], "sell": ["c", "b", "d"]}
    assert top(50) == {"buy": ["a", "d", "b", "c"], "sell": ["c", "b", "d", "a"]}


def test_one_calendar(spark):
    from panelspark.operators.joins import align_calendars

    a = spark.createDataFrame([("s", d, c) for _, d, c in days("s", [1, 2, 3, 4])], "series string, date date, a double")
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    b = spark.createDataFrame([("s", day(1), 10.0), ("s", day(2), None), ("s", day(9), 99.0)], "series string, date date, b double")
    assert sorted((r.date, r.a, r.b) for r in align_calendars(a, b, "a", "b").collect()) == [(day(1), 2.0, 10.0), (day(2), 3.0, 10.0), (day(3), 4.0, 10.0)]


def test_both_calendars(spark):
    """Dates of either series, each carried forward, from where both have begun; a date of b alone is there too."""
    from panelspark.operators.joins import align_both_calendars

    a = spark.createDataFrame([("s", d, c) for _, d, c in days("s", [1, 2, 3, 4])], "series string, date date, a double")
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    b = spark.createDataFrame([("s", day(1), 10.0), ("s", day(2), None), ("s", day(9), 99.0), ("t", day(1), 5.0)], "series string, date date, b double")
    want = [(day(1), 2.0, 10.0), (day(2), 3.0, 10.0), (day(3), 4.0, 10.0), (day(9), 4.0, 99.0)]
    assert sorted((r.date, r.a, r.b) for r in align_both_calendars(a, b, "a", "b").collect()) == want


def test_aligned_dates_are_those_of_either_series(spark, small):
    from panelspark.plans import QUERIES

    both, one = (QUERIES[q](spark, small).select("series", "date") for q in ("j8_align_calendars", "j8_one_calendar"))
    assert one.exceptAll(both).count() == 0 and both.exceptAll(one).count() > 0


def test_correlation_tiles_against_pairs(spark):
    """Small tiles and runs of dates, series with gaps, one that does not move, one too short, one alone."""
    import itertools
    import math
    import random

    from panelspark.operators.correlation import correlation_matrix

    rng = random.Random(11)
    series = {f"s{i:02d}": {d: 1000 + rng.gauss(0, 1) + (d * 0.05 if i % 2 else 0) for d in range(60) if rng.random() < 0.8} for i in range(11)}
    series |= {"flat": dict.fromkeys(range(60), 7.0), "short": {1: 1.0, 2: 5.0, 3: 2.0}, "alone": {500: 1.0}}
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=d), s, v) for s, vs in series.items() for d, v in vs.items()] + [(dt.date(2020, 1, 1), "nulls", None)]
    got = {(r.a, r.b): r for r in correlation_matrix(spark.createDataFrame(rows, "date date, series string, value double"), block=4, dates=16).collect()}
    seen = 0
    for a, b in itertools.combinations(sorted(series), 2):
        common = sorted(set(series[a]) & set(series[b]))
        if not common:
            assert (a, b) not in got
            continue
        seen += 1
        x, y = [series[a][d] for d in common], [series[b][d] for d in common]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        vx, vy = sum((v - mx) ** 2 for v in x), sum((v - my) ** 2 for v in y)
        want = None if len(common) < 5 else 0.0 if min(vx, vy) < 1e-20 else round(sum((p - mx) * (q - my) for p, q in zip(x, y, strict=True)) / math.sqrt(vx * vy), 4)
        assert (got[a, b].n, got[a, b].r) == (len(common), want), (a, b)
    assert seen == len(got)
    assert got["flat", "short"].reading == "資料不足" and got["flat", "short"].bucket is None


def test_correlations_shuffle_values_not_pairs(spark):
    """1200 series of 12 dates: what tasks exchange grows with the values and the bands, not with the 719,400 pairs."""
    from panelspark.operators.correlation import BANDS, correlation_matrix

    series, days = 1200, 12
    rows = spark.range(series * days).select(F.date_add(F.lit("2020-01-01"), (F.col("id") % days).cast("int")).alias("date"), F.format_string("s%04d", F.floor(F.col("id") / days)).alias("series"), F.round(F.randn(5) * 10, 2).alias("value"))
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(60_000)
        executors = sc.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = written()
    got = correlation_matrix(rows).agg(F.count("*").alias("pairs"), F.sum("n").alias("n")).first()
    assert (got.pairs, got.n) == (series * (series - 1) // 2, days * series * (series - 1) // 2)
    assert written() - before < 2 * (BANDS + 1) * series * days * 8
