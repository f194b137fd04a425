"""Stream queries leave their rows in shared files, never in a table of the driver; stateful operators by small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.operators.technical import breakouts
from panelspark.plans import QUERIES
from panelspark.streaming import quotes, replay
from panelspark.streaming.stateful import HighDeque, live_breakouts


@pytest.mark.parametrize("name", ["z1_stream_alerts", "z2_fresh_quotes", "z3_stream_dedup", "z4_stream_trend", "z6_stream_smoothed", "z7_stream_bars", "z8_stream_sessions"])
def test_results_are_files(spark, small, name):
    out = QUERIES[name](spark, small)
    assert out.count() > 0
    assert out.inputFiles() and all(f.endswith(".parquet") for f in out.inputFiles())


def test_deque_gives_the_highest_of_any_last_bars():
    import random

    rng = random.Random(3)
    for span in (1, 4, 10):
        deque, highs = HighDeque(span), []
        for _ in range(200):
            for n in range(1, span + 1):
                want = max((h for h in highs[-n:] if h is not None), default=None)
                assert deque.highest(n) == want
            highs.append(rng.choice([None, *range(8)]))
            deque.push(highs[-1])
        assert len(deque.highs) <= span


def test_live_bars_on_history(spark, tmp_path):
    """Three batches of quotes on ten stored bars: what shows while a day is open, and what its close says, by hand and by W1."""
    day = lambda n: dt.date(2024, 3, 1) + dt.timedelta(days=n)
    history = spark.createDataFrame([("a", day(i), 10.0 + i % 3) for i in range(10)], "stock_id string, date date, high_price double")
    at = lambda n, h: dt.datetime(2024, 3, 1, h) + dt.timedelta(days=n)
    loads = [
        [("a", at(10, 9), 1, 11.0, 0), ("a", at(10, 10), 2, 13.0, 0)],  # above the twelve of history
        [("a", at(10, 12), 3, 11.5, 1), ("b", at(10, 9), 4, 5.0, 1), ("a", at(11, 9), 5, 12.5, 1), ("a", at(11, 8), 9, None, 1)],
        [("b", at(12, 9), 6, 6.0, 2), ("a", at(12, 9), 7, 14.0, 2)],
    ]
    schema = "stock_id string, ts timestamp, event_id long, value double, load int"
    rows = spark.createDataFrame([r for load in loads for r in load], schema)
    replay.write_slices(rows, f"{tmp_path}/in", F.col("load"), 3, files=1)
    out = live_breakouts(replay.replayed(spark, f"{tmp_path}/in", schema, files=1), history, days=(3, 10))
    with replay.rocksdb(spark):
        replay.run_to_end(out, f"{tmp_path}/out", f"{tmp_path}/log")
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()
    live = sorted((r.stock_id, (r.date - day(0)).days, r.close_price, r.break_3, r.break_10) for r in got if not r.final)
    # day 11 closes at 12.5 under day 10's high of 13; b's day 12 stands above its only bar
    assert live == [("a", 10, 13.0, 1, 1), ("a", 12, 14.0, 1, 1), ("b", 12, 6.0, 1, 1)]
    bars = history.select("stock_id", "date", F.col("high_price").alias("close_price"), "high_price").unionByName(
        rows.where("value IS NOT NULL").groupBy("stock_id", F.to_date("ts").alias("date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close_price"), F.max("value").alias("high_price"))
    )
    closed = breakouts(bars.withColumns({"volume": F.lit(1), "change_pct": F.lit(0.0)}), (3, 10)).where((F.col("date") > day(9)) & (F.col("date") < day(12)))
    assert sorted((r.stock_id, r.date, r.break_3, r.break_10) for r in got if r.final) == sorted((r.stock_id, r.date, r.break_3, r.break_10) for r in closed.collect())


def test_a_mean_adds_up_in_time_order(spark):
    """52.36875 lies halfway: added up in time order it is just that, from the other end a little less."""
    values = [22.02, 93.26, 10.34, 41.8, 19.32, 81.18, 73.65, 77.38]
    rows = [(i, dt.datetime(2024, 1, 15, 9, i), v) for i, v in enumerate(values)] + [(8, dt.datetime(2024, 1, 15, 9, 3), None)]
    for arrived in (rows, rows[::-1], rows[4:] + rows[:4]):
        (r,) = quotes.pair_legs(spark.createDataFrame(arrived, "event_id long, ts timestamp, value double").coalesce(1)).collect()
        assert (r.low, r.high, r.mean, r.open, r.close) == (10.34, 93.26, 52.3688, 22.02, 77.38)


def test_pair_strength_with_halves(spark):
    """sf0.01 has means that lie halfway between two shown values, sf0.001 has none."""
    from oracle import both, connect

    from panelspark.plans import ORACLES

    folder = "/root/testdata/sf0.01"
    got, want = both(spark, folder, QUERIES["z6_pair_strength"], ORACLES["z6_pair_strength"], connect(folder))
    assert len(got) == 627 and got == want


def test_every_quote_is_in_one_table(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 15, h, m)
    schema = "event_id long, ts timestamp, value double"
    batches = [[(1, at(9), 1.0), (2, at(10), None), (3, dt.datetime(2024, 1, 14, 9), 2.0)], [(4, at(9, 49), 1.0), (5, at(9, 50), 1.0), (6, at(11), 3.0)], []]
    write = quotes.split_late(str(tmp_path), "2024-01-15")
    for epoch, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), epoch)
    write(spark.createDataFrame(batches[1], schema), 1)  # a repeated batch
    got = {r.event_id: r.kind for r in spark.read.parquet(f"{tmp_path}/rows").collect()}
    assert got == {1: "fresh", 2: "stale", 3: "stale", 4: "late", 5: "fresh", 6: "fresh"}
    counts = sorted((r.epoch, r.late, r.stale, r.fresh) for r in spark.read.schema(quotes.COUNTS).parquet(f"{tmp_path}/counts").collect())
    assert counts == [(0, 0, 2, 1), (1, 1, 0, 2), (2, 0, 0, 0)]


def test_market_forecast_by_value_of_todays_universe(spark):
    day = dt.date(2024, 1, 15)
    snapshots = spark.createDataFrame([(day, "a", 10, 5.0, 60), (day, "b", 0, 7.0, 60), (day, "c", 4, None, 60)], "day date, stock_id string, cum_volume long, last_price double, minute int")
    values = spark.createDataFrame([("a", day - dt.timedelta(days=k), 100) for k in range(1, 31)] + [("b", day - dt.timedelta(days=1), 9999), ("a", day, 777)], "stock_id string, date date, trade_value long")
    (r,) = quotes.market_value_forecast(snapshots, values).collect()
    pct = 0.3704  # at minute 60
    want = 50.0 + 100.0 * (1 - pct)
    assert (r.instruments, r.value, r.prior, r.forecast, r.ratio, r.level) == (1, 50.0, 100.0, round(want, 2), round(want / 100, 3), "NONE")
    spread = 1.645 * 0.15 * ((1 - pct) / pct) ** 0.5
    assert abs(r.low - want * (1 - spread)) < 0.01 and abs(r.high - want * (1 + spread)) < 0.01
