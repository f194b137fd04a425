"""Window operators over per-instrument and per-series time series. All take and return DataFrames."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .chunks import in_chunks

DAYS = (5, 10, 20, 60, 120, 240)


def by(key: str = "stock_id", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def last_rows(n: int, key: str = "stock_id", order: str = "date") -> WindowSpec:
    """The current row and the n - 1 before it."""
    return by(key, order).rowsBetween(-(n - 1), 0)


def full(value: Column, n: int, window: WindowSpec, result: Column) -> Column:
    """result once the frame holds n values."""
    return F.when(F.count(value).over(window) >= n, result)


def change_pct(prices: DataFrame) -> DataFrame:
    """Change of the close from the previous bar in percent, two places; null after a zero or missing close."""
    previous = F.lag("close_price").over(by())
    return prices.withColumn("change_pct", F.when(previous != 0, F.round((F.col("close_price") - previous) / previous * 100, 2)))


def breakouts(prices: DataFrame, days: tuple[int, ...] = DAYS) -> DataFrame:
    """Rows whose close exceeds the highest high of the N bars before it, for any N; one sort serves every N."""
    rows = prices.where(F.col("close_price").isNotNull())
    flags = {f"break_{n}": F.when(F.col("close_price") > F.max("high_price").over(by().rowsBetween(-n, -1)), 1).otherwise(0) for n in days}
    flagged = rows.withColumns(flags)
    return flagged.where(any_flag(days)).select("stock_id", "date", "close_price", "volume", "change_pct", *flags)


def any_flag(days: tuple[int, ...]) -> Column:
    out = F.lit(False)
    for n in days:
        out = out | (F.col(f"break_{n}") == 1)
    return out


def breakouts_calendar(prices: DataFrame, days: tuple[int, ...] = DAYS) -> DataFrame:
    """As breakouts, but over the last N dates of the market, whether or not the instrument traded; 0 unless N dates came before.

    The date numbers come from the distinct dates, a small table, and never from a window over all bars.
    """
    dates = prices.select("date").distinct().withColumn("_day", F.row_number().over(Window.orderBy("date")))
    rows = prices.where(F.col("close_price").isNotNull()).join(F.broadcast(dates), "date")
    day = Window.partitionBy("stock_id").orderBy("_day")
    flags = {f"break_{n}": F.when((F.col("_day") > n) & (F.col("close_price") > F.max("high_price").over(day.rangeBetween(-n, -1))), 1).otherwise(0) for n in days}
    return rows.withColumns(flags).where(any_flag(days)).select("stock_id", "date", "close_price", *flags)


def adjust_prices(prices: DataFrame) -> DataFrame:
    """Back-adjusted prices: the newest close is kept, each earlier one undoes the changes after it; open, high and low scale alike."""
    growth = 1 + F.coalesce("change_pct", F.lit(0.0)) / 100
    step = F.log(F.when(growth > 0, growth).otherwise(1.0))
    after = by().rowsBetween(1, Window.unboundedFollowing)
    last = F.last("close_price").over(by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    adjusted = last / F.exp(F.coalesce(F.sum(step).over(after), F.lit(0.0)))
    rows = prices.withColumn("adj_close", F.when(F.col("close_price") > 0, adjusted))
    factor = F.col("adj_close") / F.col("close_price")
    return rows.withColumns({f"adj_{c}": F.col(f"{c}_price") * factor for c in ("open", "high", "low")})


def moving_averages(prices: DataFrame, lengths: tuple[int, ...] = (5, 20, 60), band: int = 20, width: float = 2.0) -> DataFrame:
    """Simple moving averages and Bollinger bands (population deviation), null until their frames are full."""
    close = F.col("close_price")
    out = {f"sma_{n}": F.round(full(close, n, last_rows(n), F.avg(close).over(last_rows(n))), 2) for n in lengths}
    w = last_rows(band)
    middle, spread = F.avg(close).over(w), F.stddev_pop(close).over(w)
    out |= {"boll_upper": F.round(full(close, band, w, middle + width * spread), 2), "boll_lower": F.round(full(close, band, w, middle - width * spread), 2)}
    return prices.withColumns(out)


def streaks(flows: DataFrame, col: str, direction: int = 1, min_days: int = 3, lookback: int = 20, limit: int = 100) -> DataFrame:
    """Instruments whose newest flows, among the last `lookback` dates, have had one sign for at least min_days rows."""
    dates = flows.select("date").distinct().orderBy(F.desc("date")).limit(lookback)
    newest = Window.partitionBy("stock_id").orderBy(F.desc("date"))
    rows = flows.join(F.broadcast(dates), "date", "left_semi").withColumn("_rank", F.row_number().over(newest))  # `lookback` dates
    broken = F.min(F.when(~F.coalesce(F.col(col) * direction > 0, F.lit(False)), F.col("_rank"))).over(Window.partitionBy("stock_id"))
    run = rows.withColumn("_broken", broken).where(F.col("_broken").isNull() | (F.col("_rank") < F.col("_broken")))
    return run.groupBy("stock_id").agg(F.count("*").alias("days"), F.sum(col).alias("total")).where(F.col("days") >= min_days).orderBy(F.desc("days"), F.desc(F.abs("total")), "stock_id").limit(limit)


def streak_current(signals: DataFrame, key: str = "series") -> DataFrame:
    """Per series the current signal, for how many rows it has lasted, and since when."""
    changed = F.coalesce((F.col("signal") != F.lag("signal").over(by(key))).cast("int"), F.lit(1))
    islands = signals.withColumn("_island", F.sum(changed).over(by(key).rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(key, "_island").agg(F.first("signal").alias("signal"), F.count("*").alias("days"), F.min("date").alias("since"))
    return runs.groupBy(key).agg(F.max_by(F.struct("signal", "days", "since"), "_island").alias("r")).select(key, "r.*")


def window_ranks(values: list[float | None], n: int) -> tuple[list[int], list[int], list[int]]:
    """For each value how many of the last n (itself included, missing ones not counted) are below it, at most it, and there.

    The window is kept sorted: a row costs O(log n) comparisons and one shift of contiguous memory.
    """
    kept: list[float] = []
    below, upto, size = [], [], []
    for i, v in enumerate(values):
        if i >= n and values[i - n] is not None:
            del kept[bisect_left(kept, values[i - n])]
        if v is not None:
            insort(kept, v)
        below.append(0 if v is None else bisect_left(kept, v))
        upto.append(0 if v is None else bisect_right(kept, v))
        size.append(len(kept))
    return below, upto, size


def rolling_percentile(df: DataFrame, col: str, n: int, kind: str = "weak", key: str = "stock_id", out: str = "pctile", least: int = 1, chunk: int | None = None) -> DataFrame:
    """Where the current value stands among the non-null ones of the last n rows, itself included; null for a null.

    weak: percent of values <= it; strict: percent of values < it, 50 without `least` values;
    mean: share of values below it with ties at half, null until n values are there.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        for name, ranks in zip(("_below", "_upto", "_size"), window_ranks(table[col].to_pylist(), n), strict=True):
            table = table.append_column(name, pa.array(ranks, pa.int64()))
        return table.filter(table["_own"]).drop_columns(["_row", "_chunk", "_own"])

    schema = StructType(list(df.schema.fields)).add("_below", "long").add("_upto", "long").add("_size", "long")
    ranked = in_chunks(df, key, n - 1, size=chunk).groupBy(key, "_chunk").applyInArrow(run, schema)
    below, upto, size = F.col("_below"), F.col("_upto"), F.col("_size")
    if kind == "weak":
        got = upto * 100.0 / size
    elif kind == "strict":
        got = F.when(size >= least, F.round(below * 100.0 / size, 1)).otherwise(50.0)
    else:
        got = F.when(size >= n, (below + (upto - below + 1) / 2) / size)
    return ranked.withColumn(out, F.when(F.col(col).isNotNull(), got)).drop("_below", "_upto", "_size")


def cume_dist_pct(df: DataFrame, col: str, key: str = "series") -> DataFrame:
    """Percent of the whole history at or below each value."""
    return df.withColumn("pctile", F.round(F.cume_dist().over(Window.partitionBy(key).orderBy(col)) * 100, 1))


def traffic_light(df: DataFrame, col: str, key: str = "series", low: float = 0.28, high: float = 0.32, lag: int = 5, band: float = 0.1) -> DataFrame:
    """Green, yellow or red by two thresholds; near a threshold the direction over `lag` rows decides; shown one row later."""
    x, d = F.col(col), F.col(col) - F.lag(col, lag).over(by(key))
    worse, better = F.coalesce(d > 0, F.lit(False)), F.coalesce(d < 0, F.lit(False))
    light = (
        F.when(x.isNull(), None)
        .when(x < low, F.when(worse & (x > low * (1 - band)), "YELLOW").otherwise("GREEN"))
        .when(x >= high, F.when(better & (x < high * (1 + band)), "YELLOW").otherwise("RED"))
        .otherwise(F.when(worse, "RED").when(better, "GREEN").otherwise("YELLOW"))
    )
    return df.withColumn("light", light).withColumn("signal", F.lag("light").over(by(key)))


def realised_vol(df: DataFrame, n: int = 20, key: str = "stock_id") -> DataFrame:
    """Annualised population deviation of n log returns in percent."""
    r = df.withColumn("_r", F.log(F.col("close_price") / F.lag("close_price").over(by(key))))
    w = last_rows(n, key)
    return r.withColumn("realised_vol", F.round(full(F.col("_r"), n, w, F.stddev_pop("_r").over(w) * F.sqrt(F.lit(252.0)) * 100), 4)).drop("_r")


def pressure(df: DataFrame, col: str, n: int, key: str = "stock_id") -> DataFrame:
    """Negative z-score over n rows, and its sub-score clip(.5 + z / 4, 0, 1), neutral at .5 without a z-score."""
    w = last_rows(n, key)
    deviation = F.stddev_pop(col).over(w)
    z = F.when(deviation > 0, -(F.col(col) - F.avg(col).over(w)) / deviation)
    return df.withColumn("z", F.round(z, 4)).withColumn("subscore", F.when(z.isNull(), 0.5).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + z / 4)), 4)))


def momentum(df: DataFrame, col: str, back: int = 5, key: str = "stock_id") -> DataFrame:
    """Percent change over `back` non-null values, and its sub-score clip(.5 + d / 8, 0, 1), neutral at .5 without a change."""
    rows = df.where(F.col(col).isNotNull())
    d = F.try_divide((F.col(col) - F.lag(col, back).over(by(key))) * 100, F.lag(col, back).over(by(key)))
    return rows.withColumn("d", F.round(d, 4)).withColumn("subscore", F.when(d.isNull(), 0.5).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + d / 8)), 4)))


def unwind(df: DataFrame, col: str, baseline: str, key: str = "series") -> DataFrame:
    """Per series since the baseline date: baseline, peak and its first date, current value, and excesses over the baseline."""
    rows = df.where((F.col("date") >= F.lit(baseline).cast("date")) & F.col(col).isNotNull())
    out = rows.groupBy(key).agg(
        F.min_by(col, "date").alias("base_value"), F.max(col).alias("peak"), F.max_by("date", F.struct(F.col(col), -F.unix_date("date"))).alias("peak_date"), F.max_by(col, "date").alias("current"), F.max("date").alias("asof")
    )
    return out.withColumns({"excess_now": F.round(F.col("current") - F.col("base_value"), 4), "excess_peak": F.round(F.col("peak") - F.col("base_value"), 4), "unwound": F.round(F.try_divide(F.col("peak") - F.col("current"), F.col("peak") - F.col("base_value")), 4)})


def unwind_daily(df: DataFrame, col: str, baseline: str, key: str = "series") -> DataFrame:
    """Per date from the baseline on: the share of the highest rise over the baseline that is still there; 0 before any rise."""
    rows = df.where((F.col("date") >= F.lit(baseline).cast("date")) & F.col(col).isNotNull())
    so_far = by(key).rowsBetween(Window.unboundedPreceding, 0)
    base, peak = F.first(col).over(so_far), F.max(col).over(so_far)
    return rows.withColumn("remaining", F.round(F.coalesce(F.try_divide(F.col(col) - base, F.nullif(peak - base, F.lit(0.0))), F.lit(0.0)), 4))


def last_valid(df: DataFrame, col: str, key: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(key).agg(F.max("date").alias("date"), F.max_by(col, "date").alias(col))


def technical_features(bars: DataFrame, returns: tuple[int, ...] = (5, 10, 20, 60, 120), gaps: tuple[int, ...] = (20, 60, 120, 250), vol: tuple[int, int] = (20, 60), volume: int = 60) -> DataFrame:
    """Returns, gaps to moving averages, volatility ratio, bar range, shadows and relative volume."""
    c, o, h, low = (F.col(f"{x}_price") for x in ("close", "open", "high", "low"))
    out = {f"ret_{n}": F.try_divide(c, F.lag(c, n).over(by())) - 1 for n in returns}
    out |= {f"gap_{n}": full(c, n, last_rows(n), F.try_divide(c, F.avg(c).over(last_rows(n))) - 1) for n in gaps}
    rows = bars.withColumn("_r", F.try_divide(c, F.lag(c).over(by())) - 1)
    short, long = (full(F.col("_r"), n, last_rows(n), F.stddev_samp("_r").over(last_rows(n))) for n in vol)
    out |= {"vol_ratio": F.try_divide(short, F.nullif(long, F.lit(0.0))), "bar_range": F.try_divide(h - low, c), "upper_shadow": F.try_divide(h - F.greatest(o, c), c), "lower_shadow": F.try_divide(F.least(o, c) - low, c)}
    out["rel_volume"] = full(F.col("volume"), volume, last_rows(volume), F.try_divide(F.col("volume").cast("double"), F.avg("volume").over(last_rows(volume))))
    return rows.withColumns(out).drop("_r")


def to_position(df: DataFrame, threshold: float = 0.025, regime: int = 200, target: float = 0.16, vol: int = 90, cap: float = 3.0, key: str = "stock_id") -> DataFrame:
    """side: signals beyond the threshold become +-1, unless against the long average (while there is one); position: side scaled to a target volatility."""
    c = F.col("close_price")
    rows = df.withColumn("_r", F.try_divide(c, F.lag(c).over(by(key))) - 1)
    trend = F.round(full(c, regime, last_rows(regime, key), F.avg(c).over(last_rows(regime, key))), 6)
    raw = F.when(F.col("signal") > threshold, 1).when(F.col("signal") < -threshold, -1).otherwise(0)
    allowed = F.when(((raw > 0) & (c < trend)) | ((raw < 0) & (c > trend)), 0).otherwise(raw)
    spread = full(F.col("_r"), vol, last_rows(vol, key), F.stddev_samp("_r").over(last_rows(vol, key))) * F.sqrt(F.lit(252.0))
    rows = rows.withColumn("_scale", F.try_divide(F.lit(target), spread))
    clipped = F.when(F.col("_scale").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(cap), F.col("_scale"))))  # least and greatest pass over nulls
    rows = rows.withColumn("_scale", F.last(clipped, ignorenulls=True).over(by(key).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumns({"side": allowed, "position": F.round(allowed * F.coalesce("_scale", F.lit(0.0)), 6)}).drop("_r", "_scale")


def strategy_equity(df: DataFrame, cost: float = 0.0005, same_day: bool = False, key: str = "stock_id") -> DataFrame:
    """Net return of holding `position` (yesterday's, unless same_day) less cost per change of it, and compounded equity."""
    r = F.coalesce(F.try_divide(F.col("close_price"), F.lag("close_price").over(by(key))) - 1, F.lit(0.0))
    held = F.col("position") if same_day else F.coalesce(F.lag("position").over(by(key)), F.lit(0.0))
    turn = F.abs(F.col("position") - F.coalesce(F.lag("position").over(by(key)), F.lit(0.0)))
    rows = df.withColumn("net_ret", r * held - turn * cost)
    return rows.withColumn("equity", F.exp(F.sum(F.log1p("net_ret")).over(by(key).rowsBetween(Window.unboundedPreceding, 0))))


STRATEGIES = ("strat", "vol", "bh")


def strategy_returns(df: DataFrame, cost: float = 0.0005, key: str = "stock_id") -> DataFrame:
    """Daily returns of holding the side (strat), the scaled position (vol) and the instrument itself (bh), one row each.

    Yesterday's holding earns today's return, less cost per change of it. An instrument's first bar has no row, nor has
    one without a return. entered marks a side that is not zero and not the one of the row before.
    """
    r = F.try_divide(F.col("close_price"), F.lag("close_price").over(by(key))) - 1
    before = lambda c: F.lag(c).over(by(key))
    held = lambda c: F.col("_r") * before(c) - F.abs(F.col(c) - before(c)) * cost
    rows = df.withColumn("_r", r).withColumns({"strat": held("side"), "vol": held("position"), "bh": F.col("_r")}).where(F.col("_r").isNotNull())
    changed = (F.col("side") != 0) & F.coalesce(F.col("side") != before("side"), F.lit(True))  # among the rows that are left
    return rows.withColumn("entered", changed.cast("int")).unpivot([key, "date", "side", "entered"], list(STRATEGIES), "strategy", "ret")


def _growth(returns: Column) -> Column:
    """Summary of an ordered run of returns: product, highest and lowest prefix product, deepest fall from a highest one."""
    start = F.struct(F.lit(1.0).alias("p"), F.lit(None).cast("double").alias("h"), F.lit(None).cast("double").alias("l"), F.lit(0.0).alias("d"))

    def step(s: Column, r: Column) -> Column:
        p = s["p"] * (1 + r)
        h = F.greatest(s["h"], p)
        return F.struct(p.alias("p"), h.alias("h"), F.least(s["l"], p).alias("l"), F.least(s["d"], p / h - 1).alias("d"))

    return F.aggregate(returns, start, step)


def _joined(runs: Column) -> Column:
    """The same summary of runs that follow one another, from theirs alone: a fall may begin in an earlier run."""
    start = F.struct(F.lit(1.0).alias("p"), F.lit(None).cast("double").alias("h"), F.lit(0.0).alias("d"))

    def step(s: Column, r: Column) -> Column:
        across = s["p"] * r["l"] / s["h"] - 1  # null before the first run
        return F.struct((s["p"] * r["p"]).alias("p"), F.greatest(s["h"], s["p"] * r["h"]).alias("h"), F.least(s["d"], r["d"], across).alias("d"))

    return F.aggregate(runs, start, step)


def _figures(daily: DataFrame, key: str, year: int, least: int) -> DataFrame:
    """Per key and strategy of daily (key, strategy, date, ret, entered, inside, the last two 0 or 1): unrounded figures.

    Histories are summed up per calendar year, in as many tasks, and the years joined by their summaries; no window runs
    over equity. Figures without a deviation, fall or win are 0.
    """
    r = F.col("ret")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("date", r.alias("r")))), lambda v: v["r"])  # a year of one instrument
    blocks = daily.groupBy(key, "strategy", F.year("date").alias("block")).agg(
        ordered.alias("_v"), F.count("*").alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("ss"), F.count_if(r > 0).alias("wins"), F.count_if(r != 0).alias("moves"), F.sum("entered").alias("switches"), F.sum("inside").alias("inside")
    ).withColumn("g", _growth(F.col("_v"))).drop("_v")
    runs = F.array_sort(F.collect_list(F.struct("block", "g")))
    out = blocks.groupBy(key, "strategy").agg(runs.alias("_runs"), *[F.sum(c).alias(c) for c in ("n", "s", "ss", "wins", "moves", "switches", "inside")]).where(F.col("n") >= least)
    out = out.withColumn("g", _joined(F.transform("_runs", lambda v: v["g"])))
    n, total, fall = F.col("n"), F.col("g.p"), F.col("g.d")
    spread = (F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1)
    sd = F.when(spread > 1e-18, F.sqrt(spread)).otherwise(0.0)
    cagr = F.when(total > 0, F.pow(total, F.lit(float(year)) / n) - 1).otherwise(-1.0)
    figures = {
        "cagr": cagr, "vol": sd * F.sqrt(F.lit(float(year))), "sharpe": F.when(sd > 0, F.col("s") / n / sd * F.sqrt(F.lit(float(year)))).otherwise(0.0), "max_drawdown": fall,
        "calmar": F.when(fall < 0, cagr / -fall).otherwise(0.0), "win_rate": F.coalesce(F.try_divide(F.col("wins"), F.col("moves")), F.lit(0.0)), "time_in_market": F.col("inside") / n,
    }
    return out.select(key, "strategy", "n", "switches", *[F.round(c, 4).alias(name) for name, c in figures.items()])


def performance_metrics(df: DataFrame, cost: float = 0.0005, key: str = "stock_id", year: int = 252, least: int = 50) -> DataFrame:
    """Per key and strategy: CAGR, volatility, Sharpe, largest drawdown, Calmar, win rate, switches and time in the market.

    df: key, date, close_price, side, position. A switch is a change to a side that is not zero. Keys with under `least`
    returns have no row.
    """
    daily = strategy_returns(df, cost, key).withColumn("inside", (F.col("side") != 0).cast("int"))
    return _figures(daily, key, year, least)


def light_backtest(df: DataFrame, cost: float = 0.00005, key: str = "series", year: int = 252, least: int = 252) -> DataFrame:
    """Being in the market on the days whose signal is green (strat, cost per change) against always (bh): figures per key.

    df: key, date, close_price, signal. The signal counts for its own day; a day without a return earns nothing.
    """
    position = F.when(F.col("signal") == "GREEN", 1.0).otherwise(0.0)
    rows = df.withColumns({"_p": position, "_r": F.try_divide(F.col("close_price"), F.lag("close_price").over(by(key))) - 1})
    strat = F.coalesce(F.col("_r") * F.col("_p") - cost * F.abs(F.col("_p") - F.lag("_p").over(by(key))), F.lit(0.0))
    daily = rows.withColumns({"strat": strat, "bh": F.coalesce("_r", F.lit(0.0)), "inside": F.col("_p").cast("int"), "entered": F.lit(0)}).unpivot([key, "date", "inside", "entered"], ["strat", "bh"], "strategy", "ret")
    return _figures(daily, key, year, least).drop("switches", "win_rate")


def trades(df: DataFrame, cost: float = 0.0005, key: str = "stock_id") -> DataFrame:
    """Runs of one non-zero side as trades; a trade leaves at the first bar of the next run, so an open last run counts not."""
    changed = F.coalesce((F.col("side") != F.lag("side").over(by(key))).cast("int"), F.lit(1))
    rows = df.withColumn("_run", F.sum(changed).over(by(key).rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(key, "_run").agg(F.first("side").alias("side"), F.min("date").alias("entry_date"), F.min_by("close_price", "date").alias("entry_price"), F.count("*").alias("bars"))
    after = Window.partitionBy(key).orderBy("_run")
    closed = runs.withColumns({"exit_date": F.lead("entry_date").over(after), "exit_price": F.lead("entry_price").over(after)}).where((F.col("side") != 0) & F.col("exit_date").isNotNull())
    return closed.withColumn("pnl", F.col("side") * (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price") - 2 * cost).drop("_run")


def trade_summary(closed: DataFrame, key: str = "stock_id") -> DataFrame:
    """Per key: trades, wins and losses (a result of 0 is neither), their rate, means, payoff and expectancy, holding time, extremes, and both sides."""
    pnl, side = F.col("pnl"), F.col("side")
    mean = lambda c: F.coalesce(F.avg(F.when(c, pnl)), F.lit(0.0))
    out = closed.groupBy(key).agg(
        F.count("*").alias("trades"), F.count_if(pnl > 0).alias("wins"), F.count_if(pnl < 0).alias("losses"), mean(pnl > 0).alias("_w"), mean(pnl < 0).alias("_l"), F.avg("bars").alias("_hold"), F.max(pnl).alias("_best"), F.min(pnl).alias("_worst"),
        F.count_if(side > 0).alias("longs"), F.count_if(side < 0).alias("shorts"), F.count_if((side > 0) & (pnl > 0)).alias("_lw"), F.count_if((side < 0) & (pnl > 0)).alias("_sw"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    wr = share(F.col("wins"), F.col("wins") + F.col("losses"))
    six = lambda c, name: F.round(c, 6).alias(name)
    return out.select(
        key, "trades", "wins", "losses", F.round(wr, 4).alias("win_rate"), six(F.col("_w"), "avg_win"), six(F.col("_l"), "avg_loss"), F.round(F.abs(share(F.col("_w"), F.nullif(F.col("_l"), F.lit(0.0)))), 4).alias("payoff"), six(wr * F.col("_w") + (1 - wr) * F.col("_l"), "expectancy"),
        F.round("_hold", 4).alias("hold_bars"), six(F.col("_best"), "best"), six(F.col("_worst"), "worst"), "longs", F.round(share(F.col("_lw"), F.col("longs")), 4).alias("long_win_rate"), "shorts", F.round(share(F.col("_sw"), F.col("shorts")), 4).alias("short_win_rate"),
    )


def trim_recent_continuous(prices: DataFrame, n: int = 60, step: float = 0.35, out: str = "avg_close", bounded: bool = True) -> DataFrame:
    """Average close of the newest n bars after the last break: a jump of over `step`, or a non-positive close.

    bounded: only bars of the market's last max(n + 5, ceil(1.6 n)) dates count, so an instrument that stopped trading has
    none; otherwise every instrument has its newest n, whatever their age.
    """
    newest = Window.partitionBy("stock_id").orderBy(F.desc("date"))
    recent = prices
    if bounded:
        dates = prices.select("date").distinct().orderBy(F.desc("date")).limit(max(n + 5, math.ceil(n * 1.6)))
        oldest = dates.agg(F.min("date").alias("_oldest"))  # one row
        recent = prices.join(F.broadcast(oldest), F.col("date") >= F.col("_oldest")).drop("_oldest")
    rows = recent.where(F.col("close_price").isNotNull()).withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n)
    older = F.lag("close_price").over(by())
    jump = F.when(older.isNull(), False).otherwise((older <= 0) | (F.col("close_price") <= 0) | (F.abs(F.col("close_price") - older) > step * older))
    broken = rows.withColumn("_break", jump).withColumn("_last", F.min(F.when(F.col("_break"), F.col("_rank"))).over(Window.partitionBy("stock_id")))
    kept = broken.where(F.col("_last").isNull() | (F.col("_rank") <= F.col("_last")))
    return kept.groupBy("stock_id").agg(F.round(F.avg("close_price"), 4).alias(out), F.count("*").alias("bars"))


def risk_features(prices: DataFrame, short: int = 6, long: int = 60, run: int = 3) -> DataFrame:
    """Newest bar's short cumulative return, volume averages and the sum of the last changes if they share one sign."""
    w_s, w_l, w_r = last_rows(short), last_rows(long), last_rows(run)
    base = F.lag("close_price", short - 1).over(by())
    same = (F.min("change_pct").over(w_r) > 0) | (F.max("change_pct").over(w_r) < 0)
    rows = prices.withColumns(
        {
            "cum_ret": F.round(F.try_divide((F.col("close_price") - base) * 100, base), 2),
            "avg_short": F.avg("volume").over(w_s),
            "avg_long": full(F.col("volume"), long, w_l, F.avg("volume").over(w_l)),
            "run_sum": F.when(same & (F.count("change_pct").over(w_r) >= run), F.round(F.sum("change_pct").over(w_r), 2)).otherwise(0.0),
            "_n": F.count("*").over(by().rowsBetween(Window.unboundedPreceding, 0)),
            "_rank": F.row_number().over(Window.partitionBy("stock_id").orderBy(F.desc("date"))),
        }
    )
    return rows.where((F.col("_rank") == 1) & (F.col("_n") >= short)).select("stock_id", "date", "close_price", "change_pct", "cum_ret", F.round("avg_short", 4).alias("avg_short"), F.round("avg_long", 4).alias("avg_long"), "run_sum")


def complete_date(prices: DataFrame, share: float = 0.9, lookback: int = 8) -> DataFrame:
    """Newest of the last dates with at least `share` of the previous date's closes, else the oldest of them: one row."""
    recent = prices.groupBy("date").agg(F.count("close_price").alias("n")).orderBy(F.desc("date")).limit(lookback)
    rows = recent.withColumn("_before", F.lag("n").over(Window.orderBy("date")))  # `lookback` rows
    return rows.agg(F.coalesce(F.max(F.when(F.col("n") >= share * F.col("_before"), F.col("date"))), F.min("date")).alias("date"))


def lag_corr(df: DataFrame, x: str, y: str, key: str = "series", lags: int = 5, least: int = 5) -> DataFrame:
    """Pearson correlation of x with y `lag` rows later, for lags -lags .. lags, per key: positive lags where x leads."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    shifted = F.array(*[F.struct(F.lit(k).alias("lag"), (F.lead(y, k) if k >= 0 else F.lag(y, -k)).over(by(key)).alias("v")) for k in range(-lags, lags + 1)])
    pairs = rows.withColumn("_p", shifted).select(key, F.col(x).alias("_x"), F.explode("_p").alias("p")).select(key, "_x", "p.lag", "p.v").where(F.col("v").isNotNull())
    return pairs.groupBy(key, "lag").agg(F.count("*").alias("n"), F.round(F.coalesce(F.nanvl(F.corr("_x", "v"), F.lit(0.0)), F.lit(0.0)), 4).alias("r")).where(F.col("n") >= least)


def granger_lite(df: DataFrame, x: str, y: str, key: str = "series", lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """How much a blend with x's recent mean lowers the squared error of predicting y by its own recent mean, in percent.

    0 where y's own mean makes no error; a key needs 10 rows more than the lag.
    """
    out = None
    for k in lags:
        w = by(key).rowsBetween(-k, -1)
        whole = F.count(y).over(Window.partitionBy(key))
        rows = df.withColumns({"_y": F.avg(y).over(w), "_x": F.avg(x).over(w), "_n": F.count(y).over(w), "_all": whole}).where((F.col("_n") >= k) & (F.col("_all") >= k + 10))
        error = rows.groupBy(key).agg(F.avg(F.pow(F.col(y) - F.col("_y"), 2)).alias("a"), F.avg(F.pow(F.col(y) - (0.7 * F.col("_y") + 0.3 * F.col("_x")), 2)).alias("b"))
        one = error.select(key, F.lit(k).alias("lag"), F.round(F.coalesce(F.try_divide((F.col("a") - F.col("b")) * 100, F.col("a")), F.lit(0.0)), 2).alias("improvement"))
        out = one if out is None else out.unionByName(one)
    return out


def expanding_zscore(df: DataFrame, col: str, least: int = 60, key: str = "stock_id") -> DataFrame:
    w = by(key).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("z", F.round(F.when(F.count(col).over(w) >= least, F.try_divide(F.col(col) - F.avg(col).over(w), F.nullif(F.stddev_samp(col).over(w), F.lit(0.0)))), 4))


def calibrate(df: DataFrame, col: str, proxy: str, key: str = "series", out: str = "filled") -> DataFrame:
    """Missing values from a proxy scaled to meet the last valid value; factor 1 where the proxy was missing or zero."""
    w = by(key).rowsBetween(Window.unboundedPreceding, 0)
    valid = F.last(F.when(F.col(col).isNotNull(), F.struct(F.col(col).alias("v"), F.col(proxy).alias("p"))), ignorenulls=True).over(w)
    rows = df.withColumn("_valid", valid)
    factor = F.coalesce(F.try_divide(F.col("_valid.v"), F.nullif(F.col("_valid.p"), F.lit(0.0))), F.lit(1.0))
    return rows.withColumn(out, F.round(F.coalesce(F.col(col), F.col(proxy) * factor), 6)).drop("_valid")


def signal_of_mean(df: DataFrame, col: str, n: int = 5, low: float = 0.28, high: float = 0.32, key: str = "series") -> DataFrame:
    mean = F.avg(col).over(last_rows(n, key))
    return df.withColumn("mean", F.round(mean, 4)).withColumn("signal", F.when(mean < low, "GREEN").when(mean >= high, "RED").otherwise("YELLOW"))


def market_pressure(flows: DataFrame, prices: DataFrame, sums: tuple[int, ...] = (5, 20), high: int = 252) -> DataFrame:
    """Market-wide net flow summed over recent dates, and the day's low against the highest high: one series."""
    one = Window.partitionBy("series").orderBy("date")
    market = flows.groupBy("date").agg(F.sum("total_buy").alias("net")).join(prices.groupBy("date").agg(F.avg("low_price").alias("low"), F.avg("high_price").alias("high")), "date").withColumn("series", F.lit("market"))
    out = {f"net_{n}": F.sum("net").over(one.rowsBetween(-(n - 1), 0)) for n in sums}
    out["drawdown"] = F.round((F.col("low") / F.max("high").over(one.rowsBetween(-(high - 1), 0)) - 1) * 100, 2)
    return market.withColumns(out).select("date", *out)
