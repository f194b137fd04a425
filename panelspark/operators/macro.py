"""Market-level indicators: votes, correlations, stress index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .technical import momentum, pressure, rolling_percentile, unwind_daily

# Thresholds of the rate series, positions of each status, weights and caps of the vote.
# A series is green beyond its first threshold, yellow up to the second, red past that.
RISING = {"T10Y3M": (1.0, 0.0)}
FALLING = {"CP_SPREAD": (0.3, 0.8)}
BANDS = {"DOLLAR": (30.0, 70.0), "COR3M": (20.0, 30.0), "MOVE": (80.0, 120.0)}
VOTE_POSITIONS = {
    "credit": {"GREEN": 100.0, "YELLOW": 50.0, "RED": 0.0},
    "breadth": {"STRONG_BULL": 100.0, "BULL": 80.0, "NEUTRAL": 50.0, "BEAR": 30.0, "CRASH": 0.0},
    "T10Y3M": {"GREEN": 100.0, "YELLOW": 60.0, "RED": 20.0},
    "CP_SPREAD": {"GREEN": 100.0, "YELLOW": 50.0, "RED": 0.0},
    "DOLLAR": {"GREEN": 90.0, "YELLOW": 60.0, "RED": 30.0},
    "COR3M": {"GREEN": 90.0, "YELLOW": 50.0, "RED": 10.0},
}
VOTE_WEIGHTS = {"credit": 0.15, "breadth": 0.25, "T10Y3M": 0.20, "CP_SPREAD": 0.15, "DOLLAR": 0.10, "COR3M": 0.15}
VOTE_CAPS = {("credit", "RED"): 50.0, ("breadth", "CRASH"): 30.0, ("T10Y3M", "RED"): 50.0, ("CP_SPREAD", "RED"): 40.0}
STRESS_WEIGHTS = {"margin_total": 12.0, "turn_heat": 8.0, "margin_util": 5.0, "unwind": 22.0, "momentum": 8.0, "maint_inverse": 12.0, "low140": 8.0, "rv20": 8.0, "turn_val": 7.0, "foreign_sell": 10.0}


def indicator_latest(macro: DataFrame, positions: dict[str, float], default: float = 50.0) -> DataFrame:
    """Newest row per indicator with its position from a fixed map."""
    mapping = F.create_map(*[F.lit(x) for kv in positions.items() for x in kv])
    return macro.groupBy("indicator").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value")).withColumn("position", F.coalesce(mapping[F.col("indicator")], F.lit(default)))


def position_vote(signals: DataFrame, weights: dict[str, float], caps: dict[tuple[str, str], float], positions: dict[str, float]) -> DataFrame:
    """Per date: the weighted vote of indicator colours, bankers' rounding, capped by single alarms, and counts of colours.

    signals: date, indicator, colour. A missing indicator votes 50 and counts as yellow.
    """
    names = list(weights)
    wide = signals.groupBy("date").pivot("indicator", names).agg(F.first("colour"))
    wide = wide.na.fill("YELLOW", names)
    place = F.create_map(*[F.lit(x) for kv in positions.items() for x in kv])
    vote = lambda n: F.coalesce(place[F.col(f"`{n}`")], F.lit(50.0)) * weights[n]
    total = sum((vote(n) for n in names[1:]), vote(names[0]))
    limits = [F.when(F.col(f"`{n}`") == colour, cap).otherwise(100.0) for (n, colour), cap in caps.items()]
    out = wide.withColumn("raw", F.bround(F.round(total, 6), 0)).withColumn("position", F.least("raw", *limits) if limits else F.col("raw"))
    count = lambda colour: sum(((F.col(f"`{n}`") == colour).cast("int") for n in names[1:]), (F.col(f"`{names[0]}`") == colour).cast("int"))
    level = F.when(F.col("position") >= 80, "FULL").when(F.col("position") >= 60, "HIGH").when(F.col("position") >= 40, "HALF").when(F.col("position") >= 20, "LOW").otherwise("CASH")
    return out.select("date", "raw", "position", level.alias("level"), count("GREEN").alias("greens"), count("YELLOW").alias("yellows"), count("RED").alias("reds"))


def spread(macro: DataFrame, a: str, b: str) -> DataFrame:
    """Difference of two indicators on their common dates."""
    one = lambda n, out: macro.where(F.col("indicator") == n).select("date", F.col("value").alias(out))
    return one(a, "a").join(one(b, "b"), "date").select("date", F.round(F.round(F.col("a") - F.col("b"), 6), 4).alias("spread"))


def deleveraging_index(subscores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of sub-scores per date: long rows (date, part, score) are pivoted on the weights' names; a part that is missing adds nothing."""
    wide = subscores.groupBy("date").pivot("part", list(weights)).agg(F.first("score"))
    total = sum((F.coalesce(F.col(f"`{p}`"), F.lit(0.0)) * w for p, w in list(weights.items())[1:]), F.coalesce(F.col(f"`{next(iter(weights))}`"), F.lit(0.0)) * next(iter(weights.values())))
    return wide.select("date", F.round(F.round(total, 8), 2).alias("score"))


def stress_index(market: DataFrame, baseline: str, n: int = 1250) -> DataFrame:
    """The stress index per date from ten parts of the market's series, one row a date (series is constant).

    market: series, date, margin_total, turn_heat, margin_util, maint_inverse, low140, rv20, turn_val, f20. Seven parts are
    percentiles in the last n values, the others the rise since the baseline that remains, the momentum of margin and the
    pressure of foreign selling. A part that is missing adds nothing.
    """
    part = lambda df, name, score: df.select("date", F.lit(name).alias("part"), score.alias("score"))
    rows = part(unwind_daily(market, "margin_total", baseline), "unwind", F.col("remaining"))
    rows = rows.unionByName(part(momentum(market, "margin_total", 5, key="series"), "momentum", F.col("subscore")))
    rows = rows.unionByName(part(pressure(market.where("f20 IS NOT NULL"), "f20", n, key="series"), "foreign_sell", F.col("subscore")))
    ranked = market
    for name in ("margin_total", "turn_heat", "margin_util", "maint_inverse", "low140", "rv20", "turn_val"):
        ranked = rolling_percentile(ranked, name, n, key="series", out=f"_{name}")
        rows = rows.unionByName(part(ranked, name, F.round(F.round(f"_{name}", 8), 4) / 100))
    return deleveraging_index(rows, STRESS_WEIGHTS)


def macro_signals(macro: DataFrame, thresholds: dict[str, tuple[float, float]]) -> DataFrame:
    """Colour of each indicator's value: green under the first threshold, red from the second on; null without thresholds."""
    low = F.create_map(*[F.lit(x) for k, v in thresholds.items() for x in (k, v[0])])[F.col("indicator")]
    high = F.create_map(*[F.lit(x) for k, v in thresholds.items() for x in (k, v[1])])[F.col("indicator")]
    return macro.withColumn("colour", F.when(low.isNull(), None).when(F.col("value") < low, "GREEN").when(F.col("value") >= high, "RED").otherwise("YELLOW"))


def rate_colour(indicator: Column, value: Column) -> Column:
    """Colour of a rate series' value (the dollar's is its percentile); null for other series."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, (good, bad) in RISING.items():
        out = out.when(indicator == name, F.when(value > good, "GREEN").when(value > bad, "YELLOW").otherwise("RED"))
    for name, (good, bad) in FALLING.items():
        out = out.when(indicator == name, F.when(value < good, "GREEN").when(value < bad, "YELLOW").otherwise("RED"))
    for name, (good, bad) in BANDS.items():
        out = out.when(indicator == name, F.when(value > bad, "RED").when(value < good, "GREEN").otherwise("YELLOW"))
    return F.when(value.isNotNull(), out)


def rate_signals(rates: DataFrame) -> DataFrame:
    """Colour per date and rate series; the dollar goes by its strict percentile in the last 251 values, 50 under 21 of them."""
    dollar = F.col("indicator") == "DOLLAR"
    ranked = rolling_percentile(rates.where(dollar), "value", 251, "strict", key="indicator", least=21)
    rows = rates.where(~dollar).withColumn("pctile", F.lit(None).cast("double")).unionByName(ranked)
    return rows.withColumn("colour", rate_colour(F.col("indicator"), F.coalesce("pctile", "value"))).select("date", "indicator", "value", "pctile", "colour")


def six_vote(status: DataFrame) -> DataFrame:
    """Per date the position voted by the newest status of six indicators: bankers' rounding, then four caps.

    status: date, indicator, status (a colour, for breadth a regime). Until an indicator has a status it votes 50 and
    counts as yellow. One row a date goes through one window.
    """
    names = list(VOTE_WEIGHTS)
    wide = status.groupBy("date").pivot("indicator", names).agg(F.first("status")).withColumn("series", F.lit("vote"))
    upto = Window.partitionBy("series").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    wide = wide.withColumns({n: F.last(n, ignorenulls=True).over(upto) for n in names})

    def place(n: str) -> Column:
        out = F.when(F.lit(False), 0.0)
        for word, position in VOTE_POSITIONS[n].items():
            out = out.when(F.col(n) == word, position)
        return F.coalesce(out, F.lit(50.0)) * VOTE_WEIGHTS[n]

    total = sum((place(n) for n in names[1:]), place(names[0]))
    rows = wide.withColumn("raw", F.bround(F.round(total, 6), 0))
    position, capped = F.col("raw"), []
    for (name, word), cap in VOTE_CAPS.items():
        hit = F.coalesce(F.col(name) == word, F.lit(False))
        capped.append(F.when(hit & (position > cap), name))
        position = F.when(hit, F.least(position, F.lit(cap))).otherwise(position)
    rows = rows.withColumns({"position": position, "capped_by": F.concat_ws(",", *capped)})
    colour = lambda n: F.when(F.col(n).isin("GREEN", "STRONG_BULL", "BULL"), "GREEN").when(F.col(n).isin("RED", "BEAR", "CRASH"), "RED").otherwise("YELLOW")
    count = lambda c: sum(((colour(n) == c).cast("int") for n in names[1:]), (colour(names[0]) == c).cast("int"))
    level = F.when(F.col("position") >= 80, "FULL").when(F.col("position") >= 60, "HIGH").when(F.col("position") >= 40, "HALF").when(F.col("position") >= 20, "LOW").otherwise("CASH")
    return rows.select("date", "raw", "position", "capped_by", level.alias("level"), count("GREEN").alias("greens"), count("YELLOW").alias("yellows"), count("RED").alias("reds"))


def focus_pairs(series: DataFrame, pairs: list[tuple[str, str]], least: int) -> DataFrame:
    """Values of the named pairs of series on their common dates, where there are at least `least`: series 'a:b', date, x, y."""
    named = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]))
    side = lambda k, out: series.select("date", "series", F.col("value").alias(out), named.alias("p")).where(F.col("series") == F.col(f"p.{k}")).select("p", "date", out)
    rows = side("a", "x").join(side("b", "y"), ["p", "date"]).select(F.concat_ws(":", "p.a", "p.b").alias("series"), "date", "x", "y")
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("series"))).where(F.col("_n") >= least).drop("_n")


def quote_change(bid: Column, ask: Column, close: Column, ref: Column, opening: Column) -> tuple[Column, Column, Column]:
    """Price (mid of two positive quotes, else the close), base ('ref' if positive, else 'open') and change in percent, 0 without a base."""
    price = F.when((bid > 0) & (ask > 0), (bid + ask) / 2).otherwise(close)
    base = F.when(ref > 0, ref).otherwise(opening)
    return price, F.when(ref > 0, "ref").otherwise("open"), F.coalesce(F.try_divide((price - base) * 100, F.nullif(base, F.lit(0.0))), F.lit(0.0))


def quoted_strength(a: DataFrame, b: DataFrame, n: int = 3) -> DataFrame:
    """Difference of two contracts' changes per minute from their quotes, smoothed with the n - 1 strengths shown before it.

    Both: date, minute, bid, ask, close, ref, open. Smoothing feeds on raw strengths of the day's earlier minutes.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        price, source, change = quote_change(*[F.col(c) for c in ("bid", "ask", "close", "ref", "open")])
        return df.select("date", "minute", F.round(F.round(price, 6), 2).alias(f"{p}_price"), source.alias(f"{p}_src"), change.alias(f"{p}_chg"))

    rows = side(a, "a").join(side(b, "b"), ["date", "minute"]).withColumn("raw", F.col("a_chg") - F.col("b_chg"))
    rows = rows.withColumn("s", F.avg("raw").over(Window.partitionBy("date").orderBy("minute").rowsBetween(-(n - 1), 0)))
    source = F.when(F.col("a_src") == F.col("b_src"), F.col("a_src")).otherwise("mixed")
    shown = F.round("s", 10)
    colour = F.when(shown > 0, "red").when(shown < 0, "green").otherwise("flat")
    return rows.select("date", "minute", "a_price", "b_price", source.alias("base_source"), *[F.round(c, 4).alias(o) for c, o in (("a_chg", "a_change"), ("b_chg", "b_change"), ("raw", "strength_raw"), ("s", "strength"))], colour.alias("colour"))


def strength_daily(intraday: DataFrame, key: str = "stock_id") -> DataFrame:
    """Per key and date the highest, lowest and last value of an intraday series, and when it was last seen."""
    return intraday.groupBy(key, F.col("snapshot_ts").cast("date").alias("date")).agg(F.max("last_price").alias("high"), F.min("last_price").alias("low"), F.max_by("last_price", F.struct("snapshot_ts", "event_id")).alias("last"), F.count("*").alias("ticks"))


def pair_strength(a: DataFrame, b: DataFrame, n: int = 3) -> DataFrame:
    """Difference of two series' changes from their first value of the day, with the mean of the n values before it.

    Both: date, minute, price. The price is a mid quote where there is one.
    """
    day = Window.partitionBy("date").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    change = lambda df, out: df.withColumn(out, F.try_divide((F.col("price") - F.first("price").over(day)) * 100, F.first("price").over(day))).select("date", "minute", out)
    rows = change(a, "x").join(change(b, "y"), ["date", "minute"]).withColumn("strength", F.round(F.col("x") - F.col("y"), 4))
    smooth = F.avg("strength").over(Window.partitionBy("date").orderBy("minute").rowsBetween(-(n - 1), 0))
    return rows.withColumn("smoothed", F.round(smooth, 6)).select("date", "minute", "strength", "smoothed", F.when(F.col("strength") > 0, "red").when(F.col("strength") < 0, "green").otherwise("grey").alias("colour"))
