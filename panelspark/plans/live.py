"""Queries of intraday forecasts, stream jobs run over the events table, and the report index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions import exprs
from panelspark.operators import joins, margin, reports
from panelspark.operators.technical import DAYS
from panelspark.sources import adapters, sinks
from panelspark.streaming import quotes, replay
from panelspark.streaming import stateful as state

from . import composites
from .market import _RANK, a1
from .registry import query
from .storage import shared_folder


def streamed(spark: SparkSession, d: str, build) -> DataFrame:
    """Run a stream job over the events file to its end, then give its table. Windows that the watermark has not passed at the end of the input stay open, as they do in a running stream."""
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(_folder(d))
    stream = stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    path = f"{shared_folder(spark)}/live_{uuid.uuid4().hex}"
    out = build(stream)
    quotes.run_to_end(out, path, f"{path}_log")
    return spark.read.schema(out.schema).parquet(path)


def _folder(d: str) -> str:
    return f"{d}/events.parque[t]"  # a glob: file streams read folders and patterns


_CURVE = "CASE WHEN minute >= 270 THEN 1.0 WHEN minute <= 0 THEN 0.0667 " + " ".join(f"WHEN minute <= {m1} THEN {p0} + (minute - {m0}) * {(p1 - p0) / (m1 - m0)!r}" for (m0, p0), (m1, p1) in zip(exprs.CURVE, exprs.CURVE[1:], strict=False)) + " END"
#: The day of the forecasts.
DAY = "2024-01-15"
_DAYS = "days AS (SELECT stock_id, CAST(snapshot_ts AS DATE) AS date, max(cum_volume) AS volume FROM snaps GROUP BY 1, 2)"
_ADV = f"{_DAYS}, adv AS (SELECT stock_id, avg(volume) AS adv FROM (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) AS rk FROM days WHERE date < DATE '{DAY}' AND volume > 0) WHERE rk <= 20 GROUP BY 1 HAVING count(*) >= 10)"


def day_volumes(snapshots: DataFrame) -> DataFrame:
    """Each instrument's volume per day, as its last cumulative count."""
    return snapshots.groupBy("stock_id", F.col("snapshot_ts").cast("date").alias("date")).agg(F.max("cum_volume").alias("volume"))


def volume_base(snapshots: DataFrame, asof: str = DAY) -> DataFrame:
    """Each instrument's average volume of the last 20 days before asof."""
    return margin.adv(day_volumes(snapshots), asof)


@query(
    "x16_volume_anomaly",
    f"""WITH {_ADV}, l AS (SELECT * FROM snaps WHERE CAST(snapshot_ts AS DATE) = DATE '2024-01-15' QUALIFY row_number() OVER (PARTITION BY stock_id ORDER BY snapshot_ts DESC, event_id DESC) = 1), f AS (SELECT l.stock_id, snapshot_ts, cum_volume, minute, adv, {_CURVE} AS pct FROM l JOIN adv ON l.stock_id = adv.stock_id WHERE cum_volume >= 1000),
    g AS (SELECT *, round(cum_volume / pct, 4) AS forecast, round(cum_volume / pct / adv, 4) AS rvol FROM f WHERE pct >= 0.02 AND adv > 0) SELECT stock_id, minute, cum_volume, forecast, rvol, CASE WHEN rvol >= 2 THEN 'DANGER' WHEN rvol >= 1.6 THEN 'WARN' ELSE 'OBSERVE' END AS level FROM g WHERE rvol >= 1.3 ORDER BY rvol DESC, stock_id LIMIT 50""",
)
def x16(spark: SparkSession, d: str) -> DataFrame:
    snapshots = adapters.intraday_snapshots(spark, d)
    day = snapshots.where(F.col("snapshot_ts").cast("date") == F.lit("2024-01-15").cast("date"))
    found = quotes.forecast(joins.latest_per_key(day, "stock_id", ["snapshot_ts", "event_id"]), volume_base(snapshots))
    return found.select("stock_id", "minute", "cum_volume", "forecast", "rvol", "level").orderBy(F.desc("rvol"), "stock_id").limit(50)


_MARKET_FORECAST = f"""{{}}, f AS (SELECT *, (value / pct) * pct + prior * (1 - pct) AS f, sqrt((1 - pct) / pct) * 0.15 AS s, f / prior AS ratio_ FROM p WHERE prior > 0)"""
_FORECAST_COLUMNS = "round(f, 2) AS forecast, round(CASE WHEN pct >= 1 THEN f ELSE greatest(0.0, f * (1 - 1.645 * s)) END, 2) AS low, round(CASE WHEN pct >= 1 THEN f ELSE f * (1 + 1.645 * s) END, 2) AS high, round(ratio_, 3) AS ratio, CASE WHEN ratio_ >= 2 THEN 'DANGER' WHEN ratio_ >= 1.6 THEN 'WARN' WHEN ratio_ >= 1.3 THEN 'OBSERVE' ELSE 'NONE' END AS level"
_NEWEST = "SELECT stock_id, CAST(snapshot_ts AS DATE) AS day, cum_volume, minute, last_price FROM snaps QUALIFY row_number() OVER (PARTITION BY stock_id, CAST(snapshot_ts AS DATE) ORDER BY snapshot_ts DESC, event_id DESC) = 1"


@query(
    "x16_market_forecast",
    _MARKET_FORECAST.format(
        f"""WITH l AS ({_NEWEST}), v AS (SELECT stock_id, day AS date, cum_volume * CAST(last_price AS DECIMAL(18, 2)) AS trade_value FROM l), s AS (SELECT * FROM l WHERE day >= DATE '2024-01-24' AND cum_volume > 0 AND last_price IS NOT NULL),
    t AS (SELECT day, CAST(sum(cum_volume * CAST(last_price AS DECIMAL(18, 2))) AS DOUBLE) AS value, max(minute) AS minute, count(*) AS instruments FROM s GROUP BY 1),
    e AS (SELECT s.day, v.date, sum(coalesce(trade_value, 0)) AS total FROM s JOIN v ON s.stock_id = v.stock_id AND v.date < s.day GROUP BY 1, 2),
    m AS (SELECT day, avg(CAST(total AS DOUBLE)) AS prior FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY date DESC) AS rk FROM e) WHERE rk <= 20 GROUP BY 1), p AS (SELECT t.*, prior, {_CURVE} AS pct FROM t JOIN m ON t.day = m.day)"""
    )
    + f" SELECT day, instruments, minute, value, round(prior, 2) AS prior, {_FORECAST_COLUMNS} FROM f",
)
def x16b(spark: SparkSession, d: str) -> DataFrame:
    """The last week's days, each as today: the day's newest snapshots against what the same instruments traded before."""
    snapshots = adapters.intraday_snapshots(spark, d).withColumn("day", F.col("snapshot_ts").cast("date"))
    newest = F.max_by(F.struct("cum_volume", "minute", "last_price"), F.struct("snapshot_ts", "event_id")).alias("s")
    latest = snapshots.groupBy("stock_id", "day").agg(newest).select("stock_id", "day", "s.*")
    values = latest.select("stock_id", F.col("day").alias("date"), (F.col("cum_volume") * F.col("last_price").cast("decimal(18,2)")).alias("trade_value"))
    found = quotes.market_value_forecast(latest.where(F.col("day") >= F.lit("2024-01-24").cast("date")), values)
    return found.select("day", "instruments", "minute", "value", F.round("prior", 2).alias("prior"), "forecast", "low", "high", "ratio", "level")


_HOURS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, user_id, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS n FROM events GROUP BY 1, 2"
_LATE = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("z7_stream_bars", f"SELECT * FROM ({_HOURS}) WHERE start + INTERVAL 1 HOUR <= {_LATE}")
def z7(spark: SparkSession, d: str) -> DataFrame:
    return streamed(spark, d, quotes.bars)


@query("z4_stream_trend", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {_LATE}")
def z4(spark: SparkSession, d: str) -> DataFrame:
    return streamed(spark, d, quotes.market_trend)


@query("z6_stream_smoothed", f"SELECT s AS start, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 2 HOUR]) AS s FROM events) GROUP BY 1, 2 HAVING s + INTERVAL 3 HOUR <= {_LATE}")
def z6(spark: SparkSession, d: str) -> DataFrame:
    return streamed(spark, d, quotes.smoothed)


@query("z8_stream_sessions", f"""WITH g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {_LATE}""")
def z8(spark: SparkSession, d: str) -> DataFrame:
    return streamed(spark, d, quotes.sessions)


@query("z3_stream_dedup", "SELECT DISTINCT user_id, ts FROM events")
def z3(spark: SparkSession, d: str) -> DataFrame:
    return streamed(spark, d, lambda s: quotes.deduplicated(s, ["user_id", "ts"]).select("user_id", "ts"))


@query("z2_fresh_quotes", "SELECT event_id, user_id, value FROM events WHERE value IS NOT NULL AND CAST(ts AS DATE) = DATE '2024-01-15'")
def z2(spark: SparkSession, d: str) -> DataFrame:
    return streamed(spark, d, lambda s: quotes.fresh(s, "2024-01-15").select("event_id", "user_id", "value"))


_ALERTS = f"""WITH {_ADV}, e AS (SELECT CAST(user_id AS VARCHAR) AS stock_id, ts, CAST(100 * round(value) * 8 AS BIGINT) AS cum_volume, CAST(floor((hour(ts) * 60 + date_part('minute', ts)) * 270 / 1440) AS INTEGER) AS minute, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end FROM events WHERE CAST(ts AS DATE) >= DATE '{DAY}'),
  l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY stock_id, window_end ORDER BY ts DESC, cum_volume DESC, minute DESC) = 1), f AS (SELECT l.*, adv, {_CURVE} AS pct FROM l JOIN adv ON l.stock_id = adv.stock_id WHERE window_end <= {_LATE} AND cum_volume >= 1000 AND adv > 0),
  g AS (SELECT *, round(cum_volume / pct, 4) AS forecast, round(cum_volume / pct / adv, 4) AS rvol FROM f WHERE pct >= 0.02)
  SELECT stock_id, window_end, ts, cum_volume, minute, adv, pct, forecast, rvol, CASE WHEN rvol >= 2 THEN 'DANGER' WHEN rvol >= 1.6 THEN 'WARN' ELSE 'OBSERVE' END AS level FROM g WHERE rvol >= 1.3"""


@query("z1_stream_alerts", _ALERTS)
def z1(spark: SparkSession, d: str) -> DataFrame:
    base = volume_base(adapters.intraday_snapshots(spark, d))

    def build(stream: DataFrame) -> DataFrame:
        snaps = stream.where(F.col("ts").cast("date") >= F.lit(DAY).cast("date")).select(F.col("user_id").cast("string").alias("stock_id"), "ts", (100 * F.round("value") * 8).cast("long").alias("cum_volume"), F.floor((F.hour("ts") * 60 + F.minute("ts")) * 270 / 1440).cast("int").alias("minute"))
        return quotes.forecast(quotes.latest_per_window(snaps), base)

    return streamed(spark, d, build)


@query(
    "x17_report_index",
    r"""WITH t AS (SELECT url AS path, regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS category, html, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS ti, regexp_extract(html, '(?is)<p[^>]*>(.*?)</p>', 1) AS bo FROM pages),
    c AS (SELECT path, category, html, trim(regexp_replace(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(ti, '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')), '\s*\|[^|]*$', '')) AS title,
      trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(bo, '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM t),
    r AS (SELECT path, category, title, coalesce(try_cast(nullif(regexp_extract(path, '(20\d\d-\d\d-\d\d)', 1), '') AS DATE), try_cast(nullif(regexp_extract(html, '(20\d\d-\d\d-\d\d)', 1), '') AS DATE)) AS date,
      CASE """
    + " ".join("WHEN " + " OR ".join(f"contains(lower(title || ' ' || body), '{w}')" for w in words) + f" THEN '{name}'" for name, words in exprs.RATINGS)
    + r""" END AS rating, substr(body, 1, 80) AS summary FROM c) SELECT *, row_number() OVER (PARTITION BY category ORDER BY date DESC NULLS LAST, path, title) AS place FROM r""",
)
def x17(spark: SparkSession, d: str) -> DataFrame:
    return reports.report_index(adapters.table(spark, d, "pages").select(F.col("url").alias("path"), "html"))


_PREFIXES = [("small", "compact"), ("s", "soft"), ("large", "big")]


@query("f13_prefix_category", "SELECT p_partkey, p_name, CASE WHEN starts_with(p_name, 'small') THEN 'compact' WHEN starts_with(p_name, 's') THEN 'soft' WHEN starts_with(p_name, 'large') THEN 'big' END AS category FROM part")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return reports.categorise(adapters.table(spark, d, "part").select("p_partkey", "p_name"), "p_name", _PREFIXES)


@query("s15_indicator_manifest", "SELECT indicator, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM macro GROUP BY 1")
def s15(spark: SparkSession, d: str) -> DataFrame:
    return sinks.indicator_manifest(adapters.macro_indicators(spark, d))


@query("s16_ranking_rows", "WITH ranked AS (" + _RANK.format(asof="", n=5, col="foreign_buy", market="", k=50).replace("WITH dates", "WITH dates") + ") SELECT *, CASE WHEN side = 'buy' THEN '買超' ELSE '賣超' END AS direction, row_number() OVER (PARTITION BY side ORDER BY CASE WHEN side = 'buy' THEN -net ELSE net END, stock_id) AS rank FROM ranked")
def s16(spark: SparkSession, d: str) -> DataFrame:
    return sinks.ranking_rows(a1(spark, d))


@query("f14_json_payload", "SELECT user_id, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def f14(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return adapters.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


#: A replay deals the days of the events into so many loads.
SLICES = 6
_SLICE = "CAST(floor((CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events)) * 6 / (1 + (SELECT max(CAST(ts AS DATE)) FROM events) - (SELECT min(CAST(ts AS DATE)) FROM events))) AS INTEGER)"


def slice_of(events: DataFrame, slices: int = SLICES):
    """Number of the load of each event, by its day."""
    day = F.unix_date(F.to_date("ts"))
    first, last = events.agg(F.min(day), F.max(day)).first()  # one row
    return F.floor((day - first) * slices / (1 + last - first)).cast("int")


def replayed(spark: SparkSession, d: str, events: DataFrame | None = None, number=None) -> DataFrame:
    """The events as a stream of SLICES micro-batches, from files written in the shared folder for this run."""
    if events is None:
        events = _events(spark, d)
    path = f"{shared_folder(spark)}/replay_{uuid.uuid4().hex}"
    replay.write_slices(events, path, slice_of(_events(spark, d)) if number is None else number, SLICES)
    return replay.replayed(spark, path, events.schema)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return adapters.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")


def stateful(spark: SparkSession, out: DataFrame, partitions: int | None = None) -> DataFrame:
    """Run a stream to its end with its state in RocksDB, then give its table. partitions: of the state, where its keys are few."""
    path = f"{shared_folder(spark)}/live_{uuid.uuid4().hex}"
    with replay.rocksdb(spark, partitions):
        replay.run_to_end(out, path, f"{path}_log")
    return spark.read.schema(out.schema).parquet(path)


@query("z5_stream_latest_state", "SELECT user_id, ts, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def z5(spark: SparkSession, d: str) -> DataFrame:
    """Latest row per user, kept by upserts of several micro-batches into hash buckets."""
    path = f"{shared_folder(spark)}/state_{uuid.uuid4().hex}"
    quotes.create_state(spark, path)
    stream = replayed(spark, d).select("user_id", "ts", "value", "event_id")
    query = stream.writeStream.foreachBatch(quotes.keep_latest(["user_id"], ["ts", "event_id"], path)).option("checkpointLocation", f"{path}_log").trigger(availableNow=True).start()
    query.awaitTermination()
    return quotes.read_state(spark, path, stream.schema)


@query("z1_alerts_restarted", _ALERTS)
def z1b(spark: SparkSession, d: str) -> DataFrame:
    """The alerts over micro-batches of a replay, stopped halfway and restarted from the checkpoint, with state in RocksDB."""
    base = volume_base(adapters.intraday_snapshots(spark, d))
    out = quotes.forecast(quotes.latest_per_window(quoted_volumes(replayed(spark, d))), base)
    path = f"{shared_folder(spark)}/live_{uuid.uuid4().hex}"
    with replay.rocksdb(spark):
        replay.run_with_restart(out, path, f"{path}_log")
    return spark.read.schema(out.schema).parquet(path)


#: Every 17th event comes a load too late.
_SPLIT = f"""WITH e AS (SELECT *, least(5, {_SLICE} + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END) AS load FROM events), n AS (SELECT load, max(ts) AS newest FROM e GROUP BY 1),
  w AS (SELECT load, max(newest) OVER (ORDER BY load ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS watermark FROM n)
  SELECT event_id, load, CASE WHEN ts < watermark THEN 'late' WHEN value IS NULL OR CAST(ts AS DATE) <> DATE '{DAY}' THEN 'stale' ELSE 'fresh' END AS kind FROM e JOIN w USING (load)"""


def split_events(spark: SparkSession, d: str) -> str:
    """Run the split of fresh, stale and late quotes over a replay with late rows; gives the folder of its tables."""
    events = _events(spark, d)
    number = F.least(F.lit(SLICES - 1), slice_of(events) + (F.col("event_id") % 17 == 0).cast("int"))
    path = f"{shared_folder(spark)}/split_{uuid.uuid4().hex}"
    stream = replayed(spark, d, events, number)
    query = stream.writeStream.foreachBatch(quotes.split_late(path, DAY)).option("checkpointLocation", f"{path}_log").trigger(availableNow=True).start()
    query.awaitTermination()
    return path


@query("z2_late_quotes", f"SELECT event_id, CAST(load AS BIGINT) AS epoch, kind FROM ({_SPLIT})")
def z2b(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.schema("event_id long, epoch long, kind string").parquet(f"{split_events(spark, d)}/rows")
    return rows.select("event_id", "epoch", "kind")


@query("z2_late_counts", f"SELECT CAST(load AS BIGINT) AS epoch, count(*) FILTER (kind = 'late') AS late, count(*) FILTER (kind = 'stale') AS stale, count(*) FILTER (kind = 'fresh') AS fresh FROM ({_SPLIT}) GROUP BY 1")
def z2c(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.schema(quotes.COUNTS).parquet(f"{split_events(spark, d)}/counts").select("epoch", "late", "stale", "fresh")


_SESSION = "(hour(ts) * 60 + date_part('minute', ts) - 540 BETWEEN 0 AND 270) AND isodow(ts) <= 5"
_QUOTED = "SELECT *, CAST(user_id AS VARCHAR) AS stock_id, CAST(100 * round(value) * 8 AS BIGINT) AS cum_volume FROM events"


def quoted_volumes(stream: DataFrame) -> DataFrame:
    """Events from the day of the forecasts on as snapshots of a cumulative volume."""
    rows = stream.where(F.col("ts").cast("date") >= F.lit(DAY).cast("date"))
    return rows.select(F.col("user_id").cast("string").alias("stock_id"), "ts", (100 * F.round("value") * 8).cast("long").alias("cum_volume"), F.floor((F.hour("ts") * 60 + F.minute("ts")) * 270 / 1440).cast("int").alias("minute"))


@query(
    "z4_market_ticks",
    _MARKET_FORECAST.format(
        f"""WITH q AS (SELECT * FROM ({_QUOTED}) WHERE {_SESSION} AND cum_volume > 0), l AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE AS tick FROM q QUALIFY row_number() OVER (PARTITION BY stock_id, time_bucket(INTERVAL 30 MINUTE, ts) ORDER BY ts DESC, cum_volume DESC, value DESC) = 1),
    dv AS (SELECT CAST(ts AS DATE) AS date, CAST(sum(cum_volume * CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY stock_id, CAST(ts AS DATE) ORDER BY ts DESC, cum_volume DESC, value DESC) = 1) GROUP BY 1),
    m AS (SELECT date AS day, avg(total) OVER (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior FROM dv),
    t AS (SELECT tick, CAST(tick AS DATE) AS day, least(CAST(hour(tick) * 60 + date_part('minute', tick) - 540 AS INTEGER), 270) AS minute, count(*) AS instruments, CAST(sum(cum_volume * CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM l GROUP BY 1 HAVING tick <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM q)),
    p AS (SELECT t.*, prior, {_CURVE} AS pct FROM t JOIN m ON t.day = m.day)"""
    )
    + f" SELECT tick, minute, instruments, value, {_FORECAST_COLUMNS} FROM f",
)
def z4b(spark: SparkSession, d: str) -> DataFrame:
    snaps = lambda df: df.select(F.col("user_id").cast("string").alias("stock_id"), "ts", (100 * F.round("value") * 8).cast("long").alias("cum_volume"), F.col("value").alias("last_price"))
    past = snaps(_events(spark, d)).where(exprs.in_session(F.col("ts")) & (F.col("cum_volume") > 0)).withColumn("date", F.to_date("ts"))
    newest = past.groupBy("stock_id", "date").agg(F.max(F.struct("ts", "cum_volume", "last_price")).alias("s"))
    daily = newest.groupBy("date").agg(F.sum(F.col("s.cum_volume") * F.col("s.last_price").cast("decimal(18,2)")).cast("double").alias("total"))
    prior = daily.select(F.col("date").alias("day"), F.avg("total").over(Window.orderBy("date").rowsBetween(-20, -1)).alias("prior"))  # one row a day
    out = quotes.market_ticks(snaps(replayed(spark, d)), prior)
    return stateful(spark, out).select("tick", "minute", "instruments", "value", "forecast", "low", "high", "ratio", "level")


@query("z6_pair_strength", f"SELECT * FROM ({composites.QUOTED_STRENGTH}) WHERE date + (minute + 1) * INTERVAL 1 HOUR <= (SELECT min(m) FROM (SELECT max(ts) - INTERVAL 10 MINUTE AS m FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type))")
def z6b(spark: SparkSession, d: str) -> DataFrame:
    """The strength of a pair of contracts, smoothed over the last three shown, from a join of two streams."""
    stream = replayed(spark, d)

    def leg(kind: str) -> DataFrame:
        rows, start = quotes.pair_legs(stream.where(F.col("event_type") == kind)), F.col("window.start")
        bid, ask = F.when(F.hour(start) % 3 > 0, F.col("low")), F.when(F.hour(start) % 4 > 0, F.col("high"))
        return rows.select("window", bid.alias("bid"), ask.alias("ask"), "close", F.when(F.day(start) % 2 == 0, F.col("mean")).alias("ref"), "open")

    got = stateful(spark, state.smoothed_strength(quotes.pair_ticks(leg("click"), leg("view"))), partitions=2)  # open hours of one pair
    shown = F.round("strength", 10)
    colour = F.when(shown > 0, "red").when(shown < 0, "green").otherwise("flat")
    four = lambda c, name: exprs.round_scaled(F.col(c), 4).alias(name)
    return got.select("date", "minute", "a_price", "b_price", "base_source", four("a_change", "a_change"), four("b_change", "b_change"), four("raw", "strength_raw"), four("strength", "strength"), colour.alias("colour"))


_LIVE_FROM = "2024-01-12"
_LIVE_FLAGS = ", ".join(f"CASE WHEN close_price > max(high_price) OVER (PARTITION BY stock_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS break_{n}" for n in DAYS)
_ANY_FLAG = " + ".join(f"break_{n}" for n in DAYS)


@query(
    "z7_live_breakouts",
    f"""WITH b AS (SELECT CAST(user_id AS VARCHAR) AS stock_id, CAST(ts AS DATE) AS date, first(value ORDER BY ts, event_id) AS open_price, max(value) AS high_price, min(value) AS low_price, last(value ORDER BY ts, event_id) AS close_price FROM events WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT * FROM (SELECT *, {_LIVE_FLAGS} FROM b) WHERE {_ANY_FLAG} > 0 AND date >= DATE '{_LIVE_FROM}' AND date + INTERVAL 1 DAY <= {_LATE}""",
)
def z7b(spark: SparkSession, d: str) -> DataFrame:
    """Breakouts of the days from _LIVE_FROM on, streamed, with the days before as initial state."""
    day, events = F.to_date("ts"), _events(spark, d).withColumn("stock_id", F.col("user_id").cast("string"))
    split = F.lit(_LIVE_FROM).cast("date")
    history = events.where((day < split) & F.col("value").isNotNull()).groupBy("stock_id", day.alias("date")).agg(F.max("value").alias("high_price"))
    live = events.where(day >= split).select("stock_id", "ts", "event_id", "value")
    path = f"{shared_folder(spark)}/replay_{uuid.uuid4().hex}"
    replay.write_slices(live, path, slice_of(live, 4), 4)
    got = stateful(spark, state.live_breakouts(replay.replayed(spark, path, live.schema), history))
    return got.where("final").drop("final")


@query("f2_date_forms", "SELECT o_orderkey, (year(o_orderdate) - 1911) || strftime(o_orderdate, '/%m/%d') AS roc, CAST(o_orderdate AS DATE) AS back, CAST(o_orderdate AS DATE) AS from_compact, CAST(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH AS DATE) AS half_year_before FROM orders")
def f2(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    roc = exprs.to_roc(day)
    padded = F.concat(F.lpad(F.split(roc, "/")[0], 3, "0"), F.lit("/"), F.substring_index(roc, "/", -2))
    return adapters.table(spark, d, "orders").select("o_orderkey", roc.alias("roc"), exprs.roc_date(padded).alias("back"), exprs.compact_date(F.date_format(day, "yyyyMMdd")).alias("from_compact"), F.add_months(day, -6).alias("half_year_before"))


@query("f6_session_curve", f"SELECT event_id, minute, round({_CURVE}, 6) AS pct, CAST(hour(snapshot_ts) * 60 + minute(snapshot_ts) - 540 AS INTEGER) AS session_minute, (hour(snapshot_ts) * 60 + minute(snapshot_ts) - 540 BETWEEN 0 AND 270) AND isodow(snapshot_ts) <= 5 AS in_session FROM snaps".replace("minute(snapshot_ts)", "date_part('minute', snapshot_ts)"))
def f6(spark: SparkSession, d: str) -> DataFrame:
    s = adapters.intraday_snapshots(spark, d)
    return s.select("event_id", "minute", F.round(exprs.pct_done(F.col("minute")), 6).alias("pct"), exprs.session_minute(F.col("snapshot_ts")).alias("session_minute"), exprs.in_session(F.col("snapshot_ts")).alias("in_session"))


@query("f18_regime", "SELECT stock_id, date, CASE WHEN high_price - low_price >= 20 THEN 'stress' ELSE 'normal' END AS label, round(least(100.0, (high_price - low_price) / 20 * 50), 4) AS temperature, round(least((high_price - low_price) / 20, 2.0), 4) AS ratio FROM bars")
def f18(spark: SparkSession, d: str) -> DataFrame:
    label, temperature, ratio = exprs.regime_label(F.col("high_price") - F.col("low_price"), F.lit(20.0))
    return adapters.daily_prices(spark, d).select("stock_id", "date", label.alias("label"), F.round(temperature, 4).alias("temperature"), F.round(ratio, 4).alias("ratio"))


@query("f17_array_average", "SELECT stock_id, round(list_avg(a[-3:]), 4) AS last3, len(list_filter(a, lambda v: v > 100)) AS above FROM (SELECT stock_id, list(close_price ORDER BY date) AS a FROM bars GROUP BY 1)")
def f17(spark: SparkSession, d: str) -> DataFrame:
    per = adapters.daily_prices(spark, d).groupBy("stock_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "close_price"))), lambda v: v["close_price"]).alias("a"))  # one bar a week
    return per.select("stock_id", F.round(exprs.last_k_average(F.col("a"), 3), 4).alias("last3"), F.size(F.filter("a", lambda v: v > 100)).alias("above"))
