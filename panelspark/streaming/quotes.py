"""Structured Streaming over intraday quotes: latest state, forecasts, bars, sessions, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from panelspark.functions.exprs import bayes_blend, forecast_ci, in_session, pct_done, round_scaled, session_minute, volume_level
from panelspark.operators.macro import quote_change

from . import replay

QUOTES = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def quote_stream(spark: SparkSession, path: str, schema: str = QUOTES, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(quotes: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """One row per key and time within the watermark; later rows than it are dropped."""
    return quotes.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def fresh(quotes: DataFrame, day: str) -> DataFrame:
    """Priced rows of the trading day only."""
    return quotes.where(F.col("value").isNotNull() & (F.to_date("ts") == F.lit(day).cast("date")))


def latest_per_window(snapshots: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Newest cumulative volume per instrument and window; cumulative counters are never summed. snapshots: stock_id, ts, cum_volume, minute."""
    newest = F.max(F.struct("ts", "cum_volume", "minute")).alias("s")
    return snapshots.withWatermark("ts", late).groupBy(F.window("ts", length), "stock_id").agg(newest).select("stock_id", F.col("window.end").alias("window_end"), "s.*")


def forecast(latest: DataFrame, adv: DataFrame, least_lots: int = 1000, least_pct: float = 0.02) -> DataFrame:
    """Day volume forecast, ratio to the average volume and level of each latest snapshot; batch and stream alike.

    adv: stock_id, adv — static side of a stream-static join.
    """
    pct = pct_done(F.col("minute"))
    rows = latest.join(adv.select("stock_id", "adv"), "stock_id").withColumn("pct", pct).where((F.col("cum_volume") >= least_lots) & (F.col("pct") >= least_pct) & (F.col("adv") > 0))
    rows = rows.withColumn("forecast", F.round(F.col("cum_volume") / F.col("pct"), 4)).withColumn("rvol", F.round(F.col("cum_volume") / F.col("pct") / F.col("adv"), 4))
    return rows.withColumn("level", volume_level(F.col("rvol"))).where("level <> 'NONE'")


def bars(quotes: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling open, high, low, close and count per instrument."""
    order = F.struct("ts", "event_id")
    return quotes.withWatermark("ts", late).groupBy(F.window("ts", length), "user_id").agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "user_id", "open", "high", "low", "close", "n")


def smoothed(quotes: DataFrame, length: str = "3 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean per event type over sliding windows."""
    return quotes.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "mean", "n")


def sessions(quotes: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions per user, closed by a gap."""
    return quotes.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n", "total")


def market_trend(quotes: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """One row per window over the whole market."""
    return quotes.withWatermark("ts", late).groupBy(F.window("ts", length)).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def market_ticks(snapshots: DataFrame, prior: DataFrame, length: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Per tick the value traded so far by the instruments seen in it, with the day's forecast, its interval and level.

    snapshots: stock_id, ts, cum_volume, last_price; only rows within the session count. prior: day, prior — the value
    of an average day, one row a day. Two stateful operators in a row: the newest snapshot per instrument and tick, then
    their sum by the tick's window time.
    """
    rows = snapshots.where(in_session(F.col("ts")) & (F.col("cum_volume") > 0) & F.col("last_price").isNotNull()).withWatermark("ts", late)
    newest = rows.groupBy(F.window("ts", length), "stock_id").agg(F.max(F.struct("ts", "cum_volume", "last_price")).alias("s"))
    value = F.col("s.cum_volume") * F.col("s.last_price").cast("decimal(18,2)")
    market = newest.groupBy(F.window(F.window_time("window"), length)).agg(F.sum(value).cast("double").alias("value"), F.count("*").alias("instruments"))
    end = F.col("window.end")
    ticks = market.select(end.alias("tick"), F.to_date(end).alias("day"), F.least(session_minute(end), F.lit(270)).alias("minute"), "instruments", "value")
    return value_forecast(ticks.withColumn("pct", pct_done(F.col("minute"))).join(F.broadcast(prior), "day"), "value", "prior")  # one row a day


def value_forecast(rows: DataFrame, value: str, prior: str) -> DataFrame:
    """rows (with pct) and forecast, low, high, ratio to the prior and level; without a positive prior there is no row."""
    rows = rows.where(F.col(prior) > 0).withColumn("_f", bayes_blend(F.col(value), F.col("pct"), F.col(prior)))
    low, high = forecast_ci(F.col("_f"), F.col("pct"))
    ratio = F.col("_f") / F.col(prior)
    out = rows.withColumns({"forecast": F.round("_f", 2), "low": F.round(low, 2), "high": F.round(high, 2), "ratio": F.round(ratio, 3), "level": volume_level(ratio)})
    return out.drop("_f")


def market_value_forecast(snapshots: DataFrame, values: DataFrame, back: int = 20) -> DataFrame:
    """Forecast of each day's traded value from the newest snapshots of the instruments seen that day.

    snapshots: day, stock_id, cum_volume, last_price, minute — one row per instrument and day; values: stock_id, date,
    trade_value. The prior is the mean over the last `back` dates before the day of what the day's own instruments
    traded, so thin trading early on does not shrink the day against the whole market. Work grows with the days asked for.
    """
    seen = snapshots.where((F.col("cum_volume") > 0) & F.col("last_price").isNotNull())
    price = F.col("last_price").cast("decimal(18,2)")
    today = seen.groupBy("day").agg(F.sum(F.col("cum_volume") * price).cast("double").alias("value"), F.max("minute").alias("minute"), F.count("*").alias("instruments")).where("value > 0")
    earlier = seen.select("day", "stock_id").join(values.select("stock_id", "date", "trade_value"), "stock_id").where("date < day")
    dates = earlier.groupBy("day", "date").agg(F.sum(F.coalesce("trade_value", F.lit(0))).alias("total"))
    newest = Window.partitionBy("day").orderBy(F.desc("date"))  # one row a date
    prior = dates.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= back).groupBy("day").agg(F.avg(F.col("total").cast("double")).alias("prior"))
    return value_forecast(today.withColumn("pct", pct_done(F.col("minute"))).join(prior, "day"), "value", "prior")


def pair_legs(quotes: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Quotes of one leg per window: start, low, high, close, mean, open.

    The mean adds the values up in order of (ts, event_id), whatever the order of arrival: it often lies halfway between
    two shown values, where the order of a sum of doubles decides. An open window's state holds its quotes for that.
    """
    order = F.struct("ts", "event_id")
    four = lambda c: round_scaled(c, 4)
    legs = quotes.withWatermark("ts", late).groupBy(F.window("ts", length)).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", order).alias("close"), F.collect_list(F.when(F.col("value").isNotNull(), F.struct("ts", "event_id", "value"))).alias("_seen"), F.min_by("value", order).alias("open"))
    total = F.aggregate(F.array_sort("_seen"), F.lit(0.0), lambda s, q: s + q["value"])
    return legs.select("window", four(F.col("low")).alias("low"), four(F.col("high")).alias("high"), "close", four(F.try_divide(total, F.size("_seen"))).alias("mean"), "open")


def pair_ticks(a: DataFrame, b: DataFrame, pair: str = "a/b") -> DataFrame:
    """Stream-stream join of two legs (window, bid, ask, close, ref, open) on their window, with changes and raw strength."""

    def side(df: DataFrame, p: str) -> DataFrame:
        price, source, change = quote_change(*[F.col(c) for c in ("bid", "ask", "close", "ref", "open")])
        return df.select("window", F.round(F.round(price, 6), 2).alias(f"{p}_price"), source.alias(f"{p}_src"), change.alias(f"{p}_change"))

    start = F.col("window.start")
    source = F.when(F.col("a_src") == F.col("b_src"), F.col("a_src")).otherwise("mixed")
    return side(a, "a").join(side(b, "b"), "window").select(F.lit(pair).alias("pair"), F.to_date(start).alias("date"), F.hour(start).alias("minute"), "a_price", "b_price", source.alias("base_source"), "a_change", "b_change", (F.col("a_change") - F.col("b_change")).alias("raw"))


def split_late(path: str, day: str, late: str = "10 minutes") -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: each row goes to one of the tables late, stale and fresh under path/rows, and is counted.

    late: older than the watermark, which is the newest time of all earlier batches less the delay; stale: without a
    value or of another day; fresh: the rest. A repeated batch overwrites its own files and counts with the same rows:
    its watermark depends on earlier batches only. path/counts holds epoch, newest, watermark, late, stale, fresh.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        watermark = None
        if epoch:
            earlier = spark.read.schema(COUNTS).parquet(f"{path}/counts").where(F.col("epoch") < epoch)
            watermark = earlier.agg(F.max("newest") - F.expr(f"INTERVAL {late}")).first()[0]
        too_late = F.col("ts") < F.lit(watermark).cast("timestamp")
        off = F.col("value").isNull() | (F.to_date("ts") != F.lit(day).cast("date"))
        kind = F.when(too_late, "late").when(off, "stale").otherwise("fresh")
        seen = Observation()
        rows = batch.withColumn("kind", kind).observe(seen, F.max("ts").alias("newest"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("late", "stale", "fresh")])
        rows.write.partitionBy("kind").mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        got = seen.get
        spark.createDataFrame([(epoch, got["newest"], watermark, got["late"], got["stale"], got["fresh"])], COUNTS).drop("epoch").coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/epoch={epoch}")

    return write


COUNTS = "epoch long, newest timestamp, watermark timestamp, late long, stale long, fresh long"
MANIFEST = "epoch long, bucket int, version long"


def create_state(spark: SparkSession, path: str) -> None:
    """An empty keyed table for keep_latest."""
    spark.createDataFrame([], "bucket int, version long").write.parquet(f"{path}/manifest/epoch=-1")


def _versions(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, dict[int, int]]:
    """Newest committed epoch (before a given one), and the version of each bucket then: one row a bucket."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    rows = rows if before is None else rows.where(F.col("epoch") < before)
    newest = rows.agg(F.max("epoch")).first()[0]
    return (-1, {}) if newest is None else (newest, {r.bucket: r.version for r in rows.where(F.col("epoch") == newest).collect()})


def read_state(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of the newest committed version of every bucket."""
    _, versions = _versions(spark, path)
    files = [f"{path}/rows/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def keep_latest(keys: list[str], order: list[str], path: str, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: the newest row per key, in a table of hash buckets of which a batch rewrites only those it touches.

    A new version of the touched buckets is written beside the old one; the manifest of the epoch, written last, is the
    commit. An epoch whose manifest is there changes nothing; one that was cut off before it is written again from the
    epochs before. create_state() makes the table, read_state() reads it. The number of buckets is fixed for a table:
    choose it so that a bucket is a few hundred MB.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if _versions(spark, path)[0] >= epoch:
            return
        _, versions = _versions(spark, path, epoch)
        rows = batch.select("*", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return
        old = [f"{path}/rows/version={versions[b]}/bucket={b}" for b in touched if b in versions]
        if old:
            kept = spark.read.schema(batch.schema).option("basePath", f"{path}/rows").parquet(*old)
            rows = rows.unionByName(kept.select(*batch.columns, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")))
        row = F.struct(*order, F.struct(*batch.columns).alias("_row"))
        newest = rows.groupBy("bucket", *keys).agg(F.max(row).alias("_r")).select("_r._row.*", "bucket")
        newest.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/rows/version={epoch}")
        versions |= dict.fromkeys(touched, epoch)
        spark.createDataFrame(sorted(versions.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/epoch={epoch}")

    return write


def run_to_end(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over all that is available and stop; results in a Parquet table at path, which tasks write."""
    return replay.run_to_end(df, path, checkpoint)
