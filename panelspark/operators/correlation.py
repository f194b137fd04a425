"""Correlations of all pairs of series, as sums of products over tiles of the pair matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Series and dates of a packed row; bands of series, unless one would have more cells (dates by series) than CELLS.
BLOCK, DATES, BANDS, CELLS = 64, 1024, 16, 1 << 22
PACKED = pa.schema([("of", pa.int64()), ("run", pa.int64()), ("at", pa.list_(pa.int32())), ("names", pa.list_(pa.string())), ("width", pa.int32()), ("levels", pa.int32()), ("m", pa.binary())])

# The dimension of each indicator, and how a correlation's strength reads.
DIMENSIONS = {"regime": "股票異常", "credit": "信用風險", "breadth": "台股內部", "T10Y3M": "景氣政策", "CP_SPREAD": "資金流動", "DOLLAR": "資金流動", "COR3M": "尾部波動", "MOVE": "尾部波動"}
READINGS = ((0.8, "極強{} — 高度共線風險"), (0.6, "強{} — 需注意權重"), (0.4, "中度{} — 互補性尚可"), (0.2, "弱{} — 獨立性佳"))
UNRELATED, TOO_SHORT, POSITIVE, NEGATIVE = "幾乎無關 — 完全獨立", "資料不足", "正相關", "負相關"
BUCKETS = ((0.6, "high"), (0.3, "moderate"))

def packed(x: np.ndarray) -> tuple[int, bytes]:
    """How many different values x has, and these, then the cells' places among them byte by byte, compressed: changes in percent to two places repeat."""
    levels, place = np.unique(x, return_inverse=True)
    return len(levels), pa.compress(levels.tobytes() + place.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(m: bytes, levels: int, shape: tuple[int, int]) -> np.ndarray:
    cells = shape[0] * shape[1]
    raw = np.frombuffer(pa.decompress(m, 8 * levels + 4 * cells, "zstd"), np.uint8)
    place = np.ascontiguousarray(raw[8 * levels :].reshape(4, cells).T).view("<u4")
    return raw[: 8 * levels].view(np.float64)[place].reshape(shape)


def pair_correlations(series: DataFrame, least: int = 5, block: int = BLOCK, dates: int = DATES) -> DataFrame:
    """Every two series that share a date: a, b (a before b), n common dates, and their correlation r over these, to four places.

    series: date, series, value; one row per date and series, nulls and NaN are no value. r is null on fewer than `least`
    dates and 0 where a series does not move on them. Series are numbered by name; the values of `block` of them over
    `dates` dates make one packed row, and some blocks a band. A packed row goes to the tiles of its band's row and
    column, and a tile, which is one task's, gives its pairs finished, so what is shuffled grows with the values times the
    bands, not with the pairs. The table of series is broadcast: the result has the square of its rows.
    """
    known = series.where(F.col("value").isNotNull() & ~F.isnan("value"))
    names = known.select("series").distinct().withColumn("at", F.row_number().over(Window.orderBy("series")) - 1)
    days = known.select("date").distinct().withColumn("day", F.row_number().over(Window.orderBy("date")) - 1)
    placed = known.join(F.broadcast(names), "series").join(F.broadcast(days), "date")
    cut = placed.select(F.floor(F.col("at") / block).alias("of"), F.floor(F.col("day") / dates).alias("run"), "at", (F.col("day") % dates).alias("day"), "series", F.col("value").cast("double").alias("v"))

    def pack(rows: pa.Table) -> pa.Table:
        at, first, row = np.unique(rows["at"].to_numpy(), return_index=True, return_inverse=True)
        day = rows["day"].to_numpy()
        x = np.full((len(at), int(day.max()) + 1), np.nan)
        x[row, day] = rows["v"].to_numpy()
        levels, m = packed(x)
        return pa.table({"of": rows["of"][:1], "run": rows["run"][:1], "at": [at.tolist()], "names": [rows["series"].take(pa.array(first)).to_pylist()], "width": [x.shape[1]], "levels": [levels], "m": [m]}, schema=PACKED)

    blocks = cut.groupBy("of", "run").applyInArrow(pack, "of long, run long, at array<int>, names array<string>, width int, levels int, m binary")
    size = names.agg((F.max("at") + 1).alias("_series")).join(days.agg((F.max("day") + 1).alias("_days")))  # one row
    per = F.greatest(F.lit(1), F.least(F.ceil(F.col("_series") / (block * BANDS)), F.floor(CELLS / (F.col("_days") * block))))
    banded = blocks.join(F.broadcast(size)).withColumn("band", F.floor(F.col("of") / per)).withColumn("_last", F.floor((F.ceil(F.col("_series") / block) - 1) / per))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_last")), lambda o: F.struct(F.least("band", o).alias("i"), F.greatest("band", o).alias("j")))
    dealt = banded.withColumn("t", F.explode(tiles)).select("t.i", "t.j", "band", "of", "run", "at", "names", "width", "levels", "m")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        i, j, span = rows[0]["i"], rows[0]["j"], max(r["run"] * dates + r["width"] for r in rows)

        def side(band: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
            """Names of a band's series, their values less their means (0 for none), and where there are any."""
            mine = [r for r in rows if r["band"] == band]
            first = min(r["of"] for r in mine) * block
            x = np.full((max(r["at"][-1] for r in mine) - first + 1, span), np.nan)
            name = [""] * len(x)
            for r in mine:
                at, start = np.array(r["at"]) - first, r["run"] * dates
                x[at, start : start + r["width"]] = unpacked(r["m"], r["levels"], (len(at), r["width"]))
                for k, series_name in zip(at, r["names"], strict=True):
                    name[k] = series_name
            there = ~np.isnan(x)
            x[~there] = 0.0
            x -= (x.sum(axis=1) / there.sum(axis=1))[:, None]
            x[~there] = 0.0
            return pa.array(name, pa.string()), x, there.astype(float)

        left = side(i)
        a_names, x, mx = left
        b_names, y, my = left if i == j else side(j)
        yy = y * y
        for s in range(0, len(x), block):
            p, m = x[s : s + block], mx[s : s + block]
            t = s + 1 if i == j else 0  # first of the other series
            n = m @ my[t:].T
            keep = n > 0
            if i == j:
                keep &= np.arange(t, len(y)) > np.arange(s, s + len(p))[:, None]
            a, b = np.nonzero(keep)
            if not len(a):
                continue
            sums = (v[keep] for v in (p @ my[t:].T, m @ y[t:].T, (p * p) @ my[t:].T, m @ yy[t:].T, p @ y[t:].T))
            n = n[keep]
            r = pearson(n, *sums)
            yield pa.record_batch([a_names.take(pa.array(a + s)), b_names.take(pa.array(b + t)), pa.array(n.astype(np.int64)), pa.array(r, mask=n < least)], names=["a", "b", "n", "r"])

    return dealt.groupBy("i", "j").applyInArrow(tile, "a string, b string, n long, r double")


def pearson(n: np.ndarray, sx: np.ndarray, sy: np.ndarray, sxx: np.ndarray, syy: np.ndarray, sxy: np.ndarray) -> np.ndarray:
    """Correlation from sums of products, to four places, half away from zero; 0 where a series does not move."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    still = (vx <= 1e-12 * np.maximum(sxx, 1e-300)) | (vy <= 1e-12 * np.maximum(syy, 1e-300))
    r = (sxy - sx * sy / n) / np.sqrt(np.where(still, 1.0, vx * vy))
    r[still] = 0.0
    return np.sign(r) * np.floor(np.abs(r) * 1e4 + 0.5) / 1e4 + 0.0


def reading(r: Column) -> Column:
    direction = F.when(r > 0, POSITIVE).otherwise(NEGATIVE)
    out = F.when(r.isNull(), TOO_SHORT)
    for least, text in READINGS:
        before, after = text.split("{}")
        out = out.when(F.abs(r) >= least, F.concat(F.lit(before), direction, F.lit(after)))
    return out.otherwise(UNRELATED)


def correlation_matrix(series: DataFrame, least: int = 5, dimensions: dict[str, str] = DIMENSIONS, block: int = BLOCK, dates: int = DATES) -> DataFrame:
    """Every pair of series that share a date: a, b, n, r, bucket, reading, same_dimension.

    r is null, and so is the bucket, on fewer than `least` common dates; same_dimension is true for two series that
    are in no dimension.
    """
    pairs = pair_correlations(series, least, block, dates)
    bucket = F.when(F.col("r").isNull(), None)
    for limit, name in BUCKETS:
        bucket = bucket.when(F.abs("r") >= limit, name)
    kind = F.create_map(*[F.lit(x) for kv in dimensions.items() for x in kv])
    return pairs.select("a", "b", "n", "r", bucket.otherwise("low").alias("bucket"), reading(F.col("r")).alias("reading"), kind[F.col("a")].eqNullSafe(kind[F.col("b")]).alias("same_dimension"))
