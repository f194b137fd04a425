"""Order-dependent recursions, one instrument's history at a time in pandas (grouped by instrument, sorted by date)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import in_chunks


def _rounded(x: np.ndarray, places: int = 2) -> np.ndarray:
    """Half away from zero, as Spark rounds."""
    scale = 10.0**places
    return np.sign(x) * np.floor(np.abs(x) * scale + 0.5) / scale


def ema(values: np.ndarray, n: int) -> np.ndarray:
    return pd.Series(values).ewm(alpha=2 / (n + 1), adjust=False).mean().to_numpy()


def macd(prices: DataFrame, fast: int = 12, slow: int = 26, smooth: int = 9) -> DataFrame:
    """EMAs, their difference (from rounded values, null if either is 0), its signal line and histogram, all to two places."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["close_price"].notna()].sort_values("date")
        close = pdf["close_price"].to_numpy()
        a, b = _rounded(ema(close, fast)), _rounded(ema(close, slow))
        dif = np.where((a == 0) | (b == 0), np.nan, _rounded(a - b))
        signal = np.full(len(dif), np.nan)
        there = ~np.isnan(dif)
        signal[there] = _rounded(ema(dif[there], smooth))
        return pd.DataFrame({"stock_id": pdf["stock_id"], "date": pdf["date"], "ema_fast": a, "ema_slow": b, "dif": dif, "signal": signal, "hist": _rounded(dif - signal)})

    return prices.select("stock_id", "date", "close_price").groupBy("stock_id").applyInPandas(run, "stock_id string, date date, ema_fast double, ema_slow double, dif double, signal double, hist double")


def kd(prices: DataFrame, n: int = 9) -> DataFrame:
    """Stochastic K and D from 50, one third of the new value at a time, from the n-th row on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["close_price"].notna()].sort_values("date")
        high, low = pdf["high_price"].rolling(n).max().to_numpy(), pdf["low_price"].rolling(n).min().to_numpy()
        with np.errstate(invalid="ignore", divide="ignore"):
            rsv = np.where(high > low, (pdf["close_price"].to_numpy() - low) / (high - low) * 100, 50.0)
        k, d, ks, ds = 50.0, 50.0, [], []
        for i, r in enumerate(rsv):
            if i < n - 1:
                ks.append(np.nan)
                ds.append(np.nan)
                continue
            k = 2 / 3 * k + r / 3
            d = 2 / 3 * d + k / 3
            ks.append(k)
            ds.append(d)
        return pd.DataFrame({"stock_id": pdf["stock_id"], "date": pdf["date"], "k": _rounded(np.array(ks, float)), "d": _rounded(np.array(ds, float))})

    return prices.select("stock_id", "date", "high_price", "low_price", "close_price").groupBy("stock_id").applyInPandas(run, "stock_id string, date date, k double, d double")


def rsi(prices: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's RSI: first the plain mean of n changes, then smoothed; 100 without losses; null before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["close_price"].notna()].sort_values("date")
        step = np.diff(pdf["close_price"].to_numpy())
        out = np.full(len(pdf), np.nan)
        if len(step) >= n:
            gain, loss = np.maximum(step, 0), np.maximum(-step, 0)
            g, s = gain[:n].mean(), loss[:n].mean()
            out[n] = 100.0 if s == 0 else 100 - 100 / (1 + g / s)
            for i in range(n, len(step)):
                g, s = (g * (n - 1) + gain[i]) / n, (s * (n - 1) + loss[i]) / n
                out[i + 1] = 100.0 if s == 0 else 100 - 100 / (1 + g / s)
        return pd.DataFrame({"stock_id": pdf["stock_id"], "date": pdf["date"], "rsi": _rounded(out)})

    return prices.select("stock_id", "date", "close_price").groupBy("stock_id").applyInPandas(run, "stock_id string, date date, rsi double")


def roll(cost: float, buy: float, balance: float, close: float) -> float:
    """Average cost after a day's margin buying at its close."""
    if not balance > 0 or buy != buy or close != close:
        return cost
    return cost + min(1.0, max(0.0, buy / balance)) * (close - cost)


def roll_cost(seed: DataFrame, margin: DataFrame, prices: DataFrame, dates: int = 400) -> DataFrame:
    """Latest rolled cost of each seeded instrument: seed (stock_id, cost, seed_date), then the days after, at most `dates`."""
    days = margin.select("stock_id", "date", "buy", "balance").join(prices.select("stock_id", "date", "close_price"), ["stock_id", "date"])
    rows = days.join(seed, "stock_id").where("date > seed_date").withColumn("_n", F.row_number().over(Window.partitionBy("stock_id").orderBy("date"))).where(F.col("_n") <= dates)
    bought = F.when(F.col("balance") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("buy") / F.col("balance"))))
    known = F.col("buy").isNotNull() & F.col("close_price").isNotNull()
    step = F.struct("_n", F.when(known, bought).alias("share"), F.col("close_price").alias("close"))
    steps = F.array_sort(F.collect_list(step))  # at most `dates` of an instrument
    per = rows.groupBy("stock_id").agg(F.first("cost").cast("double").alias("_seed"), steps.alias("_steps"), F.count("*").alias("days"))
    rolled = F.aggregate("_steps", F.col("_seed"), lambda cost, s: F.when(s["share"].isNull(), cost).otherwise(cost + s["share"] * (s["close"] - cost)))
    return per.select("stock_id", rolled.alias("cost"), "days")


def lasso(x: np.ndarray, y: np.ndarray, alpha: float, rounds: int = 200) -> np.ndarray:
    """Coordinate descent on the Gram matrix of standardised columns."""
    n = len(y)
    gram, target = x.T @ x / n, x.T @ y / n
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            rho = target[j] - gram[j] @ w + gram[j, j] * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0) / gram[j, j] if gram[j, j] > 0 else 0.0
        if np.abs(w - before).max() < 1e-9:
            break
    return w


def lasso_many(grams: np.ndarray, targets: np.ndarray, alpha: float, rounds: int = 200) -> np.ndarray:
    """lasso() for many Gram matrices at once: each takes the same steps as alone and stops when it has converged.

    What is left of a target after its weights is kept up to date, so a step costs one column of the Gram matrix.
    """
    done = np.zeros_like(targets)
    active = np.arange(len(targets))
    g, w = np.ascontiguousarray(np.moveaxis(grams, 0, 2)), np.zeros_like(targets).T.copy()  # fits last: steps run along them
    left, d = targets.T.copy(), np.einsum("jjf->jf", g).copy()
    for _ in range(rounds):
        if not len(active):
            break
        moved = np.zeros(len(active))
        inverse = np.divide(1.0, d, out=np.zeros_like(d), where=d > 0)
        for j in range(len(w)):
            rho = left[j] + d[j] * w[j]
            new = (rho - np.clip(rho, -alpha, alpha)) * inverse[j]
            step = new - w[j]
            left -= g[j] * step
            w[j] = new
            np.maximum(moved, np.abs(step), out=moved)
        going = moved >= 1e-9
        if going.sum() < 0.75 * len(going) or not going.any():
            done[active[~going]] = w[:, ~going].T
            active, g, w, left, d = active[going], g[:, :, going], w[:, going], left[:, going], d[:, going]
    done[active] = w.T
    return done


def window_moments(x: np.ndarray, y: np.ndarray, use: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Count, means, deviations, standardised Gram matrix and target of x and y over rows starts:ends, counting `use` rows only.

    Running sums of the outer products, shifted by the overall means, give each window as a difference of two of them.
    """
    p = x.shape[1]
    shift_x, shift_y = (x[use].mean(axis=0), y[use].mean()) if use.any() else (np.zeros(p), 0.0)
    z = np.column_stack([np.where(use[:, None], x - shift_x, 0.0), np.where(use, y - shift_y, 0.0)])
    sums = np.vstack([np.zeros(p + 1), np.cumsum(z, axis=0)])
    products = np.concatenate([np.zeros((1, p, p + 1)), np.cumsum(z[:, :p, None] * z[:, None, :], axis=0)])
    counts = np.concatenate([[0], np.cumsum(use)])
    n = counts[ends] - counts[starts]
    m = np.maximum(n, 1)[:, None]
    mean = (sums[ends] - sums[starts]) / m
    cross = (products[ends] - products[starts]) / m[:, :, None] - mean[:, :p, None] * mean[:, None, :]
    variance = np.einsum("fjj->fj", cross[:, :, :p])
    flat = variance <= 1e-18
    scale = np.where(flat, 1.0, np.sqrt(np.maximum(variance, 0.0)))
    cross[flat] = 0.0  # a constant column takes no weight
    gram = cross[:, :, :p] / scale[:, :, None] / scale[:, None, :]
    gram = np.where(flat[:, None, :], 0.0, gram)
    return n, mean[:, :p] + shift_x, mean[:, p] + shift_y, scale, gram, cross[:, :, p] / scale


def rolling_lasso_signal(features: DataFrame, columns: list[str], window: int = 756, ahead: int = 20, alpha: float = 0.001, refit: int = 1, lag_target: bool = True, chunk: int | None = None) -> DataFrame:
    """Predicted `ahead`-row return from a Lasso on the last `window` rows before each row.

    lag_target leaves out rows whose target looks past the row predicted; without it the newest targets leak. A refit
    whose window has no more complete rows than there are columns gives no prediction until the next one. Histories are
    cut into chunks that reach back over window, target and refit, so a long one is several tasks.
    """

    def moments(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """Rows to predict of one chunk, which fit serves each, and the fits."""
        x, close, number = pdf[columns].to_numpy(float), pdf["close_price"].to_numpy(float), pdf["_row"].to_numpy(int)
        y, ok = pdf["_later"].to_numpy(float) / close - 1, np.isfinite(x).all(axis=1)
        wanted = np.flatnonzero(pdf["_own"].to_numpy(bool) & (number >= window) & ok)
        fits, which = np.unique(number[wanted] - (number[wanted] - window) % refit - number[0], return_inverse=True)
        ends = np.maximum(fits - ahead if lag_target else fits, 0)
        n, *rest = window_moments(np.where(ok[:, None], x, 0.0), np.nan_to_num(y), ok & np.isfinite(y), np.maximum(ends - window, 0), ends)
        keep = n > len(columns)
        place = np.cumsum(keep) - 1
        served = keep[which]
        return x[wanted[served]], wanted[served], place[which[served]], *[m[keep] for m in rest]

    def solved(waiting: list[tuple]) -> pd.DataFrame:
        """Predictions of several chunks, whose fits are solved together."""
        weights = lasso_many(np.concatenate([m[6] for _, m in waiting]), np.concatenate([m[7] for _, m in waiting]), alpha)
        out, first = [], 0
        for pdf, (x, rows, which, mean, middle, scale, gram, _) in waiting:
            w = weights[first : first + len(gram)]
            first += len(gram)
            signal = np.full(len(pdf), np.nan)
            signal[rows] = middle[which] + ((x - mean[which]) / scale[which] * w[which]).sum(axis=1)
            out.append(pdf.assign(signal=signal).loc[pdf["_own"].to_numpy(bool), ["stock_id", "date", "close_price", "signal"]])
        return pd.concat(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, fits = [], 0
        for pdf in whole_chunks(batches):
            found = moments(pdf)
            waiting.append((pdf, found))
            fits += len(found[6]) + 1
            if fits >= FITS:
                yield solved(waiting)
                waiting, fits = [], 0
        if waiting:
            yield solved(waiting)

    later = F.lead("close_price", ahead).over(Window.partitionBy("stock_id").orderBy("date"))
    complete = reduce(and_, [F.col(c).isNotNull() for c in columns])
    known = [F.when(complete, F.col(c)).alias(c) for c in columns]  # a row that lacks one counts nowhere, and nulls take no space where rows are exchanged
    rows = in_chunks(features.select("stock_id", "date", "close_price", *known, later.alias("_later")), "stock_id", window + ahead + refit, size=chunk)
    return rows.repartition("stock_id", "_chunk").sortWithinPartitions("stock_id", "_chunk", "_row").mapInPandas(run, "stock_id string, date date, close_price double, signal double")


#: Fits of different instruments that are solved together.
FITS = 4096


def whole_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chunks of a partition sorted by (stock_id, _chunk, _row), one at a time, however the batches cut them."""
    left: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        new = (batch["stock_id"].ne(batch["stock_id"].shift()) | batch["_chunk"].ne(batch["_chunk"].shift())).to_numpy()
        starts = np.flatnonzero(new)
        if left and (left[-1]["stock_id"].iloc[-1], left[-1]["_chunk"].iloc[-1]) == (batch["stock_id"].iloc[0], batch["_chunk"].iloc[0]):
            starts = starts[1:]
            left.append(batch.iloc[: starts[0] if len(starts) else len(batch)])
        for a, b in pairwise([*starts, len(batch)]):  # none if the batch lies within one chunk
            if left:
                yield pd.concat(left, ignore_index=True)
            left = [batch.iloc[a:b]]
    if left:
        yield pd.concat(left, ignore_index=True)
