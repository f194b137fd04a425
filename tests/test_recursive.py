"""Recursions against plain loops, and the published constants of the cost roll."""

import numpy as np
import pandas as pd

from panelspark.operators import recursive
from panelspark.sources import adapters


def history(spark, small, stock="1"):
    return adapters.daily_prices(spark, small).where(f"stock_id = '{stock}'").orderBy("date").toPandas()


def rounded(x, n=2):
    return np.sign(x) * np.floor(abs(x) * 10**n + 0.5) / 10**n


def test_macd(spark, small):
    pdf = history(spark, small)
    got = recursive.macd(adapters.daily_prices(spark, small)).where("stock_id = '1'").orderBy("date").toPandas()

    def ema(values, n):
        out = []
        for v in values:
            out.append(v if not out else out[-1] + 2 / (n + 1) * (v - out[-1]))
        return np.array(out)

    a, b = rounded(ema(pdf.close_price, 12)), rounded(ema(pdf.close_price, 26))
    dif = rounded(a - b)
    assert np.allclose(got.ema_fast, a, atol=0.011) and np.allclose(got.dif, dif, atol=0.021)
    assert np.allclose(got.signal, rounded(ema(dif, 9)), atol=0.021)


def test_kd(spark, small):
    pdf = history(spark, small)
    got = recursive.kd(adapters.daily_prices(spark, small)).where("stock_id = '1'").orderBy("date").toPandas()
    k = d = 50.0
    for i in range(len(pdf)):
        if i < 8:
            assert pd.isna(got.k[i])
            continue
        hi, lo = pdf.high_price[i - 8 : i + 1].max(), pdf.low_price[i - 8 : i + 1].min()
        r = 50.0 if hi == lo else (pdf.close_price[i] - lo) / (hi - lo) * 100
        k = 2 / 3 * k + r / 3
        d = 2 / 3 * d + k / 3
        assert abs(got.k[i] - k) < 0.006 and abs(got.d[i] - d) < 0.006


def test_rsi(spark, small):
    pdf = history(spark, small)
    got = recursive.rsi(adapters.daily_prices(spark, small)).where("stock_id = '1'").orderBy("date").toPandas()
    step = pdf.close_price.diff().to_numpy()[1:]
    g, s = np.maximum(step[:14], 0).mean(), np.maximum(-step[:14], 0).mean()
    for i in range(14, len(pdf)):
        if i > 14:
            g, s = (g * 13 + max(step[i - 1], 0)) / 14, (s * 13 + max(-step[i - 1], 0)) / 14
        assert abs(got.rsi[i] - (100 if s == 0 else 100 - 100 / (1 + g / s))) < 0.006
    assert got.rsi[:14].isna().all()


def test_roll_constants():
    assert abs(recursive.roll(886.7276, 5572, 54043, 1140) - 912.84) < 0.01
    assert recursive.roll(100.0, 5, 0, 120.0) == 100.0
    assert recursive.roll(100.0, 500, 50, 120.0) == 120.0


def test_roll_cost(spark, small):
    from panelspark.plans.series import cost_seed

    prices, margin = adapters.daily_prices(spark, small), adapters.margin(spark, small)
    got = {r.stock_id: r.cost for r in recursive.roll_cost(cost_seed(prices), margin, prices).collect()}
    joined = margin.join(prices, ["stock_id", "date"]).orderBy("date").toPandas()
    for stock, rows in joined.groupby("stock_id"):
        cost = rows.close_price.iloc[0]
        for r in rows.iloc[1:401].itertuples():
            cost = recursive.roll(cost, r.buy, r.balance, r.close_price)
        assert abs(got[stock] - cost) < 1e-9


def test_lasso_shrinks_and_fits():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = 2 * x[:, 0] - x[:, 2] + rng.normal(scale=0.01, size=500)
    w = recursive.lasso(x, y, 0.001)
    assert np.allclose(w, [2, 0, -1, 0], atol=0.02)
    assert not recursive.lasso(x, y, 100.0).any()


def test_rolling_lasso_refits_at_every_row(spark, small):
    from panelspark.plans import QUERIES

    prices = adapters.daily_prices(spark, small)
    stock = prices.groupBy("stock_id").count().orderBy("count", "stock_id", ascending=False).first().stock_id
    pdf = history(spark, small, stock)
    c, o, h, low, v = (pdf[k].astype(float) for k in ("close_price", "open_price", "high_price", "low_price", "volume"))
    r = c / c.shift(1) - 1
    x = pd.DataFrame({f"ret_{n}": c / c.shift(n) - 1 for n in (5, 10, 20, 60, 120)} | {f"gap_{n}": c / c.rolling(n).mean() - 1 for n in (20, 60, 120, 250)})
    x = x.assign(vol=r.rolling(20).std() / r.rolling(60).std(), bar=(h - low) / c, upper=(h - np.maximum(o, c)) / c, lower=(np.minimum(o, c) - low) / c, volume=v / v.rolling(60).mean())
    x, y = x.to_numpy(), (c.shift(-20) / c - 1).to_numpy()
    want = []
    for i in range(len(pdf)):
        rows = [k for k in range(max(0, i - 20 - 250), max(0, i - 20)) if np.isfinite(x[k]).all() and np.isfinite(y[k])]
        if i < 250 or len(rows) <= 14 or not np.isfinite(x[i]).all():
            want.append(np.nan)
            continue
        mean, scale = x[rows].mean(axis=0), x[rows].std(axis=0)
        w = recursive.lasso((x[rows] - mean) / scale, y[rows] - y[rows].mean(), 0.001)
        want.append(y[rows].mean() + (x[i] - mean) / scale @ w)
    got = QUERIES["w22_rolling_lasso"](spark, small).where(f"stock_id = '{stock}'").orderBy("date").toPandas().signal.to_numpy(float)
    assert np.isfinite(want).sum() > 10
    assert np.allclose(got, want, atol=2e-6, equal_nan=True)


def test_chunks_change_nothing(spark, small):
    """Histories cut into short chunks give the same ranks and predictions as whole ones."""
    from panelspark.operators import technical

    prices = adapters.daily_prices(spark, small).select("stock_id", "date", "close_price", "change_pct")
    for kind in ("weak", "strict", "mean"):
        one, cut = (technical.rolling_percentile(prices, "change_pct", 40, kind, chunk=c).orderBy("stock_id", "date").collect() for c in (None, 7))
        assert one == cut
    columns = ["ret_5", "ret_10", "gap_20", "bar_range"]
    features = technical.technical_features(adapters.daily_prices(spark, small))
    for lag, refit in ((True, 1), (False, 3)):
        one, cut = (recursive.rolling_lasso_signal(features, columns, window=60, ahead=5, refit=refit, lag_target=lag, chunk=c).orderBy("stock_id", "date").toPandas() for c in (None, 45))
        assert one.signal.notna().sum() > 100
        assert np.allclose(one.signal, cut.signal, atol=1e-8, equal_nan=True)


def test_chunks_are_whole_however_batches_cut_them():
    """Also where a batch lies within one chunk, as a partition's last rows do, or is empty."""
    keys = [("1", 0)] * 5 + [("1", 1)] * 3 + [("2", 0)] + [("2", 1)] * 4 + [("3", 1)] * 2
    rows = pd.DataFrame(keys, columns=["stock_id", "_chunk"]).assign(_row=range(len(keys)))
    want = [part for _, part in rows.groupby(["stock_id", "_chunk"], sort=False)]
    for size in range(1, len(rows) + 1):
        batches = [rows.iloc[i : i + size].reset_index(drop=True) for i in range(0, len(rows), size)]
        got = list(recursive.whole_chunks(iter([rows.iloc[:0], *batches])))
        assert [g.to_numpy().tolist() for g in got] == [w.to_numpy().tolist() for w in want], size


def test_ranks_of_a_long_window_against_counting():
    from panelspark.operators.technical import window_ranks

    rng = np.random.default_rng(2)
    values = [None if rng.random() < 0.1 else float(v) for v in rng.integers(0, 400, size=4000)]
    below, upto, size = window_ranks(values, 1250)
    for i in [*range(0, 4000, 61), 1249, 1250, 3999]:
        window = [v for v in values[max(0, i - 1249) : i + 1] if v is not None]
        assert size[i] == len(window)
        if values[i] is not None:
            assert (below[i], upto[i]) == (sum(v < values[i] for v in window), sum(v <= values[i] for v in window))


def test_many_fits_at_once_are_the_plain_fits():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, 5)), rng.normal(size=300) * 0.1
    x[:, 3] = 2.5  # constant
    x[:, 4] = x[:, 0] * 3 + 100
    y += 0.3 * x[:, 0]
    use = rng.random(300) < 0.9
    starts, ends = np.arange(0, 200), np.arange(80, 280)
    n, mean, middle, scale, gram, target = recursive.window_moments(x, y, use, starts, ends)
    w = recursive.lasso_many(gram, target, 0.01)
    for k in range(0, 200, 13):
        rows = np.flatnonzero(use[starts[k] : ends[k]]) + starts[k]
        m, s = x[rows].mean(axis=0), x[rows].std(axis=0)
        s[s < 1e-9] = 1.0
        want = recursive.lasso((x[rows] - m) / s, y[rows] - y[rows].mean(), 0.01)
        assert n[k] == len(rows) and np.allclose(w[k], want, atol=1e-8)
