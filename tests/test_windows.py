import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.recursive import Smooth, smooth, span
from tapeloom.operators import indicators as ind


def random_bars(n, seed):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    op = close * (1 + rng.normal(0, 0.004, n))
    high = np.maximum(op, close) * (1 + rng.random(n) * 0.01)
    low = np.minimum(op, close) * (1 - rng.random(n) * 0.01)
    return [tuple(x) for x in zip(op, high, low, close, rng.integers(50, 500, n))]


def frame(df):
    return df.orderBy("ticker", "i").toPandas()


def test_smoothing_matches_the_recurrence_over_many_blocks(make_bars):
    bars = make_bars({"A": random_bars(1700, 1), "B": random_bars(30, 2)})
    x = F.when(F.col("i") >= 3, F.col("close"))
    out = frame(smooth(bars, {"slow": span(F.col("close"), 200, 200), "fast": Smooth(F.col("close"), 0.5), "late": Smooth(x, 1 / 14, 14)}))
    for _, g in out.groupby("ticker"):
        c = g.close
        pd.testing.assert_series_equal(g.slow, c.ewm(span=200, adjust=False, min_periods=200).mean(), check_names=False, rtol=1e-12)
        pd.testing.assert_series_equal(g.fast, c.ewm(alpha=0.5, adjust=False).mean(), check_names=False, rtol=1e-12)
        late = c.where(g.i >= 3).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        pd.testing.assert_series_equal(g.late, late, check_names=False, rtol=1e-12)


def test_rsi_without_losses(make_bars):
    up = [(10 + k, 11 + k, 9 + k, 10 + k, 100) for k in range(40)]
    bars = make_bars({"A": up})
    capped = frame(ind.with_rsi_wilder(bars, {"r": 14}, cap_without_loss=True))
    assert capped.r.iloc[-1] == 100.0
    assert capped.r.iloc[:14].isna().all()
    assert frame(ind.with_rsi_wilder(bars, {"r": 14}, cap_without_loss=False)).r.isna().all()
    assert frame(ind.rsi_simple(bars)).rsi.isna().all()


def test_adx_against_pandas(make_bars):
    out = frame(ind.adx(make_bars({"A": random_bars(700, 5)})))
    up, down = out.high.diff(), -out.low.diff()
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    w = lambda v: pd.Series(v).ewm(alpha=1 / 14, adjust=False).mean()
    tr = pd.concat([out.high - out.low, (out.high - out.close.shift()).abs(), (out.low - out.close.shift()).abs()], axis=1).max(axis=1)
    pdi, mdi = 100 * w(plus) / w(tr), 100 * w(minus) / w(tr)
    dx = (100 * (pdi - mdi).abs() / (pdi + mdi)).where(pdi + mdi != 0, 0.0).fillna(0.0)
    np.testing.assert_allclose(out.adx, w(dx), rtol=1e-9)


@pytest.mark.parametrize("alpha", [0.05, 0.5, 0.6, 0.9, 0.999, 1.0])
def test_smoothing_with_gaps_as_pandas(spark, alpha):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.15 else float(rng.uniform(-5, 50)) for _ in range(1300)]
    values = [None, None, *values, *[None] * 700, 4.0, None, 6.0]
    bars = spark.createDataFrame([("A", k, v) for k, v in enumerate(values)], "ticker string, i bigint, close double")
    got = smooth(bars, {"e": Smooth(F.col("close"), alpha), "late": Smooth(F.col("close"), alpha, 5)}).orderBy("i").toPandas()
    want = pd.Series(values, dtype=float).ewm(alpha=alpha, adjust=False).mean()
    late = pd.Series(values, dtype=float).ewm(alpha=alpha, adjust=False, min_periods=5).mean()
    pd.testing.assert_series_equal(got["e"], want, check_names=False, rtol=1e-9)
    pd.testing.assert_series_equal(got["late"], late, check_names=False, rtol=1e-9)
