"""The screen as of every day against the screen run on the bars up to that day."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import rolling as r
from tapeloom.operators import daily_screen as ds
from tapeloom.operators import screen as sc
from tapeloom.plans.screens import PARAMS
from tapeloom.sources.bars import daily
from tapeloom.sources.store import stored

C = F.col
SMALL = sc.ScreenParams(min_history=120, min_dollar_volume=100.0, min_price=2.0, max_stale_days=4, min_weeks=60)


@pytest.fixture(scope="module")
def market(spark):
    """Tickers with trends, gaps, a late start, an early end and missing days."""
    rng = np.random.default_rng(5)
    rows = []
    for k, n in enumerate((420, 420, 300, 420, 150)):
        close, days = 50.0, 0
        for i in range(n):
            days += 1 if rng.random() < 0.8 else int(rng.integers(2, 8))
            close *= float(np.exp(0.003 + rng.normal(0, 0.012)))
            low = close * (1 - rng.random() * 0.02)
            day = dt.date(2018, 1, 1) + dt.timedelta(days=days + (40 * k if k == 2 else 0))
            rows.append((f"T{k}", day, i, close * (1 + rng.normal(0, 0.004)), close * 1.01, low, close, float(rng.integers(1, 9))))
    schema = "ticker string, dt date, i bigint, open double, high double, low double, close double, volume double"
    return spark.createDataFrame(rows, schema).cache()


def test_same_as_scanning_each_day_again(market):
    per_day = {r.dt: tuple(r[g] for g in ds.GATES) for r in ds.funnel_per_day(ds.gates_as_of(market, SMALL)).collect()}
    days = sorted(per_day)
    assert len(days) == market.select("dt").distinct().count()
    for day in [*days[::97], days[-1]]:
        row = sc.funnel(sc.gates(market.filter(C("dt") <= day), SMALL)).first()
        assert per_day[day] == tuple(row[g] for g in ds.GATES), day


def test_last_day_is_the_screens_funnel(spark):
    bars = stored(daily(spark, "/root/testdata/sf0.001"))
    last = ds.funnel_per_day(ds.gates_as_of(bars, PARAMS)).orderBy(F.desc("dt")).first()
    funnel = sc.funnel(sc.gates(bars, PARAMS)).first()
    assert tuple(last[g] for g in ds.GATES) == tuple(funnel[g] for g in ds.GATES) and funnel["liquid"] > 0


def test_weekly_order_of_every_day(make_bars):
    closes = [20 + 0.2 * k + (3 * np.sin(k / 40)) for k in range(1500)]
    bars = make_bars({"A": [(c - 0.1, c + 1, c - 1, c, 1.0) for c in closes]})
    found = {r.i: r.ordered for r in ds.weekly_order_as_of(bars, min_weeks=205).select("i", "ordered").collect()}
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(1500)]
    week = [(d + dt.timedelta(days=(4 - d.weekday()) % 7)) for d in days]  # weekends belong to the next Friday

    def order(i):
        ended = [closes[k] for k in range(i) if week[k] != week[k + 1] and week[k] != week[i]] + [closes[i]]
        if len(ended) < 205:
            return False
        m = {n: (np.mean(ended[-n:]), np.mean(ended[-n - 4 : -4])) for n in (20, 50, 200)}
        return bool(ended[-1] > m[20][0] > m[50][0] > m[200][0] and all(a > b for a, b in m.values()))

    assert any(found.values()) and not all(list(found.values())[-100:])
    for i in range(1430, 1500):
        assert found[i] == order(i), i


def test_distribution_and_empty_days(spark):
    rows = [(dt.date(2020, 1, k + 1), n) for k, n in enumerate([0, 0, 4, 8])]
    d = ds.distribution(spark.createDataFrame(rows, "dt date, dip bigint")).first()
    assert (d.days, d.median, d.mean, d.none_share) == (4, 2.0, 3.0, 0.5)


def test_rolling_median(spark):
    rng = np.random.default_rng(2)
    values = [float(v) if rng.random() > 0.2 else None for v in rng.integers(0, 9, 80)]
    df = spark.createDataFrame([("A", k, v) for k, v in enumerate(values)], "ticker string, i bigint, x double")
    got = df.select("i", r.rolling_median(C("x"), 6, least=1).alias("some"), r.rolling_median(C("x"), 6).alias("all")).collect()
    for row in got:
        known = [v for v in values[max(0, row.i - 5) : row.i + 1] if v is not None]
        assert row.some == (float(np.median(known)) if known else None)
        assert row.all == (float(np.median(known)) if len(known) == 6 else None)
