"""Labels against a bar-by-bar walk over small random series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import barriers as ba

C = F.col


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(11)
    rows = []
    for ticker, n in (("A", 700), ("B", 90)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        op = np.r_[close[0], close[:-1]] * (1 + rng.normal(0, 0.012, n))
        high = np.maximum(op, close) * (1 + rng.random(n) * 0.012)
        low = np.minimum(op, close) * (1 - rng.random(n) * 0.012)
        avg = close * (1 + rng.normal(0, 0.01, n))
        for i in range(n):
            day = dt.date(2020, 1, 1) + dt.timedelta(days=i + (10 if i > 50 else 0))
            rows.append((ticker, day, i, *map(float, (op[i], high[i], low[i], close[i], avg[i], close[i] * 0.02))))
    schema = "ticker string, dt date, i bigint, open double, high double, low double, close double, avg double, atr double"
    df = spark.createDataFrame(rows, schema).withColumns({"ema5": C("avg"), "ema20": C("avg"), "volume": F.lit(1.0)})
    data = {}
    for t, d, i, *v in rows:
        data.setdefault(t, []).append((d, *v))
    return df, data


def close_to(got, want):
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert g[:-1] == w[:-1], (k, g, w)
        assert g[-1] == pytest.approx(w[-1], abs=1e-9), (k, g, w)


def test_brackets(market):
    df, data = market
    feats = df.withColumns({c: F.lit(0.5) for c in ba.RANK_FEATURES if c != "ddv"}).withColumn("ddv", F.lit(60e6))
    signals = feats.filter(C("i") % 3 == 0).select("ticker", "i")
    brackets = {0: ba.Bracket(2.0, 2.0), 1: ba.Bracket(1.0, 0.5), 2: ba.Bracket(30.0, 1.0)}
    got = {
        (r.bracket, r.ticker, r.i): (r.status, r.bars, r.r)
        for r in ba.label_brackets(feats, signals, brackets).collect()
    }
    want = {}
    for b, (s, rr) in {0: (2.0, 2.0), 1: (1.0, 0.5)}.items():  # the third risks too much
        for t, bars in data.items():
            for i in range(0, len(bars) - 1, 3):
                if (bars[i + 1][0] - bars[i][0]).days > 4:
                    continue
                entry, atr = bars[i + 1][1], bars[i][6]
                sl = entry - s * atr
                tp = entry + rr * (entry - sl)
                px, status, j = None, "unresolved", i + 1
                for j in range(i + 1, min(i + 505, len(bars))):
                    _, o, h, low, c, _, _ = bars[j]
                    if j > i + 1 and o <= sl:
                        px, status = o, "gap_stop"
                    elif j > i + 1 and o >= tp:
                        px, status = tp + 0.5 * (o - tp), "gap_target"
                    elif low <= sl:
                        px, status = sl, "stop"
                    elif h >= tp * 1.001:
                        px, status = tp, "target"
                    if px is not None:
                        break
                px = bars[j][4] if px is None else px
                cost = (entry * 22 + px * ba.EXIT_BPS[status]) / 1e4
                want[(b, t, i)] = (status, j - i, (px - entry - cost) / (entry - sl))
    close_to(got, want)


def sided(df):
    side = F.when(C("i") % 2 == 0, "long").otherwise("short")
    away = F.when(C("i") % 2 == 0, -1.0).otherwise(1.0)
    return df.withColumns({"side": side, "away": away}).filter(C("i") % 3 == 0).select(
        "ticker", "i", "side", (C("close") * (1 + C("away") * 0.03)).alias("stop"),
        (C("close") * (1 - C("away") * 0.05)).alias("target"),
    )


def walk_sided(data, hold, kind):
    out = {}
    for t, bars in data.items():
        for i in range(0, len(bars) - 1, 3):
            lng = i % 2 == 0
            sgn = 1 if lng else -1
            entry, c0 = bars[i + 1][1], bars[i][4]
            stop, target = c0 * (1 - sgn * 0.03), c0 * (1 + sgn * 0.05)
            risk = sgn * (entry - stop)
            if risk <= 0 or (kind == "timed" and sgn * (target - entry) <= 0) or (kind == "trail" and risk / entry > 0.15):
                continue
            px, status, armed = None, "time", False
            for j in range(i + 1, min(i + 1 + hold, len(bars))):
                _, o, h, low, c, avg, _ = bars[j]
                near, far = (low, h) if lng else (h, low)
                if armed:
                    px, status = o, "ema_trail"
                elif sgn * (o - stop) <= 0:
                    px, status = o, "gap_stop"
                elif sgn * (near - stop) <= 0:
                    px, status = stop, "stop"
                elif kind == "timed" and sgn * (o - target) >= 0:
                    px, status = o, "gap_target"
                elif kind == "timed" and sgn * (far - target) >= 0:
                    px, status = target, "target"
                elif kind == "trail":
                    armed = sgn * (c - avg) < 0
                elif kind == "reversion" and sgn * (c - avg) > 0 and j + 1 < len(bars):
                    j += 1
                    px, status = bars[j][1], "ema5_recovery"
                if px is not None:
                    break
            px = bars[j][4] if px is None else px
            r = sgn * (px - entry) / risk - 2 * 10 / 10_000 * entry / risk
            out[(t, i)] = (status, j - i, r)
    return out


@pytest.mark.parametrize("kind", ["timed", "reversion", "trail"])
def test_sided_exits(market, kind):
    df, data = market
    s = sided(df)
    if kind == "timed":
        rows = ba.label_timed(s, df, 12)
    elif kind == "reversion":
        rows = ba.label_reversion(s, df, 12)
    else:
        rows = ba.label_trail(s, df, "ema20", 12)
    close_to({(r.ticker, r.i): (r.status, r.held, r.r) for r in rows.collect()}, walk_sided(data, 12, kind))


def staged(df):
    return df.filter(C("i") >= 60).select(
        "ticker", "i", (C("close") * 0.96).alias("stop"), (C("close") * 1.03).alias("tp1"),
        (C("close") * 1.07).alias("target"), (C("close") * 1.04).alias("resistance"),
    )


def test_two_stage_and_structural_exits(market):
    df, data = market
    two, structural = {}, {}
    for t, bars in data.items():
        for i in range(60, len(bars) - 1):
            entry, c0 = bars[i + 1][1], bars[i][4]
            stop, tp1, target, wall = c0 * 0.96, c0 * 1.03, c0 * 1.07, c0 * 1.04
            risk = entry - stop
            if risk <= 0:
                continue
            cost = 2 * 10 / 10_000 * entry / risk
            if risk / entry <= 0.25:
                half, floor, px, status = False, stop, None, "time"
                for j in range(i + 1, min(i + 31, len(bars))):
                    _, o, h, low, c, avg, _ = bars[j]
                    if o <= floor:
                        px, status = o, "gap_stop"
                    elif low <= floor:
                        px, status = floor, "be" if half else "stop"
                    elif o >= target or h >= target:
                        px, status = max(o, target), "target"
                    if px is not None:
                        break
                    if not half and (o >= tp1 or h >= tp1):
                        half, floor = True, entry
                px = bars[j][4] if px is None else px
                r = (px - entry) / risk
                r = 0.5 * (tp1 - entry) / risk + 0.5 * r if half else r
                two[(t, i)] = (status, r - cost)
            rr = (wall - entry) / risk
            if risk / entry <= 0.15 and rr >= 0.5:
                hit, floor, px, status, armed = False, stop, None, "time", False
                for j in range(i + 1, min(i + 31, len(bars))):
                    _, o, h, low, c, avg, _ = bars[j]
                    if armed:
                        px, status = o, "ema20_runner"
                    elif o <= floor:
                        px, status = o, "gap_stop"
                    elif low <= floor:
                        px, status = floor, "be" if hit else "stop"
                    if px is not None:
                        break
                    if not hit and (o >= wall or h >= wall):
                        hit, floor = True, entry
                    armed = hit and c < avg
                px = bars[j][4] if px is None else px
                r = (px - entry) / risk
                structural[(t, i)] = (status, hit, (2 / 3 * rr + r / 3 if hit else r) - cost)
    got = {(x.ticker, x.i): (x.status, x.r) for x in ba.label_two_stage(staged(df), df).collect()}
    close_to(got, two)
    got = {(x.ticker, x.i): (x.status, x.hit_target, x.r) for x in ba.label_structural(staged(df), df).collect()}
    close_to(got, structural)


def test_non_overlap(spark):
    rows = [("A", 1, 3), ("A", 2, 1), ("A", 4, 1), ("A", 5, 9), ("A", 15, 1), ("B", 2, 1), ("B", 4, 2)]
    df = spark.createDataFrame(rows, "ticker string, i bigint, held bigint")
    kept = {(x.ticker, x.i) for x in ba.non_overlap(df, ["ticker"]).collect()}
    assert kept == {("A", 1), ("A", 5), ("A", 15), ("B", 2), ("B", 4)}
