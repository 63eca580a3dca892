import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import picks as pk
from tapeloom.operators import screen as sc
from tapeloom.operators.volume import volume_assessment

C = F.col


def flat(close, volume=100.0):
    return (close - 0.2, close + 1, close - 1, close, volume)


def weekly(closes):
    first = dt.date(2015, 1, 2)
    return [(*flat(c), first + dt.timedelta(days=7 * k)) for k, c in enumerate(closes)]


def test_weekly_order(make_bars):
    rising = list(np.linspace(20, 220, 260))
    bars = make_bars({"UP": weekly(rising), "BROKEN": weekly(rising[:-1] + [1.0]), "SHORT": weekly(rising[:209])})
    got = {x.ticker: x.po_weeks for x in sc.weekly_order(bars).collect()}
    assert got["UP"] == 260 - 203 and got["BROKEN"] == 0 and got["SHORT"] == 0


@pytest.mark.parametrize("ago,found", [(1, True), (2, True), (4, False)])
def test_dip_touch(make_bars, ago, found):
    rows = [flat(100 + k) for k in range(80)]
    o, h, low, c, v = rows[-ago]
    rows[-ago] = (o, h, 50.0, c, v)
    rows = [(o, h, low if low == 50.0 else c - 0.1, c, v) for o, h, low, c, v in rows]
    got = sc.dip_check(make_bars({"A": rows})).collect()
    assert bool(got) == found
    if found:
        assert got[0].touch_days_ago == ago and got[0].bounced


def swings(anchors, step=10):
    xs = np.interp(np.arange((len(anchors) - 1) * step + 1), np.arange(len(anchors)) * step, anchors)
    return [(x, x + 0.4, x - 0.4, x, 100.0) for x in xs]


@pytest.mark.parametrize(
    "anchors,want",
    [
        ([10, 20, 14, 26, 18, 30], "up"),
        ([30, 20, 26, 14, 20, 10, 12, 8], "down"),
        ([10, 20, 12, 18, 14, 16], "neutral"),
        ([10, 11], "unknown"),
    ],
)
def test_dow_trend(make_bars, anchors, want):
    anchors = anchors if want != "up" else [10, 20, 14, 26, 18, 30, 28]
    bars = make_bars({"A": swings(anchors)})
    one = bars.select("ticker").distinct().join(sc.last_pivots(sc.pivots(bars, k=3)), "ticker", "left")
    assert one.select(sc.dow_trend().alias("t")).first().t == want


def test_volume_verdicts(make_bars, spark):
    def frame(edit):
        rows = [[100.0, 101.0, 99.0, 100.0, 100.0] for _ in range(70)]
        edit(rows)
        return rows

    def climax(r):
        for k, x in enumerate(r):
            x[:4] = [120 - k * 0.2, 121 - k * 0.2, 119 - k * 0.2, 120 - k * 0.2]
        r[-1] = [106.0, 106.5, 99.0, 100.0, 400.0]

    def accumulate(r):
        for k, x in enumerate(r):
            x[:4] = [120 - k * 0.2, 121 - k * 0.2, 119 - k * 0.2, 120 - k * 0.2]
        r[-1] = [105.0, 107.0, 104.9, 106.0, 200.0]

    def quiet(r):
        for x in r[-5:]:
            x[4] = 50.0
            x[1], x[2] = 100.2, 99.8

    got = volume_assessment(
        make_bars({"CLIMAX": frame(climax), "ACC": frame(accumulate), "QUIET": frame(quiet), "FLAT": frame(lambda r: None), "SHORT": frame(lambda r: None)[:59]})
    )
    v = {x.ticker: (x.volume.verdict if x.volume else None) for x in got.collect()}
    assert v == {"CLIMAX": "selling_climax", "ACC": "accumulation", "QUIET": "quiet_setup", "FLAT": "neutral", "SHORT": None}
    bounced = spark.createDataFrame([("FLAT", True)], "ticker string, bounced boolean")
    rows = frame(lambda r: None)
    rows[-1][4] = 130.0
    one = volume_assessment(make_bars({"FLAT": rows}), bounced).first()
    assert one.volume.verdict == "bounce_confirmed" and len(one.volume.week_bars) == 5


PICKS = "ticker string, adx double, state string, dow_trend string, rs126 double, volume struct<verdict:string,price_zone:string>, pos int"


@pytest.fixture(scope="module")
def four(spark):
    rows = [
        ("A", 30.0, "bounced", "up", 0.1, ("neutral", "mid"), 0),
        ("B", 40.0, "pulling", "neutral", 0.3, ("healthy_pullback", "high"), 1),
        ("C", 26.0, "pulling", "up", 0.2, None, 2),
        ("D", None, "bounced", "down", 0.9, ("distribution", "low"), 3),
    ]
    return spark.createDataFrame(rows, PICKS)


def test_filter_and_facets(four):
    names = lambda df: [x.ticker for x in df.orderBy("ticker").collect()]
    everything = {f: () for f in pk.FACETS}
    assert names(pk.filter_picks(four, None, everything)) == ["A", "B", "C", "D"]
    assert names(pk.filter_picks(four, 25.0, everything)) == ["A", "B", "C"]
    pulled = everything | {"verdict": ("healthy_pullback",), "price_zone": ("high",)}
    assert names(pk.filter_picks(four, 25.0, pulled)) == ["B", "C"]  # C has no volume and passes
    counts = {(x.facet, x.value): x.n for x in pk.facet_counts(four, 25.0, pulled).collect()}
    assert len(counts) == 17 and counts["state", "pulling"] == 2 and counts["verdict", "neutral"] == 0
    assert pk.checked_adx(14) == 25.0 and pk.checked_adx(35) == 35
    assert pk.checked_selection({"state": ["pulling", "?"]})["state"] == ("pulling",)


def test_sorting(four):
    names = lambda s: [x.ticker for x in pk.sort_picks(four, s, "pos").collect()]
    assert names(pk.checked_sorts([(None, -1), ("adx", 1), (None, 1)])) == ["D", "B", "C", "A"]
    assert names([("adx", 1)]) == ["C", "A", "B", "D"] and names([("adx", -1)]) == ["B", "A", "C", "D"]
    assert names([("verdict", -1), ("ticker", 1)]) == ["B", "A", "C", "D"]
