import numpy as np
import pytest

from tapeloom.operators import patterns as pt


def chart(anchors, step=8, spread=0.4):
    xs = np.interp(np.arange((len(anchors) - 1) * step + 1), np.arange(len(anchors)) * step, anchors)
    return [(900 * k, x, x + spread, x - spread, x) for k, x in enumerate(xs)]


def frame(spark, charts):
    rows = [(t, k, *map(float, b[1:]), 1.0, int(b[0])) for t, bars in charts.items() for k, b in enumerate(bars)]
    return spark.createDataFrame(rows, "ticker string, i bigint, open double, high double, low double, close double, volume double, time bigint")


@pytest.mark.parametrize(
    "anchors,kinds",
    [
        ([100, 112, 92, 100, 92.3, 104], ["neckline"]),
        ([110, 94, 102, 88, 102, 94.4, 106], ["neckline"]),
        ([95, 120, 80, 114, 86, 109, 91, 105, 95, 100], ["tri_upper", "tri_lower"]),
        ([110, 100, 108, 98, 106, 96, 104, 94, 99], ["flag_upper", "flag_lower"]),
        ([100, 101, 102], []),
    ],
)
def test_first_pattern(spark, anchors, kinds):
    found = pt.detect(frame(spark, {"X": chart(anchors)})).first()
    got = [x.type for x in found.lines]
    if kinds == ["flag_upper", "flag_lower"]:
        assert got in (kinds, ["tri_upper", "tri_lower"])
    else:
        assert got == kinds


def test_inverse_head_and_shoulders_goes_before_a_double_bottom(spark):
    found = pt.detect(frame(spark, {"X": chart([110, 94, 102, 88, 102, 94.4, 106])})).first()
    assert found.lines[0].label == pt.LABELS["inverse"]
    assert found.lines[0].points[0].price == pytest.approx(102.4)


def test_break_marker_and_trendline(spark):
    bars = chart([90, 120, 100, 112, 95, 118])
    chart_row = pt.with_descending_pair(pt.charts(frame(spark, {"X": bars})))
    row = chart_row.select(pt.trendline().alias("t"), pt.break_marker().alias("m")).first()
    assert row.t[0].points[0].time == 900 * 8 and row.t[0].points[0].price == pytest.approx(120.4)
    assert row.m.time == bars[-1][0]


def test_regular_sessions(spark):
    import datetime as dt
    from zoneinfo import ZoneInfo

    ny = ZoneInfo("America/New_York")
    rows = []
    for day in range(8, 14):
        for h, m in ((8, 0), (9, 30), (16, 15)):
            at = dt.datetime(2026, 7, day, h, m, tzinfo=ny)
            rows.append(("X", int(at.timestamp() * 1000), 1.0, 2.0, 0.5, 1.5, None))
    raw = spark.createDataFrame(rows, "ticker string, t bigint, o double, h double, l double, c double, v double")
    regular = pt.format_intraday(raw).collect()
    assert len(regular) == 5 and {x.time % 86400 for x in regular} == {9 * 3600 + 1800} and regular[0].volume == 0
    assert pt.format_intraday(raw, extended=True, sessions=9).count() == 18
