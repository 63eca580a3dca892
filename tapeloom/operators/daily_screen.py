"""The screen's gates as of every session: what a scan on each past day would have found.

Everything a gate needs is a window over the ticker's own bars up to the day, so all days of a ticker
are judged in one pass after one shuffle. The week that runs on the day ends with the day's close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import rolling as r
from tapeloom.functions.recursive import smooth, span
from tapeloom.operators.screen import ScreenParams, week_ending
from tapeloom.session import safe_unions

C = F.col
GATES = ("universe", "liquid", "po", "dip")


def _weeks(n: int, skip: int) -> tuple[Column, Column]:
    """Sum and count of the closes of ``n`` weeks, the last of them ``skip`` weeks before the running one."""
    frame = Window.partitionBy("ticker").orderBy("w_").rangeBetween(-(n - 1) - skip, -skip)
    return F.sum("ended_").over(frame), F.count("ended_").over(frame)


def weekly_order_as_of(bars: DataFrame, min_weeks: int = 210) -> DataFrame:
    """Adds ``ordered``: whether close > 20 > 50 > 200 week averages, all above those four weeks ago, on each bar's day."""
    week = Window.partitionBy("ticker").orderBy("week_")
    df = bars.withColumn("week_", week_ending(C("dt")))
    df = df.withColumns(
        {
            "w_": F.dense_rank().over(week).cast("bigint"),
            "ended_": F.when(~F.coalesce(F.lead("week_").over(r.by_ticker()) == C("week_"), F.lit(False)), C("close")),
        }
    )
    sizes = (20, 50, 200)
    parts = {}
    for n in sizes:
        # Earlier weeks from their last bars; the running week is the bar's own close.
        parts[f"s{n}_"], parts[f"c{n}_"] = _weeks(n - 1, 1)
        parts[f"b{n}_"], parts[f"d{n}_"] = _weeks(n, 4)
    df = df.withColumns(parts)
    now = {f"m{n}_": F.when(C(f"c{n}_") == n - 1, (C(f"s{n}_") + C("close")) / n) for n in sizes}
    before = {f"p{n}_": F.when(C(f"d{n}_") == n, C(f"b{n}_") / n) for n in sizes}
    df = df.withColumns(now | before)
    ok = (C("close") > C("m20_")) & (C("m20_") > C("m50_")) & (C("m50_") > C("m200_")) & (C("w_") >= min_weeks)
    for n in sizes:
        ok = ok & (C(f"m{n}_") > C(f"p{n}_"))
    return df.withColumn("ordered", F.coalesce(ok, F.lit(False))).drop("week_", "w_", "ended_", *parts, *now, *before)


def gates_as_of(bars: DataFrame, p: ScreenParams = ScreenParams(), rising: bool = False, benchmark: str | None = None) -> DataFrame:
    """Every bar with the cumulative gates ``universe``, ``liquid``, ``po`` and ``dip`` as of its day, and ``until``.

    ``until`` is the last day on which the bar is its ticker's newest and no staler than allowed. With
    ``rising`` the day must also close above its open, with ``benchmark`` its 126-bar return must be
    above that of this ticker on the same day.
    """
    df = smooth(weekly_order_as_of(bars, p.min_weeks), {"ema20": span(C("close"), 20)})
    touched = F.coalesce(C("low") <= C("ema20") * p.touch_band, F.lit(False))
    df = df.withColumns(
        {
            "median_": r.rolling_median(C("close") * C("volume"), p.dollar_window, least=1),
            "touched_": F.max(touched).over(r.last_rows(p.touch_rows)),
            "ret_": r.change(C("close"), 126),
            "next_": F.lead("dt").over(r.by_ticker()),
        }
    )
    strong = F.lit(True)
    if benchmark is not None:
        market = df.filter(C("ticker") == benchmark).select("dt", C("ret_").alias("base_"))
        df = df.join(market, "dt", "left")
        strong = C("ret_") > C("base_")
    if rising:
        strong = strong & (C("close") > C("open"))
    gates = (
        C("i") + 1 >= p.min_history,
        (C("median_") >= p.min_dollar_volume) & (C("close") >= p.min_price),
        C("ordered"),
        C("touched_") & (C("close") > C("ema20")) & strong,
    )
    until = F.least(F.date_add("dt", p.max_stale_days), F.date_sub("next_", 1))
    out, passed = df, F.lit(True)
    for name, gate in zip(GATES, gates):
        passed = passed & F.coalesce(gate, F.lit(False))
        out = out.withColumn(name, passed)
    return out.select("ticker", "dt", "i", until.alias("until"), *GATES)


def funnel_per_day(gated: DataFrame) -> DataFrame:
    """dt and how many tickers pass each gate on that day, for every day any ticker has a bar.

    A bar counts from its day to ``until``: it adds one on its day and takes it back on the day after,
    so nothing is multiplied by days, and sums run over one row per day.
    """
    safe_unions(gated.sparkSession)
    change = F.array(F.struct(C("dt"), F.lit(1).alias("sign")), F.struct(F.date_add("until", 1).alias("dt"), F.lit(-1).alias("sign")))
    moved = gated.filter(C(GATES[0])).select(*GATES, F.inline(change))
    deltas = moved.groupBy("dt").agg(*[F.sum(F.when(C(g), C("sign")).otherwise(0)).alias(g) for g in GATES])
    days = gated.groupBy("dt").agg(*[F.lit(0).cast("bigint").alias(g) for g in GATES]).withColumn("open_", F.lit(True))
    both = days.unionByName(deltas.withColumn("open_", F.lit(None).cast("boolean")))
    each = both.groupBy("dt").agg(*[F.sum(g).alias(g) for g in GATES], F.max("open_").alias("open_"))
    # One row per calendar day.
    so_far = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    summed = each.select("dt", "open_", *[F.sum(g).over(so_far).alias(g) for g in GATES])
    return summed.filter("open_").drop("open_")


def distribution(per_day: DataFrame, column: str = "dip") -> DataFrame:
    """Days, median, tenth and ninetieth percentile, mean, and the share of days without any. One row."""
    return per_day.agg(
        F.count(F.lit(1)).alias("days"),
        F.percentile(column, F.lit(0.5)).alias("median"),
        F.percentile(column, F.lit(0.1)).alias("p10"),
        F.percentile(column, F.lit(0.9)).alias("p90"),
        F.avg(column).alias("mean"),
        F.avg(F.when(C(column) == 0, 1.0).otherwise(0.0)).alias("none_share"),
    )
