"""Volume and price behaviour of the last sessions, judged in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import rolling as r
from tapeloom.functions.recursive import smooth, wilder
from tapeloom.operators.indicators import with_true_range

C = F.col


def volume_assessment(bars: DataFrame, bounced: DataFrame | None = None) -> DataFrame:
    """One row per ticker: ``volume`` is a struct, or null with under 60 bars or no volume.

    ``bounced(ticker, bounced)`` is what the dip check found; without it the bounce
    verdicts cannot occur.
    """
    week, span_rows = 5, 60
    df = smooth(with_true_range(bars), {"atr": wilder(C("tr"), 14)})
    df = df.withColumns({"vol50": r.sma(C("volume"), 50), "n": r.bars_count()})
    df = df.withColumns(
        {
            "range_low": F.min("close").over(r.last_rows(span_rows)),
            "range_high": F.max("close").over(r.last_rows(span_rows)),
            "vol_now": F.avg("volume").over(r.last_rows(week)),
            "vol_before": F.avg("volume").over(r.last_rows(week, skip=week)),
            "range_now": F.avg(C("high") - C("low")).over(r.last_rows(week)),
            "range_before": F.avg(C("high") - C("low")).over(r.last_rows(week, skip=week)),
            "week_close": r.prev(C("close"), week),
            "week_bars": F.collect_list(
                F.struct(
                    C("dt").cast("string").alias("date"),
                    F.try_divide(C("volume"), C("vol50")).alias("vol_ratio"),
                    (C("close") > C("open")).alias("up"),
                )
            ).over(r.last_rows(week)),
            "weeks_known": F.count_if(C("vol50") > 0).over(r.last_rows(week)),
        }
    )
    df = df.filter(C("i") == C("n") - 1)
    df = df.join(bounced, "ticker", "left") if bounced is not None else df.withColumn("bounced", F.lit(None))

    height = C("range_high") - C("range_low")
    zone = F.when(
        height > 0, F.greatest(F.least((C("close") - C("range_low")) / height, F.lit(1.0)), F.lit(0.0))
    ).otherwise(F.lit(0.5))
    df = df.withColumns(
        {
            "zone_pct": zone,
            "today": F.try_divide(C("volume"), C("vol50")),
            "week_vol": F.try_divide(C("vol_now"), C("vol_before")),
            "week_chg": F.try_divide(C("close"), C("week_close")) - 1,
        }
    )
    df = df.withColumn(
        "price_zone",
        F.when(C("zone_pct") >= 0.70, F.lit("high")).when(C("zone_pct") <= 0.30, F.lit("low")).otherwise(F.lit("mid")),
    )
    today, week_vol, chg, low_zone = C("today"), C("week_vol"), C("week_chg"), C("price_zone") == "low"
    body = F.abs(C("close") - C("open"))
    bounce = F.coalesce(C("bounced"), F.lit(False))
    pulling = F.coalesce(~C("bounced"), F.lit(False))
    verdict = (
        F.when(low_zone & (C("close") < C("open")) & (body >= C("atr")) & (today >= 2.0), F.lit("selling_climax"))
        .when(low_zone & (C("close") > C("open")) & (today >= 1.5), F.lit("accumulation"))
        .when((C("price_zone") == "high") & (week_vol >= 1.2) & (chg <= 0.01), F.lit("distribution"))
        .when((chg <= -0.02) & (week_vol >= 1.2), F.lit("selling_pressure"))
        .when(bounce & (today >= 1.2), F.lit("bounce_confirmed"))
        .when(bounce & (today < 0.8), F.lit("weak_bounce"))
        .when((chg < 0.0) & (week_vol <= 0.8), F.lit("healthy_pullback"))
        .when((week_vol <= 0.8) & (C("range_now") < C("range_before")), F.lit("quiet_setup"))
        .when(pulling & (today <= 0.8), F.lit("healthy_pullback"))
        .otherwise(F.lit("neutral"))
    )
    known = (
        (C("n") >= span_rows)
        & (C("vol50") > 0)
        & today.isNotNull()
        & week_vol.isNotNull()
        & chg.isNotNull()
        & (C("weeks_known") == week)
    )
    picked = F.struct(
        "price_zone",
        "zone_pct",
        today.alias("vol_ratio_today"),
        chg.alias("week_price_chg"),
        week_vol.alias("week_vol_ratio"),
        "week_bars",
        verdict.alias("verdict"),
        F.format_string("volume %.1fx today, %.1fx on the week, price %.1f%%", today, week_vol, chg * 100).alias(
            "comment"
        ),
    )
    return df.select("ticker", F.when(known, picked).alias("volume"))
