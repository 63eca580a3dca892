"""Market regime by date, and alignment of keyed rows to a calendar.

Regimes and calendars have one row per date; the calendar bounds their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import safe_unions

C = F.col


def regime_any(features: DataFrame, indexes: tuple[str, ...]) -> DataFrame:
    """bull when any index closes above its long average, bear when none does.

    An index without a bar on a date keeps its last known flag.
    """
    up = features.filter(C("ticker").isin(*indexes)).select("dt", "ticker", (C("close") > C("ema200")).alias("up"))
    per_date = up.groupBy("dt").pivot("ticker", list(indexes)).agg(F.max("up"))
    so_far = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    held = [F.coalesce(F.last(C(f"`{t}`"), ignorenulls=True).over(so_far), F.lit(False)) for t in indexes]
    bull = held[0]
    for h in held[1:]:
        bull = bull | h
    return per_date.select("dt", bull.alias("bull")).withColumn("bear", ~C("bull"))


def regime_all(features: DataFrame, indexes: tuple[str, ...]) -> DataFrame:
    """Strict regime: every index present on the date is above a rising long average."""
    ok = F.coalesce((C("close") > C("ema200")) & (C("ema50") > C("ema200")), F.lit(False))
    return (
        features.filter(C("ticker").isin(*indexes))
        .groupBy("dt")
        .agg(F.bool_and(ok).alias("regime"))
    )


def with_regime(rows: DataFrame, regime: DataFrame, flags: tuple[str, ...] = ("regime",)) -> DataFrame:
    """Flags of the newest earlier regime date *that the ticker itself traded*; false before any."""
    so_far = Window.partitionBy("ticker").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(regime.select("dt", *flags), "dt", "left")
    return joined.withColumns(
        {f: F.coalesce(F.last(f, ignorenulls=True).over(so_far), F.lit(False)) for f in flags}
    )


def align_forward(rows: DataFrame, calendar: DataFrame, date: str) -> DataFrame:
    """Adds the first calendar day on or after ``date`` and its position; rows beyond the calendar have null.

    The distinct dates of the rows are looked up in the calendar, then joined back by equality.
    """
    safe_unions(rows.sparkSession)
    cal = calendar.select("day").distinct()
    numbered = cal.withColumn("pos", F.row_number().over(Window.orderBy("day")).cast("bigint") - 1)
    wanted = rows.select(C(date).alias("d")).distinct()
    points = wanted.select("d", F.lit(None).cast("date").alias("day"), F.lit(None).cast("bigint").alias("pos")).unionByName(
        numbered.select(C("day").alias("d"), "day", "pos")
    )
    # Latest first, so that the frame only grows.
    ahead = Window.orderBy(F.desc("d")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = points.select(
        "d",
        F.min("day").over(ahead).alias("cal_day"),
        F.min("pos").over(ahead).alias("cal_pos"),
    ).distinct()
    return rows.join(found, rows[date] == found.d, "left").drop("d")


def price_grid(bars: DataFrame, value: str = "close") -> DataFrame:
    """Dense ticker x calendar grid, forward filled; null before a ticker's first bar.

    Every bar is spread over the calendar positions up to the next bar of its ticker, so no
    cross join and no fill pass over an empty grid is needed.
    """
    days = bars.select("dt").distinct()
    numbered = days.withColumn("pos", F.row_number().over(Window.orderBy("dt")).cast("bigint") - 1)
    size = numbered.agg(F.max("pos") + 1).scalar()
    placed = bars.select("ticker", "dt", C(value).alias("value")).join(numbered, "dt")
    own = Window.partitionBy("ticker").orderBy("pos")
    placed = placed.withColumns(
        {"until": F.coalesce(F.lead("pos").over(own), size) - 1, "rank": F.row_number().over(own)}
    )
    filled = F.transform(F.sequence("pos", "until"), lambda p: F.struct(p.alias("pos"), C("value").alias("value")))
    ahead = F.when(
        (C("rank") == 1) & (C("pos") > 0),
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), C("pos") - 1),
            lambda p: F.struct(p.alias("pos"), F.lit(None).cast("double").alias("value")),
        ),
    )
    cells = placed.select("ticker", F.inline(F.concat(F.coalesce(ahead, F.slice(filled, 1, 0)), filled)))
    return cells.join(numbered, "pos").select("ticker", "dt", "value")
