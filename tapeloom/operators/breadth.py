"""Breadth scores by market, sector and theme, and measures of their history.

A history has one row per date (and sector), so its size is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def percent(flagged: Column, total: Column) -> Column:
    return F.round(flagged * 100.0 / total, 1)


def signal(score: Column) -> Column:
    return F.when(score >= 50, F.lit("Bullish")).when(score >= 30, F.lit("Neutral")).otherwise(F.lit("Bearish"))


def overall(flags: DataFrame, *keys: str) -> DataFrame:
    """Share of flagged tickers; tickers too short to be flagged count in the total."""
    g = flags.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_screened"), F.count_if(C("stage2")).alias("stage2_count")
    )
    score = F.coalesce(percent(C("stage2_count"), C("total_screened")), F.lit(0.0))
    return g.withColumn("overall_score", score).withColumn("overall_signal", signal(C("overall_score")))


def sector_scores(flags: DataFrame, universe: DataFrame, display: dict[str, str] | None = None) -> DataFrame:
    """Share per displayed sector; the total counts all universe tickers, with bars or not.

    Sector names shown under one display name are summed.
    """
    named = universe.filter(F.coalesce(C("sector"), F.lit("")) != "")
    shown = C("sector")
    if display:
        names = F.create_map(*[F.lit(x) for pair in display.items() for x in pair])
        shown = F.coalesce(names[C("sector")], C("sector"))
    return (
        named.join(flags.select("ticker", "stage2"), "ticker", "left")
        .groupBy(shown.alias("sector"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("stage2", F.lit(False))).alias("bullish"))
        .withColumn("score", percent(C("bullish"), C("total")))
    )


def theme_scores(flags: DataFrame, themes: DataFrame) -> DataFrame:
    """Share per theme over the members that have bars; a theme without any is absent."""
    return (
        themes.join(flags.select("ticker", "stage2"), "ticker")
        .groupBy("theme")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(C("stage2")).alias("bullish"))
        .withColumn("score", percent(C("bullish"), C("total")))
    )


def _packed(scores: DataFrame, key: str) -> Column:
    """Scores as one map; there are a handful of sectors and themes."""
    return scores.agg(F.map_from_entries(F.collect_list(F.struct(key, "score")))).scalar()


def health_row(flags: DataFrame, universe: DataFrame, themes: DataFrame, today: str, display=None) -> DataFrame:
    """The day's row: overall score and signal, and maps of sector and theme scores."""
    return overall(flags).withColumns(
        {
            "sector_scores": _packed(sector_scores(flags, universe, display), "sector"),
            "theme_scores": _packed(theme_scores(flags, themes), "theme"),
            "date": F.lit(today).cast("date"),
        }
    )


def ticker_themes(themes: DataFrame) -> DataFrame:
    return themes.groupBy("ticker").agg(F.sort_array(F.collect_list("theme")).alias("themes"))


def _from_newest(history: DataFrame) -> DataFrame:
    return history.withColumns(
        {
            "back": F.row_number().over(Window.orderBy(F.desc("dt"))),
            "n": F.count(F.lit(1)).over(Window.partitionBy()),
        }
    )


def health_trend(history: DataFrame) -> DataFrame:
    """Newest score, its change over five rows, and the means of the newest five and of those before."""
    h = _from_newest(history)
    score, back, n = C("score"), C("back"), C("n")
    earlier = (back > 5) & ((n < 10) | (back <= 10))
    return h.agg(
        F.max("dt").alias("dt"),
        F.max(F.when(back == 1, score)).alias("score"),
        F.round(F.max(F.when(back == 1, score)) - F.max(F.when(back == 6, score)), 1).alias("change_5d"),
        F.round(F.avg(F.when(back <= 5, score)), 1).alias("recent5_avg"),
        F.round(F.avg(F.when(earlier, score)), 1).alias("prev5_avg"),
    )


def previous_sectors(sector_history: DataFrame) -> DataFrame:
    """Sector scores of the second newest date."""
    dates = sector_history.select("dt").distinct().orderBy(F.desc("dt")).limit(2)
    before = dates.agg(F.min("dt").alias("dt"), F.count(F.lit(1)).alias("k")).filter(C("k") == 2).select("dt")
    return sector_history.join(before, "dt", "left_semi")


def sector_ma(sector_history: DataFrame, rows: int = 20) -> DataFrame:
    """Mean score and points over the newest dates of each sector that the newest date has; the mean needs two values."""
    dates = sector_history.select("dt").distinct().orderBy(F.desc("dt")).limit(rows)
    listed = sector_history.filter(C("dt") == sector_history.agg(F.max("dt")).scalar()).select("sector").distinct()
    kept = sector_history.join(dates, "dt", "left_semi").join(listed, "sector", "left_semi").filter(C("score").isNotNull())
    points = F.sort_array(F.collect_list(F.struct("dt", "score")))
    return kept.groupBy("sector").agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count(F.lit(1)) >= 2, F.round(F.avg("score"), 1)).alias("ma"),
        points.alias("points"),
    )


def last_days(history: DataFrame, today: Column, days: int) -> DataFrame:
    """Rows of the last calendar days, or all rows when that leaves none."""
    inside = C("dt") >= F.date_sub(today, days)
    found = history.agg(F.count_if(inside)).scalar()
    return history.filter(inside | (found == 0))


def weekly_scores(history: DataFrame, window: int = 10) -> DataFrame:
    """Mean score per Monday-based week, and its moving mean over ``window`` weeks."""
    weekly = history.groupBy(F.date_trunc("week", C("dt")).cast("date").alias("week")).agg(
        F.round(F.avg("score"), 1).alias("score")
    )
    frame = Window.orderBy("week").rowsBetween(-(window - 1), 0)
    full = F.count("score").over(frame) >= window
    return weekly.withColumn("ma", F.when(full, F.round(F.avg("score").over(frame), 1)))


def tiles(bars: DataFrame, points: int = 30) -> DataFrame:
    """Per ticker: price, change on the previous row, since the first row, in the year, last closes.

    A single row has no change; the newest closes are kept for a sparkline.
    """
    from tapeloom.operators.screen import with_tail

    close = C("close")
    t = with_tail(bars)
    year = F.year(F.max("dt").over(Window.partitionBy("ticker")))
    t = t.withColumn("this_year", F.year("dt") == year)
    g = t.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("close", "i").alias("price"),
        F.max(F.when(C("back") == 2, close)).alias("before"),
        F.min_by("close", "i").alias("first"),
        F.min_by(F.when(C("this_year"), close), F.when(C("this_year"), C("i"))).alias("year_first"),
        F.sort_array(
            F.collect_list(F.when(C("back") <= points, F.struct("i", "close")))
        ).alias("tail"),
    )
    before = F.coalesce("before", "price")
    return g.select(
        "ticker",
        "n",
        "price",
        ((C("price") / before - 1) * 100).alias("change_1d"),
        ((C("price") / C("first") - 1) * 100).alias("change_all"),
        ((C("price") - C("year_first")) / C("year_first") * 100).alias("change_ytd"),
        F.transform("tail", lambda p: p["close"]).alias("history"),
    )


def vol_tile(values: DataFrame) -> DataFrame:
    """Fear gauge per series (ticker, i, value): change on one and five rows back, first row if short."""
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    t = values.withColumn("n", n).withColumn("back", C("n") - C("i"))
    g = t.groupBy("ticker").agg(
        F.max_by("value", "i").alias("current"),
        F.max(F.when(C("back") == 2, C("value"))).alias("prev1"),
        F.max(F.when(C("back") == 6, C("value"))).alias("prev5"),
        F.min_by("value", "i").alias("first"),
    )
    now = C("current")
    return g.select(
        "ticker",
        "current",
        F.round(now - F.coalesce("prev1", "current"), 2).alias("change_1d"),
        F.round(now - F.coalesce("prev5", "first"), 2).alias("change_5d"),
        vol_label(now).alias("label"),
    )


def vol_label(v: Column) -> Column:
    return (
        F.when(v.isNull(), F.lit("unknown"))
        .when(v < 15, F.lit("greed"))
        .when(v < 20, F.lit("neutral"))
        .when(v < 30, F.lit("fear"))
        .otherwise(F.lit("extreme-fear"))
    )


def exposure_tier(score: Column) -> Column:
    """How much to be invested at a breadth score."""
    return (
        F.when(score >= 65, F.lit("full"))
        .when(score >= 50, F.lit("normal"))
        .when(score >= 35, F.lit("reduced"))
        .otherwise(F.lit("defensive"))
    )


def sentiment_band(score: Column) -> Column:
    """Fear and greed wording of a 0..100 index."""
    return (
        F.when(score < 25, F.lit("extreme fear"))
        .when(score < 45, F.lit("fear"))
        .when(score > 75, F.lit("extreme greed"))
        .when(score > 55, F.lit("greed"))
        .otherwise(F.lit("neutral"))
    )


def sentiment_points(points: Column, keep: int = 30) -> Column:
    """Last points of array<struct<x: epoch ms, y>> as (date, value); missing values are dropped."""
    tail = F.slice(points, F.greatest(F.size(points) - keep + 1, F.lit(1)), F.lit(keep))
    known = F.filter(tail, lambda p: p["y"].isNotNull())
    return F.transform(
        known,
        lambda p: F.struct(
            F.timestamp_millis(p["x"].cast("bigint")).cast("date").alias("date"), F.round(p["y"], 1).alias("value")
        ),
    )
