"""Shaping of landed feed files: grouped daily payloads, wide downloads, symbol files, series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.session import safe_unions

C = F.col

GROUPED_SCHEMA = (
    "status string, results array<struct<T: string, o: double, h: double, l: double, c: double, v: double>>"
)

# Exchanges admitted, and the name and symbol patterns of the symbol directory.
EXCHANGES = ("NYSE", "NASDAQ", "AMEX", "NYSE American")
KEEP_NAME = r"(?i)common stock|ordinary shares?|common shares?|class [a-c]"
DROP_NAME = (
    r"(?i)acquisition corp|acquisition inc|acquisition compan|warrant|right|unit|preferred|depositary|"
    r"notes? due|trust preferred|%|etf|etn|fund\b|closed end"
)
DERIVATIVE_SYMBOL = r"^[A-Z]{4}[WRUPZ]$"
PLAIN_SYMBOL = r"^[A-Z]{1,5}$"
INDEX_SYMBOLS = ("SPY", "QQQ", "IWM")


def read_grouped(spark: SparkSession, path: str, day: str) -> DataFrame:
    """Grouped-daily JSON file(s) of one day as rows T, o, h, l, c, v, dt."""
    raw = spark.read.schema(GROUPED_SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.inline("results")).withColumn("dt", F.lit(day).cast("date"))


def read_grouped_days(spark: SparkSession, path: str) -> DataFrame:
    """Grouped-daily JSON of many days, one document a line with its ``dt``, as rows T, o, h, l, c, v, dt."""
    raw = spark.read.schema(GROUPED_SCHEMA + ", dt date").json(path)
    return raw.select(F.inline("results"), "dt")


def write_grouped_days(rows: DataFrame, path: str) -> None:
    """Land rows T, o, h, l, c, v, dt as such payloads, one document a day; a day holds each symbol once."""
    payload = F.sort_array(F.collect_list(F.struct("T", "o", "h", "l", "c", "v"))).alias("results")
    days = rows.groupBy("dt").agg(payload).select("dt", F.lit("OK").alias("status"), "results")
    days.write.json(path)


def ingest_grouped(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Feed rows -> bars of known tickers: symbol cleaned, no bar without close, missing volume is 0."""
    cleaned = rows.select(
        F.upper(F.trim(F.coalesce("T", F.lit("")))).alias("ticker"),
        "dt",
        C("o").alias("open"),
        C("h").alias("high"),
        C("l").alias("low"),
        C("c").alias("close"),
        F.coalesce(C("v").cast("bigint"), F.lit(0)).alias("volume"),
    ).filter(C("close").isNotNull())
    return cleaned.join(universe.select("ticker"), "ticker", "left_semi")


def melt_wide(wide: DataFrame, tickers: list[str], fields: tuple[str, ...] = ("Open", "High", "Low", "Close", "Volume")) -> DataFrame:
    """Wide download (one column per field and ticker, ``Close_AAA``) -> long bars."""
    per_ticker = [
        F.struct(F.lit(t).alias("ticker"), *[C(f"{f}_{t}").cast("double").alias(f.lower()) for f in fields])
        for t in tickers
    ]
    return (
        wide.select("dt", F.inline(F.array(*per_ticker)))
        .filter(C("close").isNotNull())
        .withColumn("volume", F.coalesce(C("volume").cast("bigint"), F.lit(0)))
    )


def _last_business_day(d: dt.date) -> dt.date:
    d -= dt.timedelta(days=1)
    while d.weekday() >= 5:
        d -= dt.timedelta(days=1)
    return d


def pending_days(latest: DataFrame, now_ny: dt.datetime) -> DataFrame:
    """Business days to fetch per row of ``latest(ticker, last_dt)``, the latest stored day included.

    Up to 16:15 New York time the current day is not complete yet and is left out.
    """
    end = now_ny.date()
    if now_ny.time() <= dt.time(16, 15):
        end = _last_business_day(end)
    days = F.when(C("last_dt") <= F.lit(end), F.sequence(C("last_dt"), F.lit(end)))
    return latest.select("ticker", F.explode(days).alias("day")).filter(F.weekday("day") < 5)


def weekday_lookback(spark: SparkSession, today: dt.date | Column, n: int) -> DataFrame:
    """The newest ``n`` weekdays up to today, a date or a scalar subquery, newest first."""
    end = today if isinstance(today, Column) else F.lit(today)
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(end, 2 * n + 7), end)).alias("day"))
    return days.filter(F.weekday("day") < 5).orderBy(F.desc("day")).limit(n)


def universe_filter(listing: DataFrame) -> DataFrame:
    """Common stocks of the admitted exchanges with plain symbols of at most five characters."""
    return listing.filter(
        C("exchange").isin(*EXCHANGES)
        & (C("type") == "stock")
        & (C("symbol") != "")
        & ~C("symbol").contains(".")
        & (F.length("symbol") <= 5)
    )


def _symbol_ok() -> Column:
    return (
        (C("etf") == "N")
        & (C("test") == "N")
        & C("name").rlike(KEEP_NAME)
        & ~C("name").rlike(DROP_NAME)
        & ~C("symbol").rlike(DERIVATIVE_SYMBOL)
        & C("symbol").rlike(PLAIN_SYMBOL)
    )


def read_symbol_file(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated symbol directory with columns symbol, name, etf, test."""
    schema = "symbol string, name string, etf string, test string"
    return spark.read.schema(schema).option("header", True).option("sep", "|").csv(path)


def universe_symbols(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct operating-company symbols of two directories plus the index tickers."""
    safe_unions(first.sparkSession)
    cols = ["symbol", "name", "etf", "test"]
    both = first.select(cols).unionByName(second.select(cols)).filter(_symbol_ok()).select("symbol")
    index = first.sparkSession.createDataFrame([(s,) for s in INDEX_SYMBOLS], "symbol string")
    return both.unionByName(index).distinct()


def dedup_symbols(listed: DataFrame) -> DataFrame:
    """First position of each undotted symbol in a static list (symbol, pos)."""
    return listed.filter(~C("symbol").contains(".")).groupBy("symbol").agg(F.min("pos").alias("pos"))


def last_observations(series: DataFrame, n: int = 2) -> DataFrame:
    """Newest ``n`` usable values per series; '.' and empty text are not values."""
    known = series.withColumn("value", F.trim("value")).filter(~C("value").isin(".", ""))
    newest = Window.partitionBy("series_id").orderBy(F.desc("dt"))
    return known.withColumn("k", F.row_number().over(newest)).filter(C("k") <= n)
