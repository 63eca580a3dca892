"""Price bars derived from transaction tables.

Bars are unique per (ticker, dt), so the rows of one ticker are bounded by the calendar
(a century of daily bars is about 25,000 rows) however large the tick table grows. The
aggregation below reduces ticks map-side before its shuffle, which is what keeps one
very busy ticker from loading one task; everything after it may window by ticker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.session import safe_unions


# Declared, so that opening a table reads no footer and starts no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _percent(col: str) -> Column:
    """Whole percent of a non-negative fraction; adding a half stays in plain doubles, unlike ``round``."""
    return F.floor(F.col(col) * 100 + 0.5)


def _day_totals(ticks: DataFrame, *keys: str) -> DataFrame:
    return ticks.groupBy(*keys).agg(
        F.sum("q").alias("volume"),
        F.count(F.lit(1)).alias("n"),
        F.sum("disc").alias("sd"),
        F.min("disc").alias("nd"),
        F.max("disc").alias("xd"),
        F.sum("tax").alias("st"),
    )


def _fold_totals(totals: DataFrame, *keys: str) -> DataFrame:
    return totals.groupBy(*keys).agg(
        F.sum("volume").alias("volume"),
        F.sum("n").alias("n"),
        F.sum("sd").alias("sd"),
        F.min("nd").alias("nd"),
        F.max("xd").alias("xd"),
        F.sum("st").alias("st"),
    )


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.to_date("l_shipdate").alias("dt"),
        F.col("l_quantity").alias("q"),
        _percent("l_discount").alias("disc"),
        _percent("l_tax").alias("tax"),
    )


def _ohlcv(totals: DataFrame) -> DataFrame:
    """Turn per-day totals into bars; the close walks by the day's discount step."""
    n = F.col("n")
    step = F.round((F.col("sd").cast("double") / n - F.lit(4.5)) * 20).cast("bigint")
    walk = Window.partitionBy("ticker").orderBy("dt")
    level = F.sum("step").over(walk.rowsBetween(Window.unboundedPreceding, 0))
    op = F.col("close") * (1 - (F.col("st").cast("double") / n - 4) / 500)
    return (
        totals.withColumn("step", step)
        .withColumn("close", F.round(100 * F.exp(level.cast("double") / 10000), 4))
        .withColumn("i", F.row_number().over(walk).cast("bigint") - 1)
        .withColumn("open", op)
        .select(
            "ticker",
            "dt",
            "i",
            "open",
            (F.greatest("open", "close") * (1 + F.col("xd").cast("double") / 1000)).alias("high"),
            (F.least("open", "close") * (1 - (10 - F.col("nd")).cast("double") / 1000)).alias("low"),
            "close",
            "volume",
        )
    )


def daily(spark: SparkSession, sf_dir: str, market: bool = True) -> DataFrame:
    """One ticker per nation, plus the whole market as ticker ``MKT``."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    home = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        "s_suppkey", F.col("n_name").alias("ticker")
    )
    ticks = _ticks(spark, sf_dir)
    totals = _day_totals(ticks.join(home, ticks.l_suppkey == home.s_suppkey), "ticker", "dt")
    if market:
        safe_unions(spark)
        whole = _fold_totals(totals, "dt").withColumn("ticker", F.lit("MKT"))
        totals = totals.unionByName(whole)
    return _ohlcv(totals)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticker per supplier: many tickers, for cross-sections and load."""
    ticks = _ticks(spark, sf_dir).withColumn("ticker", F.col("l_suppkey").cast("string"))
    return _ohlcv(_day_totals(ticks, "ticker", "dt"))


def intraday(spark: SparkSession, sf_dir: str, minutes: int = 15) -> DataFrame:
    """Raw intraday bars per event type: epoch seconds ``t`` plus o, h, l, c, v."""
    width = minutes * 60
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ticker"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("value").alias("price"),
    )
    sec = F.floor(F.unix_timestamp("ts") / width) * width
    at = F.struct("ts", "event_id")
    return (
        ev.withColumn("t", sec.cast("bigint"))
        .groupBy("ticker", "t")
        .agg(
            F.min_by("price", at).alias("o"),
            F.max("price").alias("h"),
            F.min("price").alias("l"),
            F.max_by("price", at).alias("c"),
            F.count(F.lit(1)).cast("double").alias("v"),
        )
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Universe rows: ticker (nation) and sector (region)."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("ticker"), F.col("r_name").alias("sector")
    )
