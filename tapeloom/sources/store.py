"""Upkeep of the bar store, the universe, the pick history and the run log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import rolling as r
from tapeloom.session import clustered, safe_unions

C = F.col


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str, *position: str) -> DataFrame:
    """Newest version of every key. Of equal versions the change wins over what is stored, then the later
    ``position`` in the feed, then the largest values, so that one input has one result.

    A grouped ``max_by`` reduces map-side, so many copies of one key never meet in one task.
    """
    safe_unions(current.sparkSession)
    values = [c for c in current.columns if c not in keys]
    both = current.withColumn("side_", F.lit(0)).unionByName(changes.withColumn("side_", F.lit(1)))
    order = F.struct(version, "side_", *position, *[c for c in values if c != version])
    newest = F.max_by(F.struct(*values), order).alias("row_")
    return both.groupBy(*keys).agg(newest).select(*keys, "row_.*")


def upsert_known(current: DataFrame, changes: DataFrame, version: str, *position: str) -> DataFrame:
    """As ``upsert`` on (ticker, dt), but only for tickers the store already has; bars are numbered anew."""
    known = current.select("ticker").distinct()
    usable = changes.filter(C("close").isNotNull()).join(known, "ticker", "left_semi")
    return renumbered(upsert(current, usable, ["ticker", "dt"], version, *position))


def numbered(bars: DataFrame) -> DataFrame:
    """Bars with ``i``, their place from 0 among the ticker's dates, which windows and screens rely on."""
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("dt"))
    return bars.withColumn("i", place.cast("bigint") - 1)


def renumbered(bars: DataFrame) -> DataFrame:
    """Numbers bars that carry ``i`` again, after some were added or dropped."""
    return numbered(bars) if "i" in bars.columns else bars


def stored(bars: DataFrame) -> DataFrame:
    """Keep a table of bars in buckets of tickers, sorted by ticker and place, for jobs that read it several times.

    Its readers know the buckets: windows and grouping by ticker, and joins on the ticker of two such
    tables, need no shuffle, and a filter on one ticker reads one bucket.
    """
    return clustered(bars, "ticker", "i")


def trim_history(bars: DataFrame, years: int = 6) -> DataFrame:
    """Keep each ticker's own last ``years`` years; bars are numbered anew."""
    newest = bars.groupBy("ticker").agg(F.add_months(F.max("dt"), -12 * years).alias("from_dt"))
    return renumbered(bars.join(newest, "ticker").filter(C("dt") >= C("from_dt")).drop("from_dt"))


def upsert_universe(current: DataFrame, listing: DataFrame) -> DataFrame:
    """Listing wins for name, exchange and updated_at; sector, industry and cap are kept."""
    new = listing.select("ticker", *[C(c).alias(f"new_{c}") for c in ("name", "exchange", "updated_at")])
    joined = current.join(new, "ticker", "full_outer")
    listed = C("new_updated_at").isNotNull()
    updated = {
        c: F.when(listed, C(f"new_{c}")).otherwise(C(c)) for c in ("name", "exchange", "updated_at")
    }
    return (
        joined.withColumns(updated)
        .withColumns({"sector": F.coalesce("sector", F.lit("")), "industry": F.coalesce("industry", F.lit(""))})
        .withColumn("market_cap", F.coalesce("market_cap", F.lit(0.0)))
        .select(*current.columns)
    )


def fill_sectors(universe: DataFrame, feed: DataFrame, display: dict[str, str]) -> DataFrame:
    """Fill only missing sectors from ``feed(ticker, sector)``, shown under their display names."""
    names = F.create_map(*[F.lit(x) for pair in display.items() for x in pair])
    shown = feed.select("ticker", F.coalesce(names[C("sector")], C("sector")).alias("fed_"))
    missing = F.coalesce(C("sector"), F.lit("")) == ""
    known = F.coalesce(C("fed_"), F.lit("")) != ""
    return (
        universe.join(shown, "ticker", "left")
        .withColumn("sector", F.when(missing & known, C("fed_")).otherwise(C("sector")))
        .drop("fed_")
    )


def liquid_admission(
    bars: DataFrame, min_dollar_volume: float = 1e7, max_collapse: float = 20.0, window: int = 60
) -> DataFrame:
    """Tickers whose best rolling median dollar volume is high enough and that never collapsed."""
    med = bars.withColumn("med", r.rolling_median(C("close") * C("volume"), window))
    each = med.groupBy("ticker").agg(
        F.max("med").alias("best_dollar_vol"),
        F.max("close").alias("top"),
        F.max_by("close", "i").alias("last"),
    )
    collapsed = (C("last") > 0) & (C("top") / C("last") > max_collapse)
    return each.filter((C("best_dollar_vol") >= min_dollar_volume) & ~collapsed)


def replaced(history: DataFrame, new: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Pick history after whole scan dates are replaced: those in ``scanned(scan_date)``, also where a scan
    found nothing, and those of ``new``.
    """
    safe_unions(history.sparkSession)
    dates = new.select("scan_date")
    dates = (dates if scanned is None else dates.unionByName(scanned.select("scan_date"))).distinct()
    return history.join(dates, "scan_date", "left_anti").unionByName(new, allowMissingColumns=True)


def retain_dates(history: DataFrame, keep: int) -> DataFrame:
    """Rows of the newest ``keep`` distinct scan dates."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    newest = history.select("scan_date").distinct().orderBy(F.desc("scan_date")).limit(keep)
    return history.filter(C("scan_date") >= newest.agg(F.min("scan_date")).scalar())


def write_picks(new: DataFrame, path: str, scanned: Sequence[dt.date] = ()) -> None:
    """Replace scan dates in a table partitioned by scan date: those of ``new``, and ``scanned`` dates without picks."""
    (
        new.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("scan_date")
        .parquet(path)
    )
    if scanned:
        found = new.filter(C("scan_date").isin(list(scanned))).select("scan_date").distinct()
        drop_dates(new.sparkSession, path, sorted(set(scanned) - {r.scan_date for r in found.collect()}))


def drop_dates(spark: SparkSession, path: str, dates: Iterable[dt.date]) -> None:
    """Delete the partitions of scan dates from a table that ``write_picks`` made."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for date in dates:
        folder = hadoop.Path(f"{path.rstrip('/')}/scan_date={date}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def save_then_prune(new: DataFrame, path: str, keep: int, drop: Callable[[list], None] | None = None) -> list:
    """Write first; only after that drop the outdated scan dates. A failed write prunes nothing."""
    write_picks(new, path)
    spark = new.sparkSession
    dates = spark.read.parquet(path).select("scan_date").distinct().withColumn("age_", F.rank().over(Window.orderBy(F.desc("scan_date"))))
    outdated = sorted(r.scan_date for r in dates.filter(C("age_") > keep).collect())  # one row per scan date
    drop_dates(spark, path, outdated) if drop is None else drop(outdated)
    return outdated


def write_bars(bars: DataFrame, path: str, files: int | None = None) -> None:
    """Store bars clustered by ticker and sorted, so that reads of one ticker skip row groups."""
    spread = bars.repartition(files, "ticker") if files else bars.repartition("ticker")
    spread.sortWithinPartitions("ticker", "dt").write.mode("overwrite").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Add the log rows of runs, named by their column ``run``; a run logged again replaces its own rows only."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def log_tail(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(n)


def latest_by_stage(log: DataFrame) -> DataFrame:
    return log.groupBy("stage").agg(F.max("id").alias("id"), F.max_by("message", "id").alias("message"))


def store_status(bars: DataFrame) -> DataFrame:
    """Distinct tickers and the newest date; tickers are reduced map-side before the count."""
    each = bars.groupBy("ticker").agg(F.max("dt").alias("last_dt"))
    return each.agg(F.count(F.lit(1)).alias("tickers"), F.max("last_dt").alias("last_dt"))


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Result sink for summaries: JSON lines, or CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def read_report(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)
