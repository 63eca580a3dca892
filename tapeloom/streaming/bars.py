"""Streams: bars from ticks, and versions of bars kept per micro-batch."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeloom.sources.store import upsert

C = F.col


def tick_bars(ticks: DataFrame, minutes: int = 15, late: str = "30 minutes") -> DataFrame:
    """Bars of fixed length from ticks(ticker, ts, price, event_id).

    The state holds one row per ticker and open bar; a bar is final once the watermark passes it.
    """
    at = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("ticker", F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
        .select("ticker", C("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def deduplicated(feed: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Drop repeated deliveries of a feed with event time ``ts`` inside the lateness."""
    return feed.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def deliver(rows: DataFrame, path: str, files: int) -> None:
    """Land a delivery as exactly so many files, so that a feed of that many a micro-batch takes it whole.

    Rows are dealt out evenly; only where there are too few for every file, empty files make up the number.
    """
    rows.repartition(files).write.parquet(path)
    spark = rows.sparkSession
    for _ in range(files - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
        rows.limit(0).coalesce(1).write.mode("append").parquet(path)


def write_versions(feed: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Keep every micro-batch under the time its run began and its number; rows carry both as their version.

    Batch numbers start over when a checkpoint is lost, start times do not: what a later run delivers is
    newer than all before. Within a run a batch delivered again replaces only itself. A batch that was
    cut short by a failure comes again in the next run, before anything newer.
    """
    began = time.time_ns() // 1_000_000

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={began}/batch={batch_id}")

    return (
        feed.writeStream.outputMode(mode)
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of every key in a folder of kept batches; the version is in ``run`` and ``batch``."""
    held = spark.read.parquet(path).withColumn("version_", F.struct("run", "batch"))
    return upsert(held.limit(0), held, keys, "version_").drop("version_")


def compact(spark: SparkSession, path: str, target: str, keys: list[str]) -> None:
    """Write the newest rows as a fresh table partitioned by date."""
    rows = newest_rows(spark, path, keys)
    rows.repartition("dt").write.mode("overwrite").partitionBy("dt").parquet(target)
