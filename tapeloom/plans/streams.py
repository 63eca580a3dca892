"""The streaming query: ticks read as a stream, bars kept by a sink table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.plans import sql as q
from tapeloom.plans.registry import query
from tapeloom.session import shared_folder
from tapeloom.sources.bars import SCHEMAS
from tapeloom.streaming.bars import newest_rows, tick_bars, write_versions

C = F.col


@query(
    "stream_bars",
    q.with_ctes(
        q.INTRADAY,
        select="""SELECT ticker, t, o AS open, h AS high, l AS low, c AS close, CAST(v AS BIGINT) AS volume FROM raw""",
    ),
)
def stream_bars(spark, sf):
    """Every tick of the events table goes through the stream; the watermark closes the last bars at the end."""
    folder = shared_folder(spark, "stream")
    ticks = (
        spark.readStream.schema(SCHEMAS["events"])
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
        .select(
            C("event_type").alias("ticker"), C("ts").cast("timestamp").alias("ts"), C("value").alias("price"), "event_id"
        )
    )
    bars = tick_bars(ticks)
    write_versions(bars, f"{folder}/out", f"{folder}/checkpoint", "update").awaitTermination()
    newest = newest_rows(spark, f"{folder}/out", ["ticker", "ts"])
    return newest.select("ticker", F.unix_timestamp("ts").alias("t"), "open", "high", "low", "close", "volume")
