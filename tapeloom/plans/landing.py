"""Queries over landed files, logs and reports, the texts of a summary, and a stream of corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import breadth as br
from tapeloom.operators import patterns as pt
from tapeloom.operators import screen as sc
from tapeloom.plans import health as he
from tapeloom.plans import screens
from tapeloom.plans import sql as q
from tapeloom.plans.registry import query
from tapeloom.session import shared_folder
from tapeloom.sources import feeds, store
from tapeloom.sources.bars import daily, sectors, table
from tapeloom.streaming.bars import deduplicated, deliver, newest_rows, write_versions

C = F.col


@query(
    "grouped_payloads",
    q.with_ctes(
        q.BARS,
        select="""SELECT ticker, CAST(dt AS VARCHAR) AS dt, open, high, low, close, CAST(volume AS BIGINT) AS volume
        FROM bars WHERE ticker IN (SELECT n_name FROM nation)""",
    ),
)
def grouped_payloads(spark, sf):
    """One JSON document a day is landed and read back as bars of known tickers."""
    folder = shared_folder(spark, "payloads")
    bars = daily(spark, sf)
    rows = bars.select(F.lower("ticker").alias("T"), *[C(c).alias(c[0]) for c in ("open", "high", "low", "close", "volume")], "dt")
    feeds.write_grouped_days(rows, folder)
    landed = feeds.read_grouped_days(spark, folder)
    return feeds.ingest_grouped(landed, sectors(spark, sf).select("ticker")).withColumn("dt", C("dt").cast("string"))


@query(
    "weekday_bars",
    q.with_ctes(
        q.BARS,
        """days AS (SELECT CAST(UNNEST(GENERATE_SERIES((SELECT MAX(dt) FROM bars) - 40, (SELECT MAX(dt) FROM bars), INTERVAL 1 DAY)) AS DATE) AS day),
        newest AS (SELECT day FROM days WHERE ISODOW(day) <= 5 ORDER BY day DESC LIMIT 15)""",
        select="SELECT CAST(day AS VARCHAR) AS day, COUNT(ticker) AS bars FROM newest LEFT JOIN bars ON dt = day GROUP BY day",
    ),
)
def weekday_bars(spark, sf):
    bars = daily(spark, sf)
    days = feeds.weekday_lookback(spark, bars.agg(F.max("dt")).scalar(), 15)
    counted = days.join(bars.select(C("dt").alias("day"), "ticker"), "day", "left").groupBy("day").agg(F.count("ticker").alias("bars"))
    return counted.select(C("day").cast("string").alias("day"), "bars")


@query(
    "static_symbols",
    """SELECT p_brand AS symbol, MIN(p_partkey) AS pos FROM
    (SELECT CASE WHEN p_size % 4 = 0 THEN p_brand || '.' || CAST(p_size AS VARCHAR) ELSE p_brand || CAST(p_size % 9 AS VARCHAR) END AS p_brand, p_partkey FROM part)
    WHERE p_brand NOT LIKE '%.%' GROUP BY p_brand""",
)
def static_symbols(spark, sf):
    size = C("p_size")
    dotted = F.concat("p_brand", F.lit("."), size.cast("string"))
    symbol = F.when(size % 4 == 0, dotted).otherwise(F.concat("p_brand", (size % 9).cast("string")))
    return feeds.dedup_symbols(table(spark, sf, "part").select(symbol.alias("symbol"), C("p_partkey").alias("pos")))


@query(
    "run_log",
    """WITH log AS (SELECT year(o_orderdate) AS run, o_orderkey AS id, o_orderpriority AS stage,
      CASE WHEN year(o_orderdate) % 2 = 0 THEN 'again-' ELSE '' END || o_orderstatus AS message FROM orders)
    SELECT run, stage, COUNT(*) AS rows, MAX(id) AS id, ARG_MAX(message, id) AS message FROM log GROUP BY run, stage""",
)
def run_log(spark, sf):
    """Every run is logged; the runs of even years are logged again, which replaces them."""
    folder = shared_folder(spark, "log")
    log = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("run"), C("o_orderkey").alias("id"), C("o_orderpriority").alias("stage"), C("o_orderstatus").alias("message")
    )
    store.append_log(log, folder)
    store.append_log(log.filter(C("run") % 2 == 0).withColumn("message", F.concat(F.lit("again-"), "message")), folder)
    held = spark.read.schema(log.schema).parquet(folder)
    return held.groupBy("run", "stage").agg(F.count(F.lit(1)).alias("rows"), F.max("id").alias("id"), F.max_by("message", "id").alias("message"))


@query(
    "reports_back",
    q.with_ctes(
        q.BARS,
        "each_ticker AS (SELECT ticker, COUNT(*) AS n, ARG_MAX(close, i) AS last_close FROM bars GROUP BY ticker)",
        select="SELECT 'json' AS fmt, ticker, n, last_close FROM each_ticker UNION ALL SELECT 'csv', ticker, n, last_close FROM each_ticker",
    ),
)
def reports_back(spark, sf):
    folder = shared_folder(spark, "reports")
    summary = daily(spark, sf).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max_by("close", "i").alias("last_close"))
    back = []
    for fmt in ("json", "csv"):
        store.write_report(summary, f"{folder}/{fmt}", fmt)
        report = store.read_report(spark, f"{folder}/{fmt}", "ticker string, n bigint, last_close double", fmt)
        back.append(report.withColumn("fmt", F.lit(fmt)))
    return back[0].unionByName(back[1])


def _texts(*lines: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(lines) + "], lambda x: x IS NOT NULL), '; ')"


@query(
    "summary_texts",
    q.with_ctes(
        q.BARS,
        screens.SUMMARY,
        he.THEMES,
        "told AS (SELECT ticker, string_agg(theme, ',' ORDER BY theme) AS themes FROM themes GROUP BY ticker)",
        select=f"""SELECT s.ticker, {_texts(
            "CASE WHEN up THEN 'stage 2 uptrend (close > SMA50 > SMA200)' END",
            "CASE WHEN ROUND(rsi, 2) BETWEEN 40 AND 70 THEN printf('RSI %.1f', rsi) END",
            "CASE WHEN macd > macd_signal THEN 'MACD above signal' END",
            "CASE WHEN ROUND(ABS(pfh), 2) <= 15 THEN printf('%.1f%% off the 52-week high', ABS(pfh)) END",
            "CASE WHEN tight THEN 'range tightening' END",
            "CASE WHEN volume < vol50 THEN 'volume contraction' END",
            "CASE WHEN ROUND(vr, 2) >= 1.5 THEN printf('volume %.1f times average', vr) END",
            "printf('RR %.2f (target %.2f, stop %.2f)', rr, target, stop)",
        )} AS reasons, {_texts(
            "CASE WHEN ROUND(rsi, 2) > 65 THEN printf('RSI %.1f is stretched', rsi) END",
            "CASE WHEN ROUND(ABS(pfh), 2) > 10 THEN printf('%.1f%% below the 52-week high', ABS(pfh)) END",
            "CASE WHEN NOT tight THEN 'no range tightening' END",
            "CASE WHEN vr > 0 AND ROUND(vr, 2) < 0.5 THEN 'thin volume' END",
            "CASE WHEN ROUND(rr, 2) < 2 THEN printf('RR %.2f below tier 1', rr) END",
        )} AS risks, COALESCE(themes, '') AS themes FROM su3 s LEFT JOIN told t ON t.ticker = s.ticker""",
    ),
)
def summary_texts(spark, sf):
    """Reasons, risks and themes of each ticker, as text."""
    themes = br.ticker_themes(he.themes(spark, sf))
    told = sc.stock_summary(daily(spark, sf)).join(themes, "ticker", "left")
    lines = [F.array_join(c, "; ").alias(c) for c in ("reasons", "risks")]
    return told.select("ticker", *lines, F.coalesce(F.array_join("themes", ","), F.lit("")).alias("themes"))


@query(
    "sentiment",
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS date, CASE WHEN day(ts) % 7 <> 0 THEN AVG(value) END AS y FROM events GROUP BY event_type, CAST(ts AS DATE), day(ts)),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY date DESC) AS back FROM d)
    SELECT event_type, CAST(date AS VARCHAR) AS date, ROUND(y, 1) AS value,
      CASE WHEN y < 25 THEN 'extreme fear' WHEN y < 45 THEN 'fear' WHEN y > 75 THEN 'extreme greed' WHEN y > 55 THEN 'greed' ELSE 'neutral' END AS band
    FROM k WHERE back <= 20 AND y IS NOT NULL""",
)
def sentiment(spark, sf):
    """Daily points of each event type as a feed gives them: an array of (epoch ms, value), some without value."""
    events = table(spark, sf, "events").withColumn("at", F.to_date("ts"))
    days = events.groupBy("event_type", "at").agg(F.avg("value").alias("y"))
    x = (F.unix_timestamp(C("at").cast("timestamp")) * 1000).cast("double").alias("x")
    point = F.struct(x, F.when(F.dayofmonth("at") % 7 != 0, C("y")).alias("y"))
    series = days.groupBy("event_type").agg(F.sort_array(F.collect_list(point)).alias("points"))  # one point a day
    exact = F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    shown = series.select("event_type", F.explode(F.arrays_zip(br.sentiment_points(C("points"), 20).alias("s"), _known(exact, 20).alias("e"))).alias("p"))
    return shown.select("event_type", C("p.s.date").cast("string").alias("date"), C("p.s.value").alias("value"), br.sentiment_band(C("p.e.y")).alias("band"))


def _known(points, keep: int):
    """The same points, unrounded."""
    tail = F.slice(points, F.greatest(F.size(points) - keep + 1, F.lit(1)), F.lit(keep))
    return F.filter(tail, lambda p: p["y"].isNotNull())


@query(
    "base_rails",
    q.with_ctes(
        q.BARS,
        "n AS (SELECT *, COUNT(*) OVER (PARTITION BY ticker) AS n FROM bars)",
        select="SELECT ticker, MAX(high) AS base_high, MIN(low) AS base_low FROM n WHERE n - i <= n % 9 + 45 GROUP BY ticker",
    ),
)
def base_rails(spark, sf):
    bars = daily(spark, sf)
    bases = bars.groupBy("ticker").agg((F.count(F.lit(1)) % 9 + 40).alias("base_length"))
    return pt.base_rails(bars, bases)


# Deliveries of the stream: the older two thirds, the rest, then corrections with repeats, some of them too late.
# What is too late in a micro-batch is told by the watermark that the one before it went by.
_CUT = "TIMESTAMP '2024-01-21'"


@query(
    "stream_corrections",
    f"""WITH e AS (SELECT event_id, ts, value FROM events),
    mark AS (SELECT MAX(ts) - INTERVAL 5 DAY AS since FROM e WHERE ts < {_CUT}),
    versions AS (
      SELECT event_id, ts, value, 1 AS version FROM e WHERE ts < {_CUT}
      UNION ALL SELECT event_id, ts, value * 2, 2 FROM e WHERE ts < {_CUT} AND event_id % 5 = 0 AND ts >= (SELECT since FROM mark)
      UNION ALL SELECT event_id, ts, value, 3 FROM e WHERE ts >= {_CUT})
    SELECT event_id, ARG_MAX(value, version) AS value, CAST(MAX(version) AS INTEGER) AS version FROM versions GROUP BY event_id""",
)
def stream_corrections(spark, sf):
    """An upsert from a stream that corrects, repeats and delays rows.

    Deliveries come one a micro-batch. Repeats inside the lateness of five days are dropped by state, which
    the watermark bounds; corrections older than that are dropped too; of what is left the newest version wins.
    """
    folder = shared_folder(spark, "corrections")
    events = table(spark, sf, "events").select("event_id", C("ts").cast("timestamp").alias("ts"), "value")
    cut = F.expr(_CUT)
    older = events.filter(C("ts") < cut).withColumn("version", F.lit(1))
    fixed = older.filter(C("event_id") % 5 == 0).withColumns({"value": C("value") * 2, "version": F.lit(2)})
    again = older.filter(C("event_id") % 3 == 0).withColumn("value", F.lit(-1.0))  # would show if it were taken
    rest = events.filter(C("ts") >= cut).withColumn("version", F.lit(3))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k, rows in enumerate((older, rest.unionByName(rest), fixed.unionByName(fixed).unionByName(again))):
        deliver(rows, f"{folder}/in/delivery={k}", files)
    schema = "event_id bigint, ts timestamp, value double, version int, delivery int"
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in").drop("delivery")
    once = deduplicated(feed, ["event_id", "version"], "5 days")
    write_versions(once, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return newest_rows(spark, f"{folder}/out", ["event_id"]).select("event_id", "value", "version")
