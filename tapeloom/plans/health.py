"""Queries over breadth scores, their history, and price tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import scalar
from tapeloom.operators import breadth as br
from tapeloom.operators import screen as sc
from tapeloom.plans import sql as q
from tapeloom.plans.registry import query
from tapeloom.plans.screens import STAGE2
from tapeloom.plans.windows import day, rnd
from tapeloom.sources.bars import daily, table

C = F.col
DISPLAY = {"AFRICA": "SOUTH", "AMERICA": "WEST", "ASIA": "EAST", "EUROPE": "WEST"}


def flags(spark, sf):
    return sc.stage2(daily(spark, sf))


def universe(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), C("n_regionkey") == C("r_regionkey"))
    k = C("n_nationkey")
    named = n.select(
        F.explode(F.filter(F.array(C("n_name"), F.when(k % 5 == 0, F.concat(F.lit("X"), "n_name"))), lambda x: x.isNotNull())).alias("ticker"),
        F.when(k % 7 != 6, C("r_name")).otherwise("").alias("sector"),
    )
    return named


def themes(spark, sf):
    k = C("n_nationkey").cast("string")
    n = table(spark, sf, "nation")
    odd = C("n_nationkey") % 2 == 1
    two = F.array(F.concat(F.lit("mod"), (C("n_nationkey") % 4).cast("string")), F.when(odd, F.lit("odd")))
    member = F.when(C("n_nationkey") % 6 == 5, F.concat(F.lit("GONE"), k)).otherwise(C("n_name"))
    return n.select(member.alias("ticker"), F.explode(F.filter(two, lambda x: x.isNotNull())).alias("theme"))


FLAGS = "flags AS (SELECT ticker, stage2 FROM s2 WHERE i = n - 1)"
UNIVERSE = """uni AS (SELECT n_name AS ticker, CASE WHEN n_nationkey % 7 <> 6 THEN r_name ELSE '' END AS sector
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'X' || n_name, CASE WHEN n_nationkey % 7 <> 6 THEN r_name ELSE '' END
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 0)"""
THEMES = """mem AS (SELECT CASE WHEN n_nationkey % 6 = 5 THEN 'GONE' || n_nationkey ELSE n_name END AS ticker, n_nationkey FROM nation),
themes AS (SELECT ticker, 'mod' || (n_nationkey % 4) AS theme FROM mem UNION ALL
  SELECT ticker, 'odd' FROM mem WHERE n_nationkey % 2 = 1)"""
OVERALL = """ov AS (SELECT COUNT(*) AS total_screened, COUNT(*) FILTER (stage2) AS stage2_count,
  ROUND(COUNT(*) FILTER (stage2) * 100.0::DOUBLE / COUNT(*), 1) AS overall_score FROM flags),
overall AS (SELECT *, CASE WHEN overall_score >= 50 THEN 'Bullish' WHEN overall_score >= 30 THEN 'Neutral' ELSE 'Bearish' END AS overall_signal FROM ov)"""
_DISPLAYED = "CASE sector WHEN 'AFRICA' THEN 'SOUTH' WHEN 'AMERICA' THEN 'WEST' WHEN 'ASIA' THEN 'EAST' WHEN 'EUROPE' THEN 'WEST' ELSE sector END"
SECTOR = f"""sec AS (SELECT {_DISPLAYED} AS sector, COUNT(*) AS total, COUNT(*) FILTER (COALESCE(stage2, FALSE)) AS bullish,
  ROUND(COUNT(*) FILTER (COALESCE(stage2, FALSE)) * 100.0::DOUBLE / COUNT(*), 1) AS score
  FROM uni LEFT JOIN flags ON flags.ticker = uni.ticker WHERE sector <> '' GROUP BY 1)"""
THEME = """thm AS (SELECT theme, COUNT(*) AS total, COUNT(*) FILTER (stage2) AS bullish,
  ROUND(COUNT(*) FILTER (stage2) * 100.0::DOUBLE / COUNT(*), 1) AS score
  FROM themes JOIN flags ON flags.ticker = themes.ticker GROUP BY theme)"""


@query("overall_breadth", q.with_ctes(q.BARS, STAGE2, FLAGS, OVERALL, select="SELECT * FROM overall"))
def overall_breadth(spark, sf):
    return br.overall(flags(spark, sf))


@query("sector_breadth", q.with_ctes(q.BARS, STAGE2, FLAGS, UNIVERSE, SECTOR, select="SELECT * FROM sec"))
def sector_breadth(spark, sf):
    return br.sector_scores(flags(spark, sf), universe(spark, sf), DISPLAY)


@query("theme_breadth", q.with_ctes(q.BARS, STAGE2, FLAGS, THEMES, THEME, select="SELECT * FROM thm"))
def theme_breadth(spark, sf):
    return br.theme_scores(flags(spark, sf), themes(spark, sf))


@query(
    "health_row",
    q.with_ctes(
        q.BARS,
        STAGE2,
        FLAGS,
        OVERALL,
        UNIVERSE,
        SECTOR,
        THEMES,
        THEME,
        select="""SELECT '2001-11-05' AS date, overall.*,
        (SELECT STRING_AGG(sector || '=' || CAST(score AS VARCHAR), ',' ORDER BY sector) FROM sec) AS sector_scores,
        (SELECT STRING_AGG(theme || '=' || CAST(score AS VARCHAR), ',' ORDER BY theme) FROM thm) AS theme_scores FROM overall""",
    ),
)
def health_row(spark, sf):
    from tapeloom.session import settle

    row = br.health_row(settle(flags(spark, sf)), universe(spark, sf), themes(spark, sf), "2001-11-05", DISPLAY)

    def text(m):
        pairs = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
        return F.array_join(F.array_sort(pairs), ",")

    return row.withColumns(
        {"sector_scores": text("sector_scores"), "theme_scores": text("theme_scores"), "date": C("date").cast("string")}
    )


HISTORY = """hist AS MATERIALIZED (SELECT dt, ROUND(COUNT(*) FILTER (stage2) * 100.0::DOUBLE / COUNT(*), 1) AS score FROM s2 GROUP BY dt)"""
SECTOR_HISTORY = """shist AS MATERIALIZED (SELECT dt, r_name AS sector, ROUND(COUNT(*) FILTER (stage2) * 100.0::DOUBLE / COUNT(*), 1) AS score
  FROM s2 JOIN nation ON n_name = ticker JOIN region ON n_regionkey = r_regionkey GROUP BY dt, r_name)"""


def history(spark, sf):
    every = sc.stage2(daily(spark, sf), every_row=True)
    return br.overall(every, "dt").select("dt", C("overall_score").alias("score"))


def sector_history(spark, sf):
    every = sc.stage2(daily(spark, sf), every_row=True)
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), C("n_regionkey") == C("r_regionkey"))
    named = every.join(n.select(C("n_name").alias("ticker"), C("r_name").alias("sector")), "ticker")
    return br.overall(named, "dt", "sector").select("dt", "sector", C("overall_score").alias("score"))


@query(
    "health_trend",
    q.with_ctes(
        q.BARS,
        STAGE2,
        HISTORY,
        "h AS (SELECT *, ROW_NUMBER() OVER (ORDER BY dt DESC) AS back FROM hist)",
        select="""SELECT CAST(MAX(dt) AS VARCHAR) AS dt, MAX(score) FILTER (back = 1) AS score,
        ROUND(MAX(score) FILTER (back = 1) - MAX(score) FILTER (back = 6), 1) + 0 AS change_5d,
        ROUND(AVG(score) FILTER (back <= 5), 1) AS recent5_avg,
        ROUND(AVG(score) FILTER (back BETWEEN 6 AND 10), 1) AS prev5_avg FROM h""",
    ),
)
def health_trend(spark, sf):
    t = br.health_trend(history(spark, sf))
    return t.withColumns({"dt": C("dt").cast("string"), "change_5d": C("change_5d") + F.lit(0.0)})


@query(
    "previous_sectors",
    q.with_ctes(
        q.BARS,
        STAGE2,
        SECTOR_HISTORY,
        select="""SELECT CAST(dt AS VARCHAR) AS dt, sector, score FROM shist
        WHERE dt = (SELECT MIN(dt) FROM (SELECT DISTINCT dt FROM shist ORDER BY dt DESC LIMIT 2))""",
    ),
)
def previous_sectors(spark, sf):
    return br.previous_sectors(sector_history(spark, sf)).select(day(), "sector", "score")


@query(
    "sector_ma",
    q.with_ctes(
        q.BARS,
        STAGE2,
        SECTOR_HISTORY,
        "recent AS (SELECT DISTINCT dt FROM shist ORDER BY dt DESC LIMIT 20)",
        select="""SELECT sector, COUNT(*) AS n, CASE WHEN COUNT(*) >= 2 THEN ROUND(AVG(score), 1) END AS ma,
        COUNT(*) AS points FROM shist WHERE dt IN (SELECT dt FROM recent)
        AND sector IN (SELECT sector FROM shist WHERE dt = (SELECT MAX(dt) FROM shist)) GROUP BY sector""",
    ),
)
def sector_ma(spark, sf):
    return br.sector_ma(sector_history(spark, sf)).withColumn("points", F.size("points").cast("bigint"))


@query(
    "health_weekly",
    q.with_ctes(
        q.BARS,
        STAGE2,
        HISTORY,
        """sliced AS (SELECT * FROM hist WHERE dt >= DATE '2001-12-31' - 500
          OR NOT EXISTS (SELECT 1 FROM hist WHERE dt >= DATE '2001-12-31' - 500)),
        wk AS (SELECT CAST(dt - CAST(ISODOW(dt) - 1 AS INTEGER) AS DATE) AS week, ROUND(AVG(score), 1) AS score FROM sliced GROUP BY 1)""",
        select="""SELECT CAST(week AS VARCHAR) AS week, score, CASE WHEN COUNT(*) OVER w >= 10 THEN ROUND(AVG(score) OVER w, 1) END AS ma,
        CASE WHEN score >= 65 THEN 'full' WHEN score >= 50 THEN 'normal' WHEN score >= 35 THEN 'reduced' ELSE 'defensive' END AS tier
        FROM wk WINDOW w AS (ORDER BY week ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    ),
)
def health_weekly(spark, sf):
    sliced = br.last_days(history(spark, sf), F.lit("2001-12-31").cast("date"), 500)
    w = br.weekly_scores(sliced)
    return w.select(day("week"), "score", "ma", br.exposure_tier(C("score")).alias("tier"))


_TILE_SQL = """tl AS (SELECT *, COUNT(*) OVER (PARTITION BY ticker) - i AS back, year(MAX(dt) OVER (PARTITION BY ticker)) = year(dt) AS ty FROM bars),
tile AS (SELECT ticker, ARG_MAX(close, i) AS price, MAX(close) FILTER (back = 2) AS before, ARG_MIN(close, i) AS first,
  ARG_MIN(close, i) FILTER (ty) AS year_first, COUNT(*) FILTER (back <= 30) AS points,
  ARG_MIN(close, i) FILTER (back <= 30) AS spark_first FROM tl GROUP BY ticker)"""


@query(
    "index_tiles",
    q.with_ctes(
        q.BARS,
        _TILE_SQL,
        select="""SELECT ticker, price, (price / COALESCE(before, price) - 1) * 100 AS change_1d,
        (price / first - 1) * 100 AS change_all, points, spark_first FROM tile""",
    ),
)
def index_tiles(spark, sf):
    return br.tiles(daily(spark, sf)).select(
        "ticker",
        "price",
        "change_1d",
        "change_all",
        F.size("history").cast("bigint").alias("points"),
        C("history")[0].alias("spark_first"),
    )


@query(
    "sector_perf",
    q.with_ctes(
        q.BARS,
        _TILE_SQL,
        select="""SELECT ticker, (price / COALESCE(before, price) - 1) * 100 AS change_1d,
        (price - year_first) / year_first * 100 AS change_ytd FROM tile""",
    ),
)
def sector_perf(spark, sf):
    return br.tiles(daily(spark, sf)).filter("n >= 2").select("ticker", "change_1d", "change_ytd")


@query(
    "vol_tile",
    q.with_ctes(
        q.BARS,
        "vt AS (SELECT ticker, i, FLOOR(close / 8) AS value, COUNT(*) OVER (PARTITION BY ticker) - i AS back FROM bars)",
        """vg AS (SELECT ticker, ARG_MAX(value, i) AS current, MAX(value) FILTER (back = 2) AS p1, MAX(value) FILTER (back = 6) AS p5,
        ARG_MIN(value, i) AS first FROM vt GROUP BY ticker)""",
        select="""SELECT ticker, current, current - COALESCE(p1, current) AS change_1d, current - COALESCE(p5, first) AS change_5d,
        CASE WHEN current < 15 THEN 'greed' WHEN current < 20 THEN 'neutral' WHEN current < 30 THEN 'fear' ELSE 'extreme-fear' END AS label,
        CASE WHEN current < 25 THEN 'extreme fear' WHEN current < 45 THEN 'fear' WHEN current > 75 THEN 'extreme greed'
          WHEN current > 55 THEN 'greed' ELSE 'neutral' END AS band FROM vg""",
    ),
)
def vol_tile(spark, sf):
    values = daily(spark, sf).select("ticker", "i", F.floor(C("close") / 8).cast("double").alias("value"))
    return br.vol_tile(values).withColumn("band", br.sentiment_band(C("current")))


@query(
    "staleness",
    q.with_ctes(
        q.BARS,
        """last AS (SELECT ticker, MAX(dt) AS last_dt FROM bars GROUP BY ticker),
        days AS (SELECT ticker, last_dt, UNNEST(GENERATE_SERIES(last_dt + 1, DATE '2001-11-09', INTERVAL 1 DAY)) AS d FROM last)""",
        select="""SELECT l.ticker, CAST(l.last_dt AS VARCHAR) AS last_dt, '2001-11-09' AS session,
        COUNT(d) FILTER (ISODOW(d) <= 5) AS stale_days FROM last l LEFT JOIN days ON days.ticker = l.ticker GROUP BY ALL""",
    ),
)
def staleness(spark, sf):
    last = daily(spark, sf).groupBy("ticker").agg(F.max("dt").alias("last_dt"))
    # Sunday evening in New York: the Friday is the latest session.
    now = F.lit("2001-11-12 01:00:00").cast("timestamp")
    last = last.withColumn("session", scalar.latest_session(now))
    stale = scalar.business_days_between(C("last_dt"), C("session"))
    return last.select("ticker", day("last_dt"), day("session"), stale.alias("stale_days"))
