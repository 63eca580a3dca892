"""Queries over intraday bars and chart patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import patterns as pt
from tapeloom.plans import sql as q
from tapeloom.plans.registry import query
from tapeloom.plans.screens import pivot_ctes
from tapeloom.plans.windows import day, rnd
from tapeloom.sources.bars import daily
from tapeloom.sources.bars import intraday as raw_bars
from tapeloom.sources.store import stored

C = F.col

# The test events all fall in January, five hours behind UTC in New York.
SESSIONS = """loc AS (SELECT ticker, t - 18000 AS time, o AS open, h AS high, l AS low, c AS close, v AS volume FROM raw),
reg AS (SELECT *, time // 86400 AS session FROM loc WHERE time % 86400 BETWEEN 34200 AND 57599),
rec AS (SELECT *, DENSE_RANK() OVER (PARTITION BY ticker ORDER BY session DESC) AS k FROM reg),
bars AS MATERIALIZED (SELECT ticker, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY time) - 1 AS i, time, open, high, low, close, volume
  FROM rec WHERE k <= 5)"""


def bars15(spark, sf):
    return pt.format_intraday(raw_bars(spark, sf))


@query("intraday_bars", q.with_ctes(q.INTRADAY, SESSIONS, select="SELECT * FROM bars"))
def intraday_bars(spark, sf):
    return bars15(spark, sf)


# Patterns are looked for on two kinds of charts: intraday bars, and each ticker's daily bars.
CHARTS = f"""src AS (SELECT ticker, i, time, open, high, low, close FROM bars
  UNION ALL SELECT 'D' || ticker, i, epoch(CAST(dt AS TIMESTAMP))::BIGINT, open, high, low, close FROM dbars),
numbered AS (SELECT ticker, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY i) - 1 AS i, time AS dt, open, high, low, close FROM src),
cb AS MATERIALIZED (SELECT *, COUNT(*) OVER (PARTITION BY ticker) AS n FROM numbered),
lastbar AS (SELECT ticker, MAX(n) AS n, ARG_MAX(close, i) AS last_close, MAX(dt) AS last_t FROM cb GROUP BY ticker),
{pivot_ctes('cb', 3, None)},
hi AS (SELECT *, LAG(pos) OVER w AS p0, LAG(value) OVER w AS v0 FROM piv WHERE kind = 'high' WINDOW w AS (PARTITION BY ticker ORDER BY pos)),
lo AS (SELECT *, LEAD(pos) OVER w AS p1, LEAD(value) OVER w AS v1, LEAD(pos, 2) OVER w AS p2, LEAD(value, 2) OVER w AS v2
  FROM piv WHERE kind = 'low' WINDOW w AS (PARTITION BY ticker ORDER BY pos))"""
TREND = """pair AS (SELECT ticker, MAX(pos) AS pos, ARG_MAX(value, pos) AS value, ARG_MAX(p0, pos) AS p0, ARG_MAX(v0, pos) AS v0
  FROM hi WHERE value < v0 GROUP BY ticker),
pr AS (SELECT p.*, n, last_close, last_t, (value - v0) / (pos - p0) AS slope FROM pair p JOIN lastbar l ON l.ticker = p.ticker),
trend AS (SELECT p.ticker, 'trendline' AS type, '下降トレンドライン' AS label, c.dt AS t1, slope * p0 + (v0 - slope * p0) AS p1, last_t AS t2,
  slope * (p.n - 1) + (v0 - slope * p0) AS p2 FROM pr p JOIN cb c ON c.ticker = p.ticker AND c.i = p.p0
  WHERE pos > p0 AND pos - p0 >= p.n * 0.15)"""
BOTTOM = """trip AS (SELECT l.ticker, l.pos, l.value, p1, v1, p2, v2, b.n, b.last_t,
  (SELECT MAX(h.value) FROM hi h WHERE h.ticker = l.ticker AND h.pos > l.pos AND h.pos < l.p1) AS n1,
  (SELECT MAX(h.value) FROM hi h WHERE h.ticker = l.ticker AND h.pos > l.p1 AND h.pos < l.p2) AS n2
  FROM lo l JOIN lastbar b ON b.ticker = l.ticker),
ihs AS (SELECT ticker, MAX(pos) AS pos, ARG_MAX((n1 + n2) / 2, pos) AS neck, 'inverse' AS kind FROM trip WHERE v1 < value AND v1 < v2
  AND ABS(value - v2) / GREATEST(ABS(value), ABS(v2)) <= 0.015 AND n1 IS NOT NULL AND n2 IS NOT NULL AND p2 - pos >= n * 0.15 GROUP BY ticker),
dbl AS (SELECT ticker, MAX(pos) AS pos, ARG_MAX(n1, pos) AS neck, 'double' AS kind FROM trip WHERE p1 IS NOT NULL
  AND ABS(value - v1) / GREATEST(ABS(value), ABS(v1)) <= 0.015 AND n1 IS NOT NULL AND p1 - pos >= n * 0.15 GROUP BY ticker),
bt AS (SELECT * FROM ihs UNION ALL SELECT * FROM dbl WHERE ticker NOT IN (SELECT ticker FROM ihs)),
bottom AS (SELECT b.ticker, 'neckline' AS type, CASE kind WHEN 'inverse' THEN '逆三尊 ネックライン' ELSE 'ダブルボトム ネックライン' END AS label,
  c.dt AS t1, neck AS p1, l.last_t AS t2, neck AS p2 FROM bt b JOIN cb c ON c.ticker = b.ticker AND c.i = b.pos JOIN lastbar l ON l.ticker = b.ticker)"""
FLAG = """pk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, kind ORDER BY pos DESC) AS k FROM piv),
fit AS (SELECT ticker, kind, MIN(pos) AS x0, MAX(pos) AS x1, REGR_SLOPE(value, pos) AS s, REGR_INTERCEPT(value, pos) AS b, AVG(value) AS my
  FROM pk WHERE k <= 3 GROUP BY ticker, kind HAVING COUNT(*) = 3),
rails AS (SELECT u.ticker, u.x0 AS ux, l.x0 AS lx, LEAST(u.x0, l.x0) AS st, GREATEST(u.x1, l.x1) AS en, u.s AS us, u.b AS ub, l.s AS ls, l.b AS lb,
  u.s / ABS(u.my) AS un, l.s / ABS(l.my) AS ln, n, last_t FROM fit u JOIN fit l ON l.ticker = u.ticker AND l.kind = 'low'
  JOIN lastbar t ON t.ticker = u.ticker WHERE u.kind = 'high'),
width AS (SELECT *, us * st + ub - ls * st - lb AS w0, us * en + ub - ls * en - lb AS w1 FROM rails WHERE en - st >= n * 0.15),
kinds AS (SELECT *, CASE WHEN un < 0 AND ln > 0 AND w0 > 0 AND w1 >= 0 AND w1 < w0 AND w1 <= w0 * 0.7 THEN 'tri'
  WHEN un BETWEEN -0.02 AND 0.0005 AND ln BETWEEN -0.02 AND 0.0005 AND ABS(un - ln) <= 0.0015 THEN 'flag' END AS kind FROM width),
flag AS (SELECT k.ticker, kind || '_upper' AS type, CASE kind WHEN 'tri' THEN '三角収束 上辺' ELSE '上昇フラッグ 上辺' END AS label,
  c.dt AS t1, us * ux + ub AS p1, last_t AS t2, us * (k.n - 1) + ub AS p2 FROM kinds k JOIN cb c ON c.ticker = k.ticker AND c.i = k.ux WHERE kind IS NOT NULL
  UNION ALL SELECT k.ticker, kind || '_lower', CASE kind WHEN 'tri' THEN '三角収束 下辺' ELSE '上昇フラッグ 下辺' END,
  c.dt, ls * lx + lb, last_t, ls * (k.n - 1) + lb FROM kinds k JOIN cb c ON c.ticker = k.ticker AND c.i = k.lx WHERE kind IS NOT NULL)"""

_BASE = (q.INTRADAY, SESSIONS, q.BARS.replace("bars AS", "dbars AS", 1), CHARTS)
_LINES = "ticker, type, label, t1, ROUND(p1, 6) AS p1, t2, ROUND(p2, 6) AS p2"


def chart_bars(spark, sf):
    """Intraday charts, and daily charts of each ticker's whole history (named D + ticker)."""
    days = daily(spark, sf).select(
        F.concat(F.lit("D"), "ticker").alias("ticker"),
        "i",
        F.unix_timestamp(C("dt").cast("timestamp")).alias("time"),
        "open",
        "high",
        "low",
        "close",
        "volume",
    )
    return stored(bars15(spark, sf).unionByName(days))


def _rounded(lines):
    return lines.withColumns({"p1": rnd("p1"), "p2": rnd("p2")})


@query("trendline", q.with_ctes(*_BASE, TREND, select=f"SELECT {_LINES} FROM trend"))
def trendline(spark, sf):
    found = pt.with_descending_pair(pt.charts(chart_bars(spark, sf))).select("ticker", pt.trendline().alias("lines"))
    return _rounded(pt.explode_lines(found))


@query(
    "break_marker",
    q.with_ctes(
        *_BASE,
        TREND,
        select="SELECT ticker, last_t AS t, 'ブレイク' AS text FROM pr WHERE last_close > value + slope * (n - 1 - pos)",
    ),
)
def break_marker(spark, sf):
    chart = pt.with_descending_pair(pt.charts(chart_bars(spark, sf)))
    found = chart.select("ticker", pt.break_marker().alias("m")).filter("m is not null")
    return found.select("ticker", C("m.time").alias("t"), "m.text")


@query("double_bottom", q.with_ctes(*_BASE, BOTTOM, select=f"SELECT {_LINES} FROM bottom"))
def double_bottom(spark, sf):
    found = pt.with_bottoms(pt.charts(chart_bars(spark, sf))).select("ticker", pt.bottoms().alias("lines"))
    return _rounded(pt.explode_lines(found))


@query("flag_triangle", q.with_ctes(*_BASE, FLAG, select=f"SELECT {_LINES} FROM flag"))
def flag_triangle(spark, sf):
    bars = chart_bars(spark, sf)
    chart = pt.with_rails(pt.charts(bars), pt.chart_pivots(bars))
    found = chart.select("ticker", pt.flag_triangle().alias("lines"))
    return _rounded(pt.explode_lines(found))


@query(
    "detect_all",
    q.with_ctes(
        *_BASE,
        TREND,
        BOTTOM,
        FLAG,
        """drawn AS (SELECT *, 1 AS pri FROM flag UNION ALL SELECT *, 2 FROM bottom UNION ALL SELECT *, 3 FROM trend),
        best AS (SELECT *, MIN(pri) OVER (PARTITION BY ticker) AS top FROM drawn)""",
        select=f"""SELECT {_LINES} FROM best WHERE pri = top
        UNION ALL SELECT ticker, 'marker', 'ブレイク', last_t, ROUND(last_close, 6), last_t, ROUND(last_close, 6)
        FROM pr WHERE last_close > value + slope * (n - 1 - pos)""",
    ),
)
def detect_all(spark, sf):
    bars = chart_bars(spark, sf)
    found = pt.detect(bars)
    last = bars.groupBy("ticker").agg(F.max_by("close", "i").alias("p1"))
    marks = found.filter("marker is not null").join(last, "ticker").select(
        "ticker",
        F.lit("marker").alias("type"),
        C("marker.text").alias("label"),
        C("marker.time").alias("t1"),
        "p1",
        C("marker.time").alias("t2"),
        C("p1").alias("p2"),
    )
    return _rounded(pt.explode_lines(found).unionByName(marks))


_PATTERN_SQL = f"CASE n % 4 WHEN 0 THEN '{pt.CUP}' WHEN 1 THEN '{pt.VCP}' WHEN 2 THEN '{pt.ASCENDING}' ELSE '{pt.FLAT}' END"


@query(
    "base_marks",
    q.with_ctes(
        q.BARS,
        f"""bm0 AS (SELECT *, COUNT(*) OVER (PARTITION BY ticker) AS n FROM bars),
        bm1 AS (SELECT *, {_PATTERN_SQL} AS pattern, LEAST(n, 40 + n % 9 + 5) AS m, n % 2 = 0 AS breakout FROM bm0),
        bm2 AS (SELECT *, i - (n - m) AS pos, GREATEST(5, m // 4) AS seg FROM bm1 WHERE i >= n - m),
        bm3 AS (SELECT *, pos // seg AS part, high - low AS height, FIRST_VALUE(pos) OVER (PARTITION BY ticker ORDER BY low, pos) AS bottom,
          ROW_NUMBER() OVER (PARTITION BY ticker, pos // seg ORDER BY high - low, pos) AS tk,
          pos >= 3 AND pos < m - 3 AND low = MIN(low) OVER (PARTITION BY ticker ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS swing,
          GREATEST(0, m - m // 4) AS handle FROM bm2),
        bm4 AS (SELECT *, COUNT(*) FILTER (swing) OVER (PARTITION BY ticker ORDER BY i ROWS UNBOUNDED PRECEDING) AS no FROM bm3),
        marks AS (
          SELECT ticker, dt, '{pt.MARKS['bottom']}' AS label FROM bm4 WHERE pattern = '{pt.CUP}' AND pos = bottom
          UNION ALL SELECT ticker, dt, '{pt.MARKS['rim']}' FROM bm4 WHERE pattern = '{pt.CUP}' AND pos = 0
          UNION ALL SELECT ticker, dt, '{pt.MARKS['handle']}' FROM bm4 WHERE pattern = '{pt.CUP}' AND pos = handle AND handle > bottom
          UNION ALL SELECT ticker, dt, 'T' || (part + 1) FROM bm4 WHERE pattern = '{pt.VCP}' AND tk = 1 AND part * seg < m - seg
          UNION ALL SELECT ticker, dt, 'L' || no FROM bm4 WHERE pattern = '{pt.ASCENDING}' AND swing
          UNION ALL SELECT ticker, dt, '{pt.MARKS['start']}' FROM bm4 WHERE pattern = '{pt.FLAT}' AND pos = 0
          UNION ALL SELECT ticker, dt, m || '日' FROM bm4 WHERE pattern = '{pt.FLAT}' AND pos = m - 1
          UNION ALL SELECT ticker, dt, '{pt.MARKS['break']}' FROM bm4 WHERE breakout AND pos = m - 1
          UNION ALL SELECT ticker, dt, pattern FROM bm4 WHERE pos = m // 2)""",
        select="SELECT ticker, CAST(dt AS VARCHAR) AS dt, label FROM marks",
    ),
)
def base_marks(spark, sf):
    bars = daily(spark, sf)
    n = C("n")
    bases = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).select(
        "ticker",
        F.when(n % 4 == 0, pt.CUP).when(n % 4 == 1, pt.VCP).when(n % 4 == 2, pt.ASCENDING).otherwise(pt.FLAT).alias("pattern"),
        (n % 9 + 40).alias("base_length"),
        (n % 2 == 0).alias("breakout"),
    )
    return pt.base_marks(bars, bases).select("ticker", day(), "label")
