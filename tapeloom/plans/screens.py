"""Queries of the staged screen and of single-ticker summaries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tapeloom.operators import daily_screen as ds
from tapeloom.operators import screen as sc
from tapeloom.operators.volume import volume_assessment
from tapeloom.plans import sql as q
from tapeloom.plans.registry import query
from tapeloom.plans.windows import ADX_CTES, MACD_CTES, RSI_SIMPLE, TIGHT, day, rnd
from tapeloom.sources import feeds, store
from tapeloom.sources.bars import daily
from tapeloom.sources.store import stored

C = F.col

# The test tables hold 500 to 2,500 days of small volumes, so the gates are set lower.
PARAMS = sc.ScreenParams(min_history=500, min_dollar_volume=1_000.0, max_stale_days=30)

TAIL = "tail_rows AS (SELECT *, COUNT(*) OVER (PARTITION BY ticker) AS n, COUNT(*) OVER (PARTITION BY ticker) - i AS back FROM bars)"

LIQUID = """liq AS (
  SELECT ticker, MAX(n) AS n, MAX(dt) AS last_dt, QUANTILE_CONT(close * volume, 0.5) AS dollar_vol,
         ARG_MAX(close, i) AS price
  FROM tail_rows WHERE back <= 60 GROUP BY ticker)"""

WEEKLY = f"""wk AS (
  SELECT ticker, CAST(DATE_TRUNC('week', dt + 2) AS DATE) AS week, ARG_MAX(close, dt) AS close
  FROM bars GROUP BY 1, 2),
wk1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY week) - 1 AS i FROM wk),
wk2 AS (SELECT *, {q.full('AVG', 'close', 20)} AS m20, {q.full('AVG', 'close', 50)} AS m50,
  {q.full('AVG', 'close', 200)} AS m200 FROM wk1),
wk3 AS (SELECT *, {q.lag('m20', 4)} AS m20_4, {q.lag('m50', 4)} AS m50_4, {q.lag('m200', 4)} AS m200_4 FROM wk2),
wk4 AS (SELECT *, COALESCE(close > m20 AND m20 > m50 AND m50 > m200 AND m20 > m20_4 AND m50 > m50_4
  AND m200 > m200_4, FALSE) AS ok FROM wk3),
weekly AS (SELECT ticker, COUNT(*) AS weeks,
  CASE WHEN COUNT(*) < 210 THEN 0 ELSE COUNT(*) - 1 - COALESCE(MAX(i) FILTER (NOT ok), -1) END AS po_weeks
  FROM wk4 GROUP BY ticker)"""

DIP = ",\n".join(
    [
        q.ema("tail_rows", "dip_e", {"ema20": q.span("close", 20)}),
        """dip0 AS (SELECT ticker, MIN(back) FILTER (low <= ema20 * 1.02) AS touch_days_ago,
  ARG_MAX(close, i) AS close, ARG_MAX(open, i) AS open, ARG_MAX(ema20, i) AS ema20
  FROM dip_e WHERE back <= 3 GROUP BY ticker),
dip AS (SELECT ticker, touch_days_ago, close > open AS bounced, ema20, close / ema20 - 1 AS ema20_dist
  FROM dip0 WHERE touch_days_ago IS NOT NULL AND close > ema20)""",
    ]
)

STRENGTH = """rets AS (SELECT ticker, ARG_MAX(close, i) / MAX(close) FILTER (back = 64) - 1 AS ret63,
  ARG_MAX(close, i) / MAX(close) FILTER (back = 127) - 1 AS ret126 FROM tail_rows WHERE back <= 127 GROUP BY ticker),
strength AS (SELECT ticker, ret63 - (SELECT ret63 FROM rets WHERE ticker = 'MKT') AS rs63,
  ret126 - (SELECT ret126 FROM rets WHERE ticker = 'MKT') AS rs126 FROM rets)"""


def pivot_ctes(src: str, k: int, lookback: int | None) -> str:
    size = "n" if lookback is None else f"LEAST(n, {lookback})"
    return f"""pv0 AS (SELECT *, MAX(high) OVER ({q.W} ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS mh,
  MIN(low) OVER ({q.W} ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS ml,
  i - (n - {size}) AS pos, {size} AS size FROM {src}),
piv AS MATERIALIZED (
  SELECT ticker, dt, i, pos, 'high' AS kind, high AS value FROM pv0 WHERE high = mh AND pos >= {k} AND pos < size - {k}
  UNION ALL
  SELECT ticker, dt, i, pos, 'low', low FROM pv0 WHERE low = ml AND pos >= {k} AND pos < size - {k})"""


PIVOTS = pivot_ctes("tail_rows", 5, 300)
DOW = """lp0 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, kind ORDER BY i DESC) AS k FROM piv),
lp AS (SELECT ticker, MAX(value) FILTER (kind = 'high' AND k = 1) AS high_1,
  MAX(value) FILTER (kind = 'high' AND k = 2) AS high_2, MAX(value) FILTER (kind = 'low' AND k = 1) AS low_1,
  MAX(value) FILTER (kind = 'low' AND k = 2) AS low_2 FROM lp0 WHERE k <= 2 GROUP BY ticker),
dow AS (SELECT t.ticker, high_1, low_1, CASE WHEN high_1 IS NULL OR high_2 IS NULL OR low_1 IS NULL OR low_2 IS NULL
  THEN 'unknown' WHEN high_1 > high_2 AND low_1 > low_2 THEN 'up'
  WHEN high_1 < high_2 AND low_1 < low_2 THEN 'down' ELSE 'neutral' END AS dow_trend
  FROM (SELECT DISTINCT ticker FROM bars) t LEFT JOIN lp ON lp.ticker = t.ticker)"""

BAND = """vb0 AS (SELECT *, MIN(close) OVER (PARTITION BY ticker) AS lo, MAX(close) OVER (PARTITION BY ticker) AS hi
  FROM tail_rows WHERE back <= 60),
vb1 AS (SELECT *, LEAST(COALESCE(FLOOR((close - lo) / NULLIF(hi - lo, 0) * 20), 0), 19) AS bin FROM vb0),
vb2 AS (SELECT ticker, bin, SUM(volume) AS total, MIN(lo) AS lo, MAX(hi) AS hi FROM vb1 GROUP BY ticker, bin),
vb3 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY total DESC, bin) AS k FROM vb2),
band AS (SELECT ticker, CASE WHEN hi = lo THEN lo ELSE lo + bin * ((hi - lo) / 20) END AS band_low,
  CASE WHEN hi = lo THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 20) END AS band_high FROM vb3 WHERE k = 1)"""

VOLUME = ",\n".join(
    [
        q.MOVES.replace("moves AS", "vmoves AS"),
        q.ema("vmoves", "va", {"vatr": q.wilder("tr")}),
        f"""vo0 AS (SELECT *, {q.full('AVG', 'volume', 50)} AS vol50, COUNT(*) OVER (PARTITION BY ticker) AS n FROM va),
vo1 AS (SELECT *, MIN(close) OVER {q.rows(60)} AS rl, MAX(close) OVER {q.rows(60)} AS rh,
  AVG(volume) OVER {q.rows(5)} AS vn, AVG(volume) OVER {q.rows(5, 5)} AS vb,
  AVG(high - low) OVER {q.rows(5)} AS rn, AVG(high - low) OVER {q.rows(5, 5)} AS rb,
  {q.lag('close', 5)} AS wc, COUNT(*) FILTER (vol50 > 0) OVER {q.rows(5)} AS wk_n,
  COUNT(*) FILTER (close > open) OVER {q.rows(5)} AS up_days FROM vo0),
vo2 AS (SELECT v.*, d.bounced, volume / NULLIF(vol50, 0) AS today, vn / NULLIF(vb, 0) AS wv, close / NULLIF(wc, 0) - 1 AS chg,
  CASE WHEN rh > rl THEN GREATEST(LEAST((close - rl) / (rh - rl), 1), 0) ELSE 0.5 END AS zone
  FROM vo1 v LEFT JOIN dip d ON d.ticker = v.ticker WHERE i = n - 1),
vo3 AS (SELECT *, CASE WHEN zone >= 0.7 THEN 'high' WHEN zone <= 0.3 THEN 'low' ELSE 'mid' END AS price_zone FROM vo2),
vol AS (SELECT *, CASE
  WHEN price_zone = 'low' AND close < open AND open - close >= vatr AND today >= 2 THEN 'selling_climax'
  WHEN price_zone = 'low' AND close > open AND today >= 1.5 THEN 'accumulation'
  WHEN price_zone = 'high' AND wv >= 1.2 AND chg <= 0.01 THEN 'distribution'
  WHEN chg <= -0.02 AND wv >= 1.2 THEN 'selling_pressure'
  WHEN bounced AND today >= 1.2 THEN 'bounce_confirmed'
  WHEN bounced AND today < 0.8 THEN 'weak_bounce'
  WHEN chg < 0 AND wv <= 0.8 THEN 'healthy_pullback'
  WHEN wv <= 0.8 AND rn < rb THEN 'quiet_setup'
  WHEN NOT bounced AND today <= 0.8 THEN 'healthy_pullback'
  ELSE 'neutral' END AS verdict FROM vo3
  WHERE n >= 60 AND vol50 > 0 AND wv IS NOT NULL AND chg IS NOT NULL AND wk_n = 5)""",
    ]
)

GATES = f"""gates0 AS (SELECT l.*, n >= {PARAMS.min_history}
    AND (SELECT MAX(dt) FROM bars) - last_dt <= {PARAMS.max_stale_days} AS universe FROM liq l),
gates1 AS (SELECT g.*, w.po_weeks, d.touch_days_ago, d.bounced, d.ema20, d.ema20_dist,
    universe AND dollar_vol >= {PARAMS.min_dollar_volume} AND price >= {PARAMS.min_price} AS liquid
  FROM gates0 g LEFT JOIN weekly w ON w.ticker = g.ticker LEFT JOIN dip d ON d.ticker = g.ticker),
gates AS (SELECT *, liquid AND COALESCE(po_weeks > 0, FALSE) AS po,
    liquid AND COALESCE(po_weeks > 0, FALSE) AND touch_days_ago IS NOT NULL AS dip FROM gates1)"""


@query(
    "fresh_tickers",
    q.with_ctes(
        q.BARS,
        select="""SELECT ticker, COUNT(*) AS n, CAST(MAX(dt) AS VARCHAR) AS last_dt,
        (SELECT MAX(dt) FROM bars) - MAX(dt) <= 3 AS fresh FROM bars GROUP BY ticker""",
    ),
)
def fresh_tickers(spark, sf):
    return sc.fresh_tickers(daily(spark, sf), 3).select("ticker", "n", day("last_dt"), "fresh")


@query(
    "liquidity_gate",
    q.with_ctes(
        q.BARS,
        TAIL,
        LIQUID,
        select="""SELECT ticker, ROUND(dollar_vol, 5) AS dollar_vol, price,
        dollar_vol >= 25000 AND price >= 5 AS liquid FROM liq""",
    ),
)
def liquidity_gate(spark, sf):
    p = sc.ScreenParams(min_dollar_volume=25_000.0)
    return sc.liquidity_gate(daily(spark, sf), p).select(
        "ticker", F.round("dollar_vol", 5).alias("dollar_vol"), "price", "liquid"
    )


@query("weekly_po", q.with_ctes(q.BARS, WEEKLY, select="SELECT ticker, weeks, po_weeks FROM weekly"))
def weekly_po(spark, sf):
    return sc.weekly_order(daily(spark, sf))


@query(
    "dip_check",
    q.with_ctes(
        q.BARS,
        TAIL,
        DIP,
        select="""SELECT ticker, touch_days_ago, bounced, ROUND(ema20, 4) AS ema20,
        ROUND(ema20_dist, 6) AS ema20_dist FROM dip""",
    ),
)
def dip_check(spark, sf):
    return sc.dip_check(daily(spark, sf)).select(
        "ticker", "touch_days_ago", "bounced", rnd("ema20", 4).alias("ema20"), rnd("ema20_dist").alias("ema20_dist")
    )


@query("relative_strength", q.with_ctes(q.BARS, TAIL, STRENGTH, select="SELECT * FROM strength"))
def relative_strength(spark, sf):
    return sc.relative_strength(daily(spark, sf), "MKT")


@query(
    "pivots",
    q.with_ctes(
        q.BARS, TAIL, PIVOTS, select="SELECT ticker, CAST(dt AS VARCHAR) AS dt, pos, kind, value FROM piv"
    ),
)
def pivots(spark, sf):
    return sc.pivots(daily(spark, sf)).select("ticker", day(), "pos", "kind", "value")


@query("dow_trend", q.with_ctes(q.BARS, TAIL, PIVOTS, DOW, select="SELECT ticker, dow_trend FROM dow"))
def dow_trend(spark, sf):
    bars = daily(spark, sf)
    names = bars.select("ticker").distinct()
    return names.join(sc.last_pivots(sc.pivots(bars)), "ticker", "left").select(
        "ticker", sc.dow_trend().alias("dow_trend")
    )


@query("volume_band", q.with_ctes(q.BARS, TAIL, BAND, select="SELECT ticker, ROUND(band_low, 6) AS band_low, ROUND(band_high, 6) AS band_high FROM band"))
def volume_band(spark, sf):
    return sc.volume_band(daily(spark, sf)).select("ticker", rnd("band_low").alias("band_low"), rnd("band_high").alias("band_high"))


@query(
    "volume_verdict",
    q.with_ctes(
        q.BARS,
        TAIL,
        DIP,
        VOLUME,
        select="""SELECT ticker, price_zone, verdict, ROUND(zone, 6) + 0 AS zone_pct, ROUND(today, 6) AS today,
        ROUND(wv, 6) AS week_vol, ROUND(chg, 6) + 0 AS week_chg, up_days FROM vol""",
    ),
)
def volume_verdict(spark, sf):
    bars = stored(daily(spark, sf))
    found = volume_assessment(bars, sc.dip_check(bars).select("ticker", "bounced")).filter("volume is not null")
    ups = F.size(F.filter("volume.week_bars", lambda b: b["up"])).cast("bigint")
    return found.select(
        "ticker",
        "volume.price_zone",
        "volume.verdict",
        rnd("volume.zone_pct").alias("zone_pct"),
        rnd("volume.vol_ratio_today").alias("today"),
        rnd("volume.week_vol_ratio").alias("week_vol"),
        rnd("volume.week_price_chg").alias("week_chg"),
        ups.alias("up_days"),
    )


_SCREEN_CTES = (q.BARS, TAIL, LIQUID, WEEKLY, DIP, GATES)


@query(
    "screen_funnel",
    q.with_ctes(
        *_SCREEN_CTES,
        select="""SELECT COUNT(*) FILTER (universe) AS universe, COUNT(*) FILTER (liquid) AS liquid,
        COUNT(*) FILTER (po) AS po, COUNT(*) FILTER (dip) AS dip FROM gates""",
    ),
)
def screen_funnel(spark, sf):
    return sc.funnel(sc.gates(stored(daily(spark, sf)), PARAMS))


_SCREENED = (
    *_SCREEN_CTES[1:],
    ADX_CTES,
    STRENGTH,
    PIVOTS,
    DOW,
    BAND,
    VOLUME,
    "last_adx AS (SELECT ticker, ARG_MAX(adx, i) AS adx, ARG_MAX(atr, i) AS atr FROM adx_rows GROUP BY ticker)",
)
_SCREEN_SELECT = """SELECT g.ticker, g.price, CASE WHEN g.bounced THEN 'bounced' ELSE 'pulling' END AS state,
  g.touch_days_ago, dow_trend, ROUND(adx, 4) AS adx, rs63, rs126, ROUND(atr / g.price, 6) AS atr_pct,
  ROUND(g.dollar_vol, 5) AS dollar_vol, ROUND(g.ema20_dist, 6) AS ema20_dist, g.po_weeks,
  v.verdict, v.price_zone, ROUND(g.ema20, 4) AS ema20, high_1 AS swing_high, low_1 AS swing_low,
  ROUND(band_low, 6) AS band_low, ROUND(band_high, 6) AS band_high
  FROM gates g JOIN last_adx a ON a.ticker = g.ticker JOIN strength s ON s.ticker = g.ticker
  JOIN dow ON dow.ticker = g.ticker JOIN band b ON b.ticker = g.ticker
  LEFT JOIN vol v ON v.ticker = g.ticker WHERE g.dip"""
# The stored table after a feed of corrections and a cut to the last six years, numbered anew.
_STORE_CTES = (
    q.BARS.replace("bars AS", "base AS", 1),
    """cut AS (SELECT ticker, CAST(MAX(dt) - INTERVAL 72 MONTH AS DATE) AS from_dt FROM base GROUP BY ticker),
bars AS MATERIALIZED (SELECT b.* REPLACE (ROW_NUMBER() OVER (PARTITION BY b.ticker ORDER BY dt) - 1 AS i,
  CASE WHEN i % 50 = 0 THEN close * 1.001 ELSE close END AS close) FROM base b JOIN cut ON cut.ticker = b.ticker WHERE dt >= from_dt)""",
)


def _screened(bars):
    return sc.screen(bars, "MKT", PARAMS).select(
        "ticker",
        "price",
        "state",
        "touch_days_ago",
        "dow_trend",
        rnd("adx", 4).alias("adx"),
        "rs63",
        "rs126",
        rnd("atr_pct").alias("atr_pct"),
        F.round("dollar_vol", 5).alias("dollar_vol"),
        rnd("ema20_dist").alias("ema20_dist"),
        "po_weeks",
        "volume.verdict",
        "volume.price_zone",
        rnd("levels.ema20", 4).alias("ema20"),
        "levels.swing_high",
        "levels.swing_low",
        rnd(C("levels.vol_band")[0]).alias("band_low"),
        rnd(C("levels.vol_band")[1]).alias("band_high"),
    )


@query("screen", q.with_ctes(_SCREEN_CTES[0], *_SCREENED, select=_SCREEN_SELECT))
def screen(spark, sf):
    return _screened(stored(daily(spark, sf)))


@query("store_screen", q.with_ctes(*_STORE_CTES, *_SCREENED, select=_SCREEN_SELECT))
def store_screen(spark, sf):
    """From feed to screen: corrections are taken in twice, upserted, cut to six years and screened."""
    bars = daily(spark, sf)
    raw = bars.filter(C("i") % 50 == 0).select(
        F.concat(F.lit(" "), F.lower("ticker")).alias("T"), "dt", C("open").alias("o"), C("high").alias("h"), C("low").alias("l"),
        (C("close") * 1.001).alias("c"), C("volume").alias("v"),
    )
    feed = feeds.ingest_grouped(raw.unionByName(raw), bars.select("ticker").distinct())
    feed = feed.withColumns({"i": F.lit(None).cast("bigint"), "volume": C("volume").cast("double"), "batch": F.lit(1)})
    held = store.upsert_known(bars.withColumn("batch", F.lit(0)), feed, "batch").drop("batch")
    return _screened(stored(store.trim_history(held)))


STAGE2 = ",\n".join(
    [
        RSI_SIMPLE,
        MACD_CTES.replace("mf_x AS (SELECT *", "mf_x AS (SELECT *").replace("FROM bars)", "FROM rsi_rows)"),
        f"""s2a AS (SELECT *, {TIGHT} AS tight, {q.full('AVG', 'close', 50)} AS sma50,
  {q.full('AVG', 'close', 200)} AS sma200, {q.full('AVG', 'volume', 50)} AS vol50,
  MAX(high) OVER {q.rows(252)} AS h52, COUNT(*) OVER (PARTITION BY ticker) AS n FROM macd_rows),
s2 AS MATERIALIZED (SELECT *, COALESCE(close > sma50 AND sma50 > sma200 AND rsi BETWEEN 40 AND 70 AND macd > macd_signal
  AND close / h52 - 1 >= -0.15 AND (volume < vol50 OR tight), FALSE) AS stage2 FROM s2a)""",
    ]
)


@query("stage2_flag", q.with_ctes(q.BARS, STAGE2, select="SELECT ticker, stage2 FROM s2 WHERE i = n - 1"))
def stage2_flag(spark, sf):
    return sc.stage2(daily(spark, sf)).select("ticker", "stage2")


SUMMARY = ",\n".join(
    [
        STAGE2,
        q.ema("s2", "se", {"ema10": q.span("close", 10), "ema21": q.span("close", 21)}),
        f"""su0 AS (SELECT *, {q.full('AVG', 'close', 20)} AS sma20, {q.full('AVG', 'volume', 20)} AS vol20,
  MIN(low) OVER {q.rows(252)} AS l52, {q.full('AVG', 'tr', 14)} AS atr0, MIN(low) OVER {q.rows(20)} AS low20,
  MAX(high) OVER {q.rows(100)} AS h100, {q.lag('close')} AS before FROM se),
su1 AS (SELECT *, COALESCE(atr0, 0) AS atr FROM su0 WHERE i = n - 1 AND n >= 60),
su2 AS (SELECT *, LEAST(GREATEST(low20, close - atr * 2), close - atr) AS stop,
  CASE WHEN h100 <= close THEN close + atr * 3 ELSE h100 END AS target FROM su1),
su3 AS (SELECT *, close - stop AS risk, (target - close) / (close - stop) AS rr,
  COALESCE(close > sma50 AND sma50 > sma200, FALSE) AS up, (close / h52 - 1) * 100 AS pfh,
  COALESCE(volume / NULLIF(vol20, 0), 0) AS vr FROM su2 WHERE close - stop > 0)""",
    ]
)


@query(
    "stock_summary",
    q.with_ctes(
        q.BARS,
        SUMMARY,
        select="""SELECT ticker, close AS price, ROUND((close - before) / before * 100, 6) + 0 AS change_pct,
        ROUND(vr, 6) AS vol_ratio, ROUND(sma200, 7) AS sma200, ROUND(ema21, 4) AS ema21, ROUND(rsi, 4) + 0 AS rsi,
        ROUND(macd, 4) + 0 AS macd, ROUND(atr, 4) AS atr, h52 AS high_52w, l52 AS low_52w,
        ROUND(pfh, 6) + 0 AS pct_from_high, up AS stage2_uptrend, tight AS vcp_tightening,
        COALESCE(volume < vol50, FALSE) AS vol_contraction, ROUND(stop, 4) AS stop, ROUND(target, 4) AS target,
        CASE WHEN h100 <= close THEN 'atr' ELSE 'high' END AS target_source, ROUND(rr, 5) AS rr,
        CASE WHEN rr >= 2 THEN 'Tier1' WHEN rr >= 1.5 THEN 'Tier2' ELSE 'REJECTED' END AS tier,
        CASE WHEN rr >= 2 AND up THEN 'BUY' WHEN rr >= 1.5 AND up THEN 'WATCH' ELSE 'NO-BUY' END AS verdict,
        1 + up::INT + COALESCE(ROUND(rsi, 2) BETWEEN 40 AND 70, FALSE)::INT + (macd > macd_signal)::INT
          + (ROUND(ABS(pfh), 2) <= 15)::INT + tight::INT + COALESCE(volume < vol50, FALSE)::INT
          + (ROUND(vr, 2) >= 1.5)::INT AS n_reasons,
        COALESCE(ROUND(rsi, 2) > 65, FALSE)::INT + (ROUND(ABS(pfh), 2) > 10)::INT + (NOT tight)::INT
          + (vr > 0 AND ROUND(vr, 2) < 0.5)::INT + (ROUND(rr, 2) < 2)::INT AS n_risks
        FROM su3""",
    ),
)
def stock_summary(spark, sf):
    s = sc.stock_summary(daily(spark, sf))
    return s.select(
        "ticker",
        "price",
        *[rnd(c).alias(c) for c in ("change_pct", "vol_ratio", "pct_from_high")],
        F.round("sma200", 7).alias("sma200"),
        *[rnd(c, 4).alias(c) for c in ("ema21", "rsi", "macd", "atr", "stop", "target")],
        "high_52w",
        "low_52w",
        "stage2_uptrend",
        "vcp_tightening",
        "vol_contraction",
        "target_source",
        rnd("rr", 5).alias("rr"),
        "tier",
        "verdict",
        F.size("reasons").alias("n_reasons"),
        F.size("risks").alias("n_risks"),
    )


@query(
    "drawdown",
    q.with_ctes(
        q.BARS,
        select=f"""SELECT ticker, CAST(dt AS VARCHAR) AS dt,
        close / MAX(close) OVER ({q.W} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM bars""",
    ),
)
def drawdown(spark, sf):
    from tapeloom.operators.series import drawdown as dd

    return daily(spark, sf).select("ticker", day(), dd(C("close")).alias("drawdown"))


AS_OF = f"""day_rows AS (
  SELECT ticker, dt, i, open, low, close, volume, CAST(DATE_TRUNC('week', dt + 2) AS DATE) AS week,
    LEAD(dt) OVER (PARTITION BY ticker ORDER BY i) AS next_dt FROM bars),
ended AS (
  SELECT ticker, week, ARG_MAX(close, dt) AS close, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY week) AS w
  FROM day_rows GROUP BY ticker, week),
placed_rows AS (SELECT d.*, e.w FROM day_rows d JOIN ended e ON e.ticker = d.ticker AND e.week = d.week),
sums AS (
  SELECT p.ticker, p.i, {", ".join(f"SUM(e.close) FILTER (e.w > p.w - {n}) AS s{n}, SUM(e.close) FILTER (e.w BETWEEN p.w - {n + 3} AND p.w - 4) AS b{n}" for n in (20, 50, 200))}
  FROM placed_rows p JOIN ended e ON e.ticker = p.ticker AND e.w < p.w AND e.w >= p.w - 203 GROUP BY p.ticker, p.i),
orders AS (
  SELECT p.ticker, p.i, p.w >= 210 AND close > (s20 + close) / 20 AND (s20 + close) / 20 > (s50 + close) / 50
    AND (s50 + close) / 50 > (s200 + close) / 200 AND (s20 + close) / 20 > b20 / 20 AND (s50 + close) / 50 > b50 / 50
    AND (s200 + close) / 200 > b200 / 200 AS ordered
  FROM placed_rows p LEFT JOIN sums s ON s.ticker = p.ticker AND s.i = p.i),
{q.ema("day_rows", "day_e", {"ema20": q.span("close", 20)})},
judged AS (
  SELECT e.*, o.ordered, low <= ema20 * {PARAMS.touch_band} AS touched,
    QUANTILE_CONT(close * volume, 0.5) OVER {q.rows(PARAMS.dollar_window)} AS dollar_vol,
    close / LAG(close, 126) OVER ({q.W}) - 1 AS ret FROM day_e e JOIN orders o USING (ticker, i)),
strength_of AS (
  SELECT j.*, COALESCE(j.ret > m.ret, FALSE) AS strong,
    BOOL_OR(j.touched) OVER (PARTITION BY j.ticker ORDER BY j.i ROWS BETWEEN {PARAMS.touch_rows - 1} PRECEDING AND CURRENT ROW) AS lately
  FROM judged j LEFT JOIN judged m ON m.ticker = 'MKT' AND m.dt = j.dt),
flags AS MATERIALIZED (
  SELECT ticker, dt, LEAST(dt + {PARAMS.max_stale_days}, next_dt - 1) AS until, i + 1 >= {PARAMS.min_history} AS universe,
    i + 1 >= {PARAMS.min_history} AND dollar_vol >= {PARAMS.min_dollar_volume} AND close >= {PARAMS.min_price} AS liquid,
    COALESCE(ordered, FALSE) AS ordered, lately AND close > ema20 AS dipped, touched AND close > ema20 AND close > open AND strong AS strict
  FROM strength_of),
calendar AS (SELECT DISTINCT dt FROM bars),
per_day AS MATERIALIZED (
  SELECT c.dt, COUNT(*) FILTER (universe) AS universe, COUNT(*) FILTER (liquid) AS liquid, COUNT(*) FILTER (liquid AND ordered) AS po,
    COUNT(*) FILTER (liquid AND ordered AND dipped) AS dip, COUNT(*) FILTER (liquid AND ordered AND strict) AS strict
  FROM calendar c LEFT JOIN flags f ON f.dt <= c.dt AND f.until >= c.dt GROUP BY c.dt)"""


@query(
    "funnel_per_day",
    q.with_ctes(q.BARS, AS_OF, select="SELECT CAST(dt AS VARCHAR) AS dt, universe, liquid, po, dip FROM per_day"),
)
def funnel_per_day(spark, sf):
    per_day = ds.funnel_per_day(ds.gates_as_of(daily(spark, sf), PARAMS))
    return per_day.select(day(), *ds.GATES)


@query(
    "candidates_per_day",
    q.with_ctes(
        q.BARS,
        AS_OF,
        select=" UNION ALL ".join(
            f"""SELECT '{kind}' AS kind, COUNT(*) AS days, QUANTILE_CONT({c}, 0.5) AS median, QUANTILE_CONT({c}, 0.1) AS p10,
        QUANTILE_CONT({c}, 0.9) AS p90, ROUND(AVG({c}), 6) AS mean, ROUND(AVG(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END), 6) AS none_share FROM per_day"""
            for kind, c in (("window", "dip"), ("strict", "strict"))
        ),
    ),
)
def candidates_per_day(spark, sf):
    """Both forms of the dip: touched within three rows; or on the day, on a rising day of a strong ticker."""
    bars = stored(daily(spark, sf))
    forms = {
        "window": ds.gates_as_of(bars, PARAMS),
        "strict": ds.gates_as_of(bars, replace(PARAMS, touch_rows=1), rising=True, benchmark="MKT"),
    }
    found = [
        ds.distribution(ds.funnel_per_day(gated)).select(
            F.lit(kind).alias("kind"), "days", "median", "p10", "p90", rnd("mean").alias("mean"), rnd("none_share").alias("none_share")
        )
        for kind, gated in forms.items()
    ]
    return found[0].unionByName(found[1])
