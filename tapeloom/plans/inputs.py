"""Derived input tables that several queries share, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import rolling as r
from tapeloom.plans import sql as q

C = F.col


def picks(bars: DataFrame) -> DataFrame:
    """A pick history: every bar closing above its 20-bar mean after touching it."""
    gain, loss = r.gain_loss()
    df = bars.withColumns(
        {
            "m20": r.sma(C("close"), 20),
            "ret": r.change(C("close"), 126),
            "up": F.sum(gain).over(r.last_rows(14)),
            "dn": F.sum(loss).over(r.last_rows(14)),
            "h1": F.max("high").over(r.last_rows(20)),
            "h2": F.max("high").over(r.last_rows(20, skip=20)),
            "l1": F.min("low").over(r.last_rows(20)),
            "l2": F.min("low").over(r.last_rows(20, skip=20)),
            "v20": r.sma(C("volume"), 20),
            "lo60": F.min("close").over(r.last_rows(60)),
            "hi60": F.max("close").over(r.last_rows(60)),
        }
    )
    df = df.filter((C("i") >= 126) & (C("close") > C("m20")) & (C("low") <= C("m20") * 1.02))
    busy = C("volume") / C("v20")
    zone = F.try_divide(C("close") - C("lo60"), C("hi60") - C("lo60"))
    return df.select(
        C("dt").alias("scan_date"),
        "ticker",
        C("i").alias("id"),
        C("close").alias("price"),
        F.when(C("close") > C("open"), F.lit("bounced")).otherwise(F.lit("pulling")).alias("state"),
        F.when((C("h1") > C("h2")) & (C("l1") > C("l2")), F.lit("up"))
        .when((C("h1") < C("h2")) & (C("l1") < C("l2")), F.lit("down"))
        .otherwise(F.lit("neutral"))
        .alias("dow_trend"),
        F.when(C("i") % 11 != 0, F.try_divide(100 * F.abs(C("up") - C("dn")), C("up") + C("dn"))).alias("adx"),
        F.when(C("i") % 7 != 0, C("ret")).alias("rs126"),
        (C("close") * C("volume")).alias("dollar_vol"),
        F.floor(C("i") / 5).alias("po_weeks"),
        F.when(
            C("i") % 5 != 0,
            F.struct(
                F.when(busy >= 1.5, F.lit("accumulation"))
                .when(busy >= 1.2, F.lit("bounce_confirmed"))
                .when(busy < 0.5, F.lit("quiet_setup"))
                .when(busy < 0.8, F.lit("healthy_pullback"))
                .otherwise(F.lit("neutral"))
                .alias("verdict"),
                F.when(zone >= 0.7, F.lit("high")).when(zone <= 0.3, F.lit("low")).otherwise(F.lit("mid")).alias("price_zone"),
            ),
        ).alias("volume"),
        F.struct(
            C("m20").alias("ema20"),
            F.when(C("i") % 3 != 0, C("h1")).alias("swing_high"),
            C("l1").alias("swing_low"),
            F.when(C("i") % 4 != 0, F.array("lo60", "hi60")).alias("vol_band"),
        ).alias("levels"),
    )


PICKS = f"""pk0 AS (SELECT *, {q.full('AVG', 'close', 20)} AS m20, close / {q.lag('close', 126)} - 1 AS ret,
  {q.lag('close')} AS pc, MAX(high) OVER {q.rows(20)} AS h1, MAX(high) OVER {q.rows(20, 20)} AS h2,
  MIN(low) OVER {q.rows(20)} AS l1, MIN(low) OVER {q.rows(20, 20)} AS l2, {q.full('AVG', 'volume', 20)} AS v20,
  MIN(close) OVER {q.rows(60)} AS lo60, MAX(close) OVER {q.rows(60)} AS hi60 FROM bars),
pk1 AS (SELECT *, SUM(GREATEST(close - pc, 0)) OVER {q.rows(14)} AS up, SUM(GREATEST(pc - close, 0)) OVER {q.rows(14)} AS dn,
  volume / v20 AS busy, (close - lo60) / NULLIF(hi60 - lo60, 0) AS zone FROM pk0),
picks AS MATERIALIZED (SELECT dt AS scan_date, ticker, i AS id, close AS price,
  CASE WHEN close > open THEN 'bounced' ELSE 'pulling' END AS state,
  CASE WHEN h1 > h2 AND l1 > l2 THEN 'up' WHEN h1 < h2 AND l1 < l2 THEN 'down' ELSE 'neutral' END AS dow_trend,
  CASE WHEN i % 11 <> 0 THEN 100 * ABS(up - dn) / NULLIF(up + dn, 0) END AS adx,
  CASE WHEN i % 7 <> 0 THEN ret END AS rs126, close * volume AS dollar_vol, i // 5 AS po_weeks,
  i % 5 <> 0 AS has_volume,
  CASE WHEN i % 5 = 0 THEN NULL WHEN busy >= 1.5 THEN 'accumulation' WHEN busy >= 1.2 THEN 'bounce_confirmed'
    WHEN busy < 0.5 THEN 'quiet_setup' WHEN busy < 0.8 THEN 'healthy_pullback' ELSE 'neutral' END AS verdict,
  CASE WHEN i % 5 = 0 THEN NULL WHEN zone >= 0.7 THEN 'high' WHEN zone <= 0.3 THEN 'low' ELSE 'mid' END AS price_zone,
  m20, CASE WHEN i % 3 <> 0 THEN h1 END AS swing_high, l1 AS swing_low,
  CASE WHEN i % 4 <> 0 THEN lo60 END AS band_low, CASE WHEN i % 4 <> 0 THEN hi60 END AS band_high
  FROM pk1 WHERE i >= 126 AND close > m20 AND low <= m20 * 1.02)"""
