"""Queries over rolling and recursive indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import rolling as r
from tapeloom.functions.recursive import Smooth, smooth, span
from tapeloom.operators import indicators as ind
from tapeloom.plans import sql as q
from tapeloom.plans.registry import query
from tapeloom.sources.bars import daily

C = F.col
DAY = "CAST(dt AS VARCHAR) AS dt"


def rnd(x: Column | str, n: int = 6) -> Column:
    return F.round(C(x) if isinstance(x, str) else x, n) + F.lit(0.0)


def day(x: str = "dt") -> Column:
    return C(x).cast("string").alias(x)


@query(
    "sma",
    q.with_ctes(
        q.BARS,
        select=f"""SELECT ticker, {DAY}, ROUND({q.full('AVG', 'close', 20)}, 7) AS sma20,
        ROUND({q.full('AVG', 'close', 50)}, 7) AS sma50, ROUND({q.full('AVG', 'close', 200)}, 7) AS sma200,
        ROUND({q.full('AVG', 'volume', 50)}, 6) AS vol50 FROM bars""",
    ),
)
def sma(spark, sf):
    return daily(spark, sf).select(
        "ticker",
        day(),
        *[F.round(r.sma(C("close"), n), 7).alias(f"sma{n}") for n in (20, 50, 200)],
        F.round(r.sma(C("volume"), 50), 6).alias("vol50"),
    )


@query(
    "ema",
    q.with_ctes(
        q.BARS,
        q.ema("bars", "e", {"ema10": q.span("close", 10), "ema21": q.span("close", 21), "ema200": q.span("close", 200, 200)}),
        select=f"""SELECT ticker, {DAY}, ROUND(ema10, 4) AS ema10, ROUND(ema21, 4) AS ema21,
        ROUND(ema200, 4) AS ema200 FROM e""",
    ),
)
def ema(spark, sf):
    close = C("close")
    df = smooth(daily(spark, sf), {"ema10": span(close, 10), "ema21": span(close, 21), "ema200": span(close, 200, 200)})
    return df.select("ticker", day(), *[rnd(c, 4).alias(c) for c in ("ema10", "ema21", "ema200")])


_GAPPED = {"slow": 0.1, "fast": 0.9}


def _walked(name: str, alpha: float) -> str:
    """The definition, bar by bar: the value stands over a gap, which weighs against it afterwards."""
    keep = 1.0 - alpha
    return f"""walk_{name} AS (
  WITH RECURSIVE w AS (
    SELECT ticker, i, dt, x AS y, 1 AS g FROM gapped WHERE i = 0
    UNION ALL
    SELECT n.ticker, n.i, n.dt, CASE WHEN n.x IS NULL THEN y WHEN y IS NULL THEN n.x
        ELSE (POW({keep!r}::DOUBLE, g) * y + {alpha!r}::DOUBLE * n.x) / (POW({keep!r}::DOUBLE, g) + {alpha!r}::DOUBLE) END,
      CASE WHEN n.x IS NULL THEN g + 1 ELSE 1 END
    FROM w JOIN gapped n ON n.ticker = w.ticker AND n.i = w.i + 1)
  SELECT * FROM w)"""


@query(
    "ema_gaps",
    q.with_ctes(
        q.BARS,
        "gapped AS MATERIALIZED (SELECT ticker, i, dt, CASE WHEN i % 17 NOT IN (3, 4, 11) THEN close END AS x FROM bars)",
        *[_walked(k, a) for k, a in _GAPPED.items()],
        select=f"""SELECT ticker, {DAY}, ROUND(s.y, 7) AS slow, ROUND(f.y, 7) AS fast
        FROM walk_slow s JOIN walk_fast f USING (ticker, i, dt)""",
    ),
)
def ema_gaps(spark, sf):
    gapped = daily(spark, sf).withColumn("close", F.expr("if(i % 17 not in (3, 4, 11), close, null)"))
    df = smooth(gapped, {k: Smooth(C("close"), a) for k, a in _GAPPED.items()})
    return df.select("ticker", day(), *[rnd(k, 7).alias(k) for k in _GAPPED])


@query(
    "true_range",
    q.with_ctes(q.BARS, select=f"SELECT ticker, {DAY}, {q.TRUE_RANGE} AS tr FROM bars"),
)
def true_range(spark, sf):
    return ind.with_true_range(daily(spark, sf)).select("ticker", day(), "tr")


@query(
    "atr_sma",
    q.with_ctes(
        q.BARS,
        q.MOVES,
        select=f"SELECT ticker, {DAY}, ROUND({q.full('AVG', 'tr', 14)}, 4) AS atr FROM moves",
    ),
)
def atr_sma(spark, sf):
    return ind.atr_simple(daily(spark, sf)).select("ticker", day(), rnd("atr", 4).alias("atr"))


@query(
    "atr_wilder",
    q.with_ctes(
        q.BARS,
        q.MOVES,
        q.ema("moves", "e", {"atr": q.wilder("tr")}),
        select=f"SELECT ticker, {DAY}, ROUND(atr, 4) AS atr FROM e",
    ),
)
def atr_wilder(spark, sf):
    return ind.atr_wilder(daily(spark, sf)).select("ticker", day(), rnd("atr", 4).alias("atr"))


ADX_CTES = ",\n".join(
    [
        q.MOVES,
        f"""dm0 AS (SELECT *, high - {q.lag('high')} AS up_, {q.lag('low')} - low AS dn_ FROM moves)""",
        """dm AS (SELECT *, CASE WHEN up_ > dn_ AND up_ > 0 THEN up_ ELSE 0 END AS pd_,
        CASE WHEN dn_ > up_ AND dn_ > 0 THEN dn_ ELSE 0 END AS md_ FROM dm0)""",
        q.ema("dm", "di", {"atr": q.wilder("tr"), "sp": q.wilder("pd_"), "sm": q.wilder("md_")}),
        """dx AS (SELECT *, COALESCE(100 * ABS(100 * sp / NULLIF(atr, 0) - 100 * sm / NULLIF(atr, 0))
        / NULLIF(100 * sp / NULLIF(atr, 0) + 100 * sm / NULLIF(atr, 0), 0), 0) AS dx_ FROM di)""",
        q.ema("dx", "adx_rows", {"adx": q.wilder("dx_")}),
    ]
)


@query(
    "adx",
    q.with_ctes(q.BARS, ADX_CTES, select=f"SELECT ticker, {DAY}, ROUND(adx, 4) + 0 AS adx FROM adx_rows"),
)
def adx(spark, sf):
    return ind.adx(daily(spark, sf)).select("ticker", day(), rnd("adx", 4).alias("adx"))


RSI_SIMPLE = ",\n".join(
    [
        q.MOVES,
        f"""rs0 AS (SELECT *, COALESCE(g_, 0) AS gg, COALESCE(lo_, 0) AS ll FROM moves)""",
        f"""rs1 AS (SELECT *, {q.full('AVG', 'gg', 14)} AS ag, {q.full('AVG', 'll', 14)} AS al FROM rs0)""",
        f"""rsi_rows AS (SELECT *, {q.rsi('ag', 'al', cap=False)} AS rsi FROM rs1)""",
    ]
)


@query(
    "rsi_simple",
    q.with_ctes(q.BARS, RSI_SIMPLE, select=f"SELECT ticker, {DAY}, ROUND(rsi, 4) + 0 AS rsi FROM rsi_rows"),
)
def rsi_simple(spark, sf):
    return ind.rsi_simple(daily(spark, sf)).select("ticker", day(), rnd("rsi", 4).alias("rsi"))


@query(
    "rsi_wilder",
    q.with_ctes(
        q.BARS,
        q.MOVES,
        q.ema(
            "moves",
            "e",
            {
                "g14": q.wilder("g_", 14, 14),
                "l14": q.wilder("lo_", 14, 14),
                "g2": q.wilder("g_", 2, 2),
                "l2": q.wilder("lo_", 2, 2),
            },
        ),
        select=f"""SELECT ticker, {DAY}, ROUND({q.rsi('g14', 'l14')}, 4) + 0 AS rsi14,
        ROUND({q.rsi('g2', 'l2')}, 4) + 0 AS rsi2,
        ROUND({q.rsi('g2', 'l2', cap=False)}, 4) + 0 AS rsi2_open FROM e""",
    ),
)
def rsi_wilder(spark, sf):
    capped = ind.with_rsi_wilder(daily(spark, sf), {"rsi14": 14, "rsi2": 2}, cap_without_loss=True)
    both = ind.with_rsi_wilder(capped, {"rsi2_open": 2}, cap_without_loss=False)
    return both.select("ticker", day(), *[rnd(c, 4).alias(c) for c in ("rsi14", "rsi2", "rsi2_open")])


MACD_CTES = ",\n".join(
    [
        q.ema("bars", "mf", {"f_": q.span("close", 12), "s_": q.span("close", 26)}),
        "ml AS (SELECT *, f_ - s_ AS macd FROM mf)",
        q.ema("ml", "macd_rows", {"macd_signal": q.span("macd", 9)}),
    ]
)


@query(
    "macd",
    q.with_ctes(
        q.BARS,
        MACD_CTES,
        select=f"SELECT ticker, {DAY}, ROUND(macd, 4) + 0 AS macd, ROUND(macd_signal, 4) + 0 AS macd_signal FROM macd_rows",
    ),
)
def macd(spark, sf):
    return ind.macd(daily(spark, sf)).select("ticker", day(), *[rnd(c, 4).alias(c) for c in ("macd", "macd_signal")])


@query(
    "high_52w",
    q.with_ctes(
        q.BARS,
        select=f"""SELECT ticker, {DAY}, MAX(high) OVER {q.rows(252)} AS high_52w,
        MIN(low) OVER {q.rows(252)} AS low_52w,
        ROUND(close / MAX(high) OVER {q.rows(252)} - 1, 6) + 0 AS from_high FROM bars""",
    ),
)
def high_52w(spark, sf):
    year = r.last_rows(252)
    hi, lo = F.max("high").over(year), F.min("low").over(year)
    return daily(spark, sf).select(
        "ticker",
        day(),
        hi.alias("high_52w"),
        lo.alias("low_52w"),
        rnd(C("close") / hi - 1).alias("from_high"),
    )


TIGHT = (
    f"COALESCE({q.full('MAX', 'high', 10)} - ({q.full('MIN', 'low', 10)}) < "
    f"{q.full('MAX', 'high', 10, 10)} - ({q.full('MIN', 'low', 10, 10)}), FALSE)"
).replace("CASE", "(CASE").replace("END", "END)")


@query("range_tighten", q.with_ctes(q.BARS, select=f"SELECT ticker, {DAY}, {TIGHT} AS tight FROM bars"))
def range_tighten(spark, sf):
    return daily(spark, sf).select("ticker", day(), ind.tightening().alias("tight"))


# Price levels are rounded less finely than ratios: smoothing order differs between engines.
_LEVELS = "ema10 ema20 ema50 ema200 atr rsi rsi2".split()
_RATIOS = "vol_ratio atr_ratio atr_pct dist_ema20 dist_ema50".split()
_EXACT = "hh20 hh60 ll10 ll20 ret21 ret63 ret126 ret252 dist_hh60".split()


@query(
    "features",
    q.with_ctes(
        q.BARS,
        q.FEATURES,
        select=f"SELECT ticker, {DAY}, ROUND(ddv, 5) AS ddv, "
        + ", ".join(f"ROUND({c}, 4) + 0 AS {c}" for c in _LEVELS)
        + "".join(f", ROUND({c}, 6) + 0 AS {c}" for c in _RATIOS)
        + "".join(f", {c}" for c in _EXACT)
        + " FROM feats",
    ),
)
def features(spark, sf) -> DataFrame:
    return ind.features(daily(spark, sf)).select(
        "ticker",
        day(),
        F.round("ddv", 5).alias("ddv"),
        *[rnd(c, 4).alias(c) for c in _LEVELS],
        *[rnd(c).alias(c) for c in _RATIOS],
        *_EXACT,
    )
