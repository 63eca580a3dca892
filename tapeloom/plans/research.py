"""Queries over regimes, entry signals and labelled outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tapeloom.operators import barriers as ba
from tapeloom.operators import indicators as ind
from tapeloom.operators import regimes as rg
from tapeloom.operators import signals as sg
from tapeloom.plans import sql as q
from tapeloom.plans.registry import query
from tapeloom.plans.windows import day, rnd
from tapeloom.sources.bars import daily, wide
from tapeloom.sources.store import stored

C = F.col
DAY = "CAST(dt AS VARCHAR) AS dt"
INDEXES = ("MKT", "NATION_1")
IDX = "('MKT', 'NATION_1')"

# ---- regimes and calendars -------------------------------------------------

SWING = ",\n".join(
    [
        q.MOVES,
        q.ema(
            "moves",
            "sw0",
            {f"ema{n}": q.span("close", n, n) for n in (5, 10, 20, 50, 200)}
            | {
                "atr": q.wilder("tr", 14, 14),
                "g14": q.wilder("g_", 14, 14),
                "l14": q.wilder("lo_", 14, 14),
                "g2": q.wilder("g_", 2, 2),
                "l2": q.wilder("lo_", 2, 2),
            },
        ),
        f"""sw AS MATERIALIZED (SELECT *, {q.rsi('g14', 'l14', cap=False)} AS rsi, {q.rsi('g2', 'l2', cap=False)} AS rsi2,
  {q.full('AVG', 'volume', 3)} AS vol3, {q.full('AVG', 'volume', 20)} AS vol20, COUNT(*) OVER (PARTITION BY ticker) AS n FROM sw0)""",
    ]
)
ANY = f"""ra0 AS (SELECT dt, BOOL_OR(close > ema200) FILTER (ticker = 'MKT') AS a, BOOL_OR(close > ema200) FILTER (ticker = 'NATION_1') AS b
  FROM sw WHERE ticker IN {IDX} GROUP BY dt),
ra1 AS (SELECT dt, LAST_VALUE(a IGNORE NULLS) OVER w AS a, LAST_VALUE(b IGNORE NULLS) OVER w AS b FROM ra0
  WINDOW w AS (ORDER BY dt ROWS UNBOUNDED PRECEDING)),
rany AS MATERIALIZED (SELECT dt, COALESCE(a, FALSE) OR COALESCE(b, FALSE) AS bull, NOT (COALESCE(a, FALSE) OR COALESCE(b, FALSE)) AS bear FROM ra1)"""
ALL = f"""rall AS MATERIALIZED (SELECT dt, BOOL_AND(COALESCE(close > ema200 AND ema50 > ema200, FALSE)) AS regime
  FROM sw WHERE ticker IN {IDX} GROUP BY dt)"""


def swing(spark, sf):
    return ind.swing_columns(daily(spark, sf))


def swing_table(spark, sf):
    """The swing columns as a stored table, for jobs that read them several times."""
    return stored(swing(spark, sf))


@query("regime_any", q.with_ctes(q.BARS, SWING, ANY, select=f"SELECT {DAY}, bull, bear FROM rany"))
def regime_any(spark, sf):
    return rg.regime_any(swing(spark, sf), INDEXES).select(day(), "bull", "bear")


@query("regime_all", q.with_ctes(q.BARS, SWING, ALL, select=f"SELECT {DAY}, regime FROM rall"))
def regime_all(spark, sf):
    return rg.regime_all(swing(spark, sf), INDEXES).select(day(), "regime")


@query(
    "regime_asof",
    q.with_ctes(
        q.BARS,
        SWING,
        ALL,
        "odd AS (SELECT * FROM rall WHERE day(dt) % 3 <> 0)",
        select=f"""SELECT ticker, CAST(b.dt AS VARCHAR) AS dt, COALESCE(LAST_VALUE(regime IGNORE NULLS) OVER (PARTITION BY ticker
        ORDER BY b.dt ROWS UNBOUNDED PRECEDING), FALSE) AS regime FROM bars b LEFT JOIN odd ON odd.dt = b.dt""",
    ),
)
def regime_asof(spark, sf):
    bars = daily(spark, sf)
    # Regime dates are thinned, so that flags have to be carried forward.
    regime = rg.regime_all(ind.swing_columns(bars), INDEXES).filter(F.dayofmonth("dt") % 3 != 0)
    return rg.with_regime(bars.select("ticker", "dt"), regime).select("ticker", day(), "regime")


@query(
    "align_calendar",
    q.with_ctes(
        q.BARS,
        "cal AS (SELECT dt AS cal_day, ROW_NUMBER() OVER (ORDER BY dt) - 1 AS cal_pos FROM (SELECT DISTINCT dt FROM bars WHERE day(dt) % 4 = 0))",
        "t AS (SELECT ticker, dt FROM bars)",
        select="""SELECT ticker, CAST(dt AS VARCHAR) AS dt, CAST(cal_day AS VARCHAR) AS cal_day, CAST(cal_pos AS DOUBLE) AS cal_pos
        FROM t ASOF LEFT JOIN cal ON t.dt <= cal.cal_day""",
    ),
)
def align_calendar(spark, sf):
    bars = daily(spark, sf)
    calendar = bars.filter(F.dayofmonth("dt") % 4 == 0).select(C("dt").alias("day"))
    aligned = rg.align_forward(bars.select("ticker", "dt"), calendar, "dt")
    return aligned.select("ticker", day(), day("cal_day"), C("cal_pos").cast("double").alias("cal_pos"))


@query(
    "price_grid",
    q.with_ctes(
        q.BARS,
        "days AS (SELECT DISTINCT dt FROM bars)",
        "tickers AS (SELECT DISTINCT ticker FROM bars)",
        select="""SELECT t.ticker, CAST(d.dt AS VARCHAR) AS dt, LAST_VALUE(close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY d.dt
        ROWS UNBOUNDED PRECEDING) AS value FROM tickers t CROSS JOIN days d LEFT JOIN bars b ON b.ticker = t.ticker AND b.dt = d.dt""",
    ),
)
def price_grid(spark, sf):
    return rg.price_grid(daily(spark, sf)).select("ticker", day(), "value")


# ---- signals ---------------------------------------------------------------

GRID = dict(enumerate(sg.rule_grid(min_ddv=1_000.0)))
REGIME_SQL = """reg AS (SELECT dt, close > ema200 AND ema50 > ema200 AS regime FROM feats WHERE ticker = 'MKT'),
withreg AS (SELECT f.*, COALESCE(LAST_VALUE(regime IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY f.dt ROWS UNBOUNDED PRECEDING), FALSE) AS regime
  FROM feats f LEFT JOIN reg ON reg.dt = f.dt)"""
PREPARED = f"""{REGIME_SQL},
prep AS MATERIALIZED (SELECT *, {q.lag('close')} AS prev_close, {q.lag('hh20')} AS prev_hh20, COUNT(*) OVER (PARTITION BY ticker) AS n FROM withreg)"""


def rule_sql(rule: sg.Rule) -> str:
    tests = [
        "i >= 250 AND i < n - 1 AND ema200 IS NOT NULL AND atr IS NOT NULL",
        f"ddv >= {rule.min_ddv} AND close >= {rule.min_price} AND ret126 >= {rule.mom_min}",
        f"rsi2 <= {rule.rsi2_max} AND rsi <= {rule.rsi14_max} AND ret21 <= {rule.ret21_max}",
        f"dist_ema20 <= {rule.dist_ema20_max} AND dist_ema50 >= {rule.dist_ema50_min} AND dist_hh60 >= {rule.dist_hh60_min}",
        f"atr_ratio <= {rule.atr_ratio_max} AND vol_ratio >= {rule.vol_ratio_min}",
        f"atr_pct >= {rule.atr_pct_min} AND atr_pct <= {rule.atr_pct_max}",
    ]
    tests += ["regime"] if rule.use_regime else []
    tests += ["close > ema200 AND ema50 > ema200"] if rule.trend else []
    tests += ["close > prev_close"] if rule.up_close else []
    tests += ["close - low > 0.5 * (high - low)"] if rule.strong_close else []
    tests += {"breakout": ["close > prev_hh20"], "pullback": ["close <= ema20"]}.get(rule.family, [])
    return " AND ".join(tests)


def prepared(spark, sf):
    feats = feature_rows(spark, sf)
    regime = rg.regime_all(feats, ("MKT",))
    return sg.prepare_rules(rg.with_regime(feats, regime))


@query(
    "rule_signals",
    q.with_ctes(
        q.BARS,
        q.FEATURES,
        PREPARED,
        select=" UNION ALL ".join(
            f"SELECT {k} AS rule, '{rule.family}' AS family, ticker, {DAY} FROM prep WHERE {rule_sql(rule)} AND ticker <> 'MKT'"
            for k, rule in GRID.items()
        ),
    ),
)
def rule_signals(spark, sf):
    fired = sg.rule_signals(prepared(spark, sf).filter(C("ticker") != "MKT"), GRID)
    families = F.create_map(*[F.lit(x) for k, rule in GRID.items() for x in (k, rule.family)])
    rows = fired.select(F.explode("rules").alias("rule"), "ticker", day())
    return rows.withColumn("family", families[C("rule")])


@query(
    "vol_tiers",
    q.with_ctes(
        q.BARS,
        q.FEATURES,
        "tiers AS (SELECT * FROM (VALUES ('t1_calm', 0.0, 0.02), ('t2_normal', 0.02, 0.03), ('t3_active', 0.03, 0.045), ('t4_hot', 0.045, 0.07), ('t5_wild', 0.07, 0.2)) t(tier, lo, hi))",
        select=f"SELECT tier, ticker, {DAY}, ROUND(atr_pct, 6) AS atr_pct FROM feats JOIN tiers ON atr_pct >= lo AND atr_pct <= hi",
    ),
)
def vol_tiers(spark, sf):
    return sg.with_tiers(ind.features(daily(spark, sf))).select("tier", "ticker", day(), rnd("atr_pct").alias("atr_pct"))


VARIANTS = [
    sg.Variant(f"{strategy}_{side}", strategy, side, **kw)
    for side in ("long", "short")
    for strategy, kw in (
        ("pullback", dict(ema_zone=0.03, rsi_lo=30, rsi_hi=70, volume_ratio=1.3, require_reversal=True, target_lookback=60, min_rr=0.5)),
        ("reversion", dict(rsi_lo=20, rsi_hi=80)),
        ("retest", dict(ema_zone=0.02, volume_ratio=0.6)),
        ("breakout", dict(volume_ratio=0.8)),
    )
]


def variant_sql(v: sg.Variant) -> str:
    lng = v.side == "long"
    gt, ge, le = (">", ">=", "<=") if lng else ("<", "<=", ">=")
    sgn = "-" if lng else "+"

    def ext(high: bool, n: int, skip: int) -> str:
        return f"({q.full('MAX' if high else 'MIN', 'high' if high else 'low', n, skip)})"

    near, near1, far = ext(not lng, v.stop_lookback, 0), ext(not lng, v.stop_lookback, 1), ext(lng, v.target_lookback, 1)
    trend = f"close {gt} ema200 AND ema50 {gt} ema200 AND {'bull' if lng else 'bear'}"
    vol = f"vol3 {'<=' if v.strategy == 'pullback' else '>='} vol20 * {v.volume_ratio}"
    stop, target = f"near {sgn} {v.atr_buffer} * atr", "far"
    mom = f"mom {ge} {v.momentum_min if lng else -v.momentum_min}"
    if v.strategy == "reversion":
        cond = f"{trend} AND rsi2 {le} {v.rsi_lo if lng else v.rsi_hi} AND pc {gt} close"
        target = "ema20"
    elif v.strategy == "retest":
        z = v.ema_zone
        touch = f"low <= lvl * {1 + z} AND close >= lvl * {1 - z}" if lng else f"high >= lvl * {1 - z} AND close <= lvl * {1 + z}"
        cond = f"{trend} AND {vol} AND {touch} AND close {gt} open AND close {gt} pc AND COALESCE(bmom, 0) {ge} 0"
        target = "lvl + (lvl - base)"
    elif v.strategy == "breakout":
        cond = f"{trend} AND {vol} AND close {gt} far AND {mom}"
        stop, target = f"near1 {sgn} {v.atr_buffer} * atr", "far + (far - near1)"
    else:
        cond = (
            f"{trend} AND LEAST(ABS(close / ema20 - 1), ABS(close / ema50 - 1)) <= {v.ema_zone} AND {vol} "
            f"AND rsi BETWEEN {v.rsi_lo} AND {v.rsi_hi} AND close {gt} open AND close {gt} {'ph' if lng else 'pl'}"
        )
    last5 = f"({q.W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
    return f"""SELECT '{v.name}' AS variant, '{v.side}' AS side, {v.max_hold} AS max_hold, {v.min_rr} AS min_rr, ticker, dt, i, close,
  {stop} AS stop, {target} AS target FROM (
  SELECT *, LAST_VALUE(CASE WHEN brk THEN far END IGNORE NULLS) OVER {last5} AS lvl,
    LAST_VALUE(CASE WHEN brk THEN near1 END IGNORE NULLS) OVER {last5} AS base,
    LAST_VALUE(CASE WHEN brk THEN COALESCE(mom, 0) END IGNORE NULLS) OVER {last5} AS bmom FROM (
  SELECT *, i >= {v.target_lookback} AND close {gt} far AS brk FROM (
  SELECT *, {near} AS near, {near1} AS near1, {far} AS far, {q.lag('close')} AS pc, {q.lag('high')} AS ph, {q.lag('low')} AS pl,
    close / {q.lag('close', 126)} - 1 AS mom FROM vrows)))
  WHERE i >= {max(201, v.target_lookback + 1)} AND i < n - 1 AND ema200 IS NOT NULL AND rsi IS NOT NULL AND atr IS NOT NULL
    AND vol20 >= 10 AND ticker NOT IN {IDX} AND {cond}"""


def variant_rows_sql(variants: list[sg.Variant]) -> str:
    return f"""vrows AS MATERIALIZED (SELECT s.*, COALESCE(LAST_VALUE(bull IGNORE NULLS) OVER w, FALSE) AS bull,
  COALESCE(LAST_VALUE(bear IGNORE NULLS) OVER w, FALSE) AS bear FROM sw s LEFT JOIN rany r ON r.dt = s.dt
  WINDOW w AS (PARTITION BY ticker ORDER BY s.dt ROWS UNBOUNDED PRECEDING)),
vsig AS MATERIALIZED ({' UNION ALL '.join(variant_sql(v) for v in variants)})"""


VARIANT_ROWS = variant_rows_sql(VARIANTS)


def variant_input(spark, sf):
    rows = swing_table(spark, sf)
    return stored(rg.with_regime(rows, rg.regime_any(rows, INDEXES), ("bull", "bear")))


def variant_rows(spark, sf):
    """Bars with swing columns, and the signals of all variants on them."""
    rows = variant_input(spark, sf)
    return rows, sg.variant_signals(rows.filter(~C("ticker").isin(*INDEXES)), VARIANTS, min_volume=10.0)


@query(
    "variant_signals",
    q.with_ctes(
        q.BARS,
        SWING,
        ANY,
        VARIANT_ROWS,
        select=f"SELECT variant, ticker, {DAY}, ROUND(stop, 4) AS stop, ROUND(target, 4) AS target FROM vsig",
    ),
)
def variant_signals(spark, sf):
    _, s = variant_rows(spark, sf)
    return s.select("variant", "ticker", day(), rnd("stop", 4).alias("stop"), rnd("target", 4).alias("target"))


PANEL = """cal AS (SELECT dt, ROW_NUMBER() OVER (ORDER BY dt) - 1 AS pos FROM (SELECT DISTINCT dt FROM bars)),
placed AS (SELECT b.ticker, b.close, c.pos FROM bars b JOIN cal c ON c.dt = b.dt)"""


def panel_sql(formation: int, skip: int) -> str:
    return f"""panel AS (SELECT a.ticker, c.dt, a.close / b.close - 1 AS momentum FROM cal c JOIN placed a ON a.pos = c.pos - {skip}
  JOIN placed b ON b.ticker = a.ticker AND b.pos = c.pos - {formation}),
xs AS MATERIALIZED (SELECT *, (RANK() OVER (PARTITION BY dt ORDER BY momentum) + (COUNT(*) OVER (PARTITION BY dt, momentum) - 1) / 2.0::DOUBLE)
  / COUNT(*) OVER (PARTITION BY dt) AS rank, COUNT(*) OVER (PARTITION BY dt) AS names FROM panel)"""


@query(
    "xs_rank",
    q.with_ctes(
        q.WIDE,
        PANEL,
        panel_sql(126, 21),
        select=f"SELECT ticker, {DAY}, momentum, ROUND(rank, 6) AS rank FROM xs WHERE names >= 5",
    ),
)
def xs_rank(spark, sf):
    ranked = sg.average_rank(sg.panel_momentum(wide(spark, sf), 126, 21), "dt", "momentum", min_names=5)
    return ranked.filter("rank is not null").select("ticker", day(), "momentum", rnd("rank").alias("rank"))


MOM = sg.Momentum(rank_pct=0.4, min_volume=10.0, min_dollar_volume=1_000.0, min_names=5)


@query(
    "xmom_candidates",
    q.with_ctes(
        q.BARS,
        SWING,
        ANY,
        PANEL,
        panel_sql(126, 21),
        f"""xr AS (SELECT s.*, xs.rank, xs.momentum, COALESCE(LAST_VALUE(bull IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY i ROWS UNBOUNDED PRECEDING), FALSE) AS bull,
        COALESCE(LAST_VALUE(bear IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY i ROWS UNBOUNDED PRECEDING), FALSE) AS bear, {q.full('MAX', 'high', 20, 1)} AS ph, {q.full('MIN', 'low', 20, 1)} AS pl,
        {q.full('MIN', 'low', 20)} AS sl, {q.full('MAX', 'high', 20)} AS sh FROM sw s
        LEFT JOIN xs ON xs.ticker = s.ticker AND xs.dt = s.dt AND names >= 5 LEFT JOIN rany r ON r.dt = s.dt)""".replace(
            "PARTITION BY ticker ORDER BY i", "PARTITION BY s.ticker ORDER BY s.i"
        ),
        f"""xc AS (SELECT *, CASE WHEN rank >= 0.6 AND bull AND close > ema200 AND ema50 > ema200 AND close > ph THEN 'long'
        WHEN rank <= 0.4 AND bear AND close < ema200 AND ema50 < ema200 AND close < pl THEN 'short' END AS side FROM xr
        WHERE i >= 205 AND i < n - 1 AND vol20 >= 10 AND close * vol20 >= 1000 AND volume >= 0.8 * vol20 AND ticker NOT IN {IDX})""",
        select=f"""SELECT ticker, {DAY}, side, ROUND(rank, 6) AS rank, momentum,
        ROUND(CASE side WHEN 'long' THEN sl - 0.5 * atr ELSE sh + 0.5 * atr END, 4) AS stop FROM xc WHERE side IS NOT NULL""",
    ),
)
def xmom_candidates(spark, sf):
    rows = swing_table(spark, sf)
    found = sg.momentum_candidates(rows, rg.regime_any(rows, INDEXES), MOM).filter(~C("ticker").isin(*INDEXES))
    return found.select("ticker", day(), "side", rnd("rank").alias("rank"), "momentum", rnd("stop", 4).alias("stop"))


CANDLES = f"""candle AS MATERIALIZED (SELECT *, (close - open) / GREATEST(high - low, 1e-9) AS body_pct,
  (LEAST(open, close) - low) / GREATEST(high - low, 1e-9) AS lower_wick, (close - low) / GREATEST(high - low, 1e-9) AS close_location,
  close / {q.lag('close', 63)} - 1 AS mom63, volume / AVG(volume) OVER {q.rows(20, 1)} AS vol_vs_20 FROM bars)"""


@query(
    "candle_features",
    q.with_ctes(
        q.BARS,
        CANDLES,
        select=f"SELECT ticker, {DAY}, body_pct, lower_wick, close_location, mom63, ROUND(vol_vs_20, 6) AS vol_vs_20 FROM candle",
    ),
)
def candle_features(spark, sf):
    return sg.candle_features(daily(spark, sf)).select(
        "ticker", day(), "body_pct", "lower_wick", "close_location", "mom63", rnd("vol_vs_20").alias("vol_vs_20")
    )


@query(
    "topk_per_day",
    q.with_ctes(
        q.WIDE,
        CANDLES,
        "ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dt ORDER BY mom63 DESC NULLS LAST, ticker) AS place FROM candle)",
        select=f"SELECT ticker, {DAY}, mom63, place FROM ranked WHERE place <= 5",
    ),
)
def topk_per_day(spark, sf):
    best = sg.top_per_day(sg.candle_features(wide(spark, sf)), "dt", "mom63", 5)
    return best.select("ticker", day(), "mom63", C("place").cast("bigint").alias("place"))


# ---- outcomes --------------------------------------------------------------

PULLBACK = sg.Rule("pullback", min_ddv=1_000.0, use_regime=False, up_close=True)
BREAKOUT = sg.Rule("breakout", min_ddv=1_000.0, use_regime=False)


def feature_rows(spark, sf):
    return stored(ind.features(daily(spark, sf)))


def fired(feats, rule):
    rows = sg.prepare_rules(feats.withColumn("regime", F.lit(True)))
    return rows.filter(sg.fires(rule) & (C("ticker") != "MKT")).select("ticker", "i")


PREP_PLAIN = f"""prep AS MATERIALIZED (SELECT *, TRUE AS regime, {q.lag('close')} AS prev_close, {q.lag('hh20')} AS prev_hh20,
  COUNT(*) OVER (PARTITION BY ticker) AS n FROM feats)"""


def bracket_sql(signals: str, brackets: list[tuple[int, str, float]], out: str) -> str:
    """Labels of ``signals(ticker, i, ...)`` by brackets (id, stop expression, reward ratio), bar by bar."""
    entry = f"""{out}_e AS (SELECT f.*, LEAD(open) OVER ({q.W}) AS entry, LEAD(dt) OVER ({q.W}) AS entry_date, i + 1 AS e,
  COUNT(*) OVER (PARTITION BY ticker) AS nn FROM feats f),
{out}_s AS (SELECT e.* FROM {out}_e e JOIN (SELECT DISTINCT ticker, i FROM {signals}) s ON s.ticker = e.ticker AND s.i = e.i
  WHERE e.e < nn AND entry_date - dt <= 4 AND atr IS NOT NULL AND entry > 0)"""
    legs = " UNION ALL ".join(
        f"SELECT {k} AS bracket, *, {stop} AS sl, entry + {rr} * (entry - ({stop})) AS tp, "
        f"{(stop.split('*')[0].replace('entry -', '') + '* atr / close') if 'll' not in stop else '0.01'} AS frac FROM {out}_s"
        for k, stop, rr in brackets
    )
    return f"""{entry},
{out}_l AS (SELECT * FROM ({legs}) WHERE entry - sl > 0 AND frac BETWEEN 0.005 AND 0.5),
{out}_w AS (SELECT l.bracket, l.ticker, l.i, b.i AS bi, b.open AS bo, b.close AS bc, b.dt AS bd,
  CASE WHEN b.i > l.e AND b.open <= sl THEN 'gap_stop' WHEN b.i > l.e AND b.open >= tp THEN 'gap_target'
    WHEN b.low <= sl THEN 'stop' WHEN b.high >= tp * 1.001 THEN 'target' END AS st
  FROM {out}_l l JOIN bars b ON b.ticker = l.ticker AND b.i >= l.e AND b.i < l.e + 504),
{out}_h AS (SELECT bracket, ticker, i, COALESCE(MIN(bi) FILTER (st IS NOT NULL), MAX(bi)) AS j,
  COALESCE(ARG_MIN(st, bi) FILTER (st IS NOT NULL), 'unresolved') AS status,
  COALESCE(ARG_MIN(bo, bi) FILTER (st IS NOT NULL), 0) AS xo, ARG_MAX(bc, bi) AS lc,
  COALESCE(ARG_MIN(bd, bi) FILTER (st IS NOT NULL), MAX(bd)) AS exit_date FROM {out}_w GROUP BY ALL),
{out}_p AS (SELECT l.*, j, status, exit_date, CASE status WHEN 'gap_stop' THEN xo WHEN 'gap_target' THEN tp + 0.5 * (xo - tp)
    WHEN 'stop' THEN sl WHEN 'target' THEN tp ELSE lc END AS px
  FROM {out}_l l JOIN {out}_h h ON h.bracket = l.bracket AND h.ticker = l.ticker AND h.i = l.i),
{out} AS MATERIALIZED (SELECT *, dt AS signal_date, (entry - sl) / entry AS risk_pct, j - e + 1 AS bars_held,
  (px - entry - (entry * CASE WHEN ddv IS NULL OR ddv < 25e6 THEN 35 WHEN ddv < 100e6 THEN 22 WHEN ddv < 500e6 THEN 13 ELSE 8 END
    + px * CASE status WHEN 'target' THEN 3 WHEN 'gap_target' THEN 12 WHEN 'stop' THEN 18 WHEN 'gap_stop' THEN 55 ELSE 15 END) / 10000)
  / (entry - sl) AS r FROM {out}_p)"""


LABEL_BRACKETS = {
    0: ba.Bracket(3.0, 2.0),
    1: ba.Bracket(1.5, 1.0),
    2: ba.Bracket(rr=2.0, sl_mode="swing"),
    3: ba.Bracket(rr=2.0, sl_mode="swing", swing_lookback=20),
}
PULL_SIG = f"psig AS MATERIALIZED (SELECT ticker, i FROM prep WHERE {rule_sql(PULLBACK)} AND ticker <> 'MKT')"
BREAK_SIG = f"bsig AS MATERIALIZED (SELECT ticker, i FROM prep WHERE {rule_sql(BREAKOUT)} AND ticker <> 'MKT')"
_LABEL_COLS = "ticker, CAST(signal_date AS VARCHAR) AS signal_date, CAST(entry_date AS VARCHAR) AS entry_date, CAST(exit_date AS VARCHAR) AS exit_date"


@query(
    "barrier_labels",
    q.with_ctes(
        q.BARS,
        q.FEATURES,
        PREP_PLAIN,
        PULL_SIG,
        bracket_sql(
            "psig",
            [(0, "entry - 3.0 * atr", 2.0), (1, "entry - 1.5 * atr", 1.0), (2, "ll10 - 0.1 * atr", 2.0), (3, "ll20 - 0.1 * atr", 2.0)],
            "lab",
        ),
        select=f"SELECT bracket, {_LABEL_COLS}, entry, ROUND(sl, 4) AS sl, ROUND(tp, 4) AS tp, ROUND(r, 5) + 0 AS r, status, bars_held AS bars FROM lab",
    ),
)
def barrier_labels(spark, sf):
    feats = feature_rows(spark, sf)
    t = ba.label_brackets(feats, fired(feats, PULLBACK), LABEL_BRACKETS)
    return t.select(
        "bracket", "ticker", day("signal_date"), day("entry_date"), day("exit_date"), "entry",
        rnd("sl", 4).alias("sl"), rnd("tp", 4).alias("tp"), rnd("r", 5).alias("r"), "status", "bars",
    )


def sided_sql(signals: str, hold: int, out: str, max_risk: float | None = None) -> str:
    risk = f" AND risk / entry <= {max_risk}" if max_risk else ""
    return f"""{out}_e AS (SELECT ticker, i, LEAD(open) OVER ({q.W}) AS entry, LEAD(dt) OVER ({q.W}) AS entry_date, i + 1 AS e,
  COUNT(*) OVER (PARTITION BY ticker) AS n FROM bars),
{out}_s AS (SELECT s.*, entry, entry_date, e, n, CASE side WHEN 'long' THEN entry - stop ELSE stop - entry END AS risk
  FROM {signals} s JOIN {out}_e x ON x.ticker = s.ticker AND x.i = s.i WHERE e < n),
{out}_v AS (SELECT * FROM {out}_s WHERE risk > 0{risk}),
{out}_w AS (SELECT v.*, b.i AS bi, b.open AS bo, b.high AS bh, b.low AS bl, b.close AS bc, b.dt AS bd, b.ema5, b.ema20,
    side = 'long' AS lng FROM {out}_v v JOIN sw b ON b.ticker = v.ticker AND b.i >= v.e AND b.i < v.e + {hold})"""


_GAP = "CASE WHEN lng THEN bo <= stop ELSE bo >= stop END"
_STOP = "CASE WHEN lng THEN bl <= stop ELSE bh >= stop END"
_COST = "2 * 10 / 10000.0::DOUBLE * entry / risk"
_GROSS = "CASE side WHEN 'long' THEN px - entry ELSE entry - px END / risk"

TIMED_SIG = "tsig AS (SELECT variant, side, min_rr, ticker, i, stop, target FROM vsig WHERE variant NOT LIKE 'reversion%')"
TIMED = f"""{sided_sql('tsig', 10, 'tm')},
tm_f AS (SELECT *, CASE WHEN lng THEN target - entry ELSE entry - target END / risk AS planned_rr, CASE WHEN {_GAP} THEN 'gap_stop' WHEN {_STOP} THEN 'stop'
  WHEN CASE WHEN lng THEN bo >= target ELSE bo <= target END THEN 'gap_target' WHEN CASE WHEN lng THEN bh >= target ELSE bl <= target END THEN 'target' END AS st FROM tm_w),
tm_h AS (SELECT variant, side, ticker, i, entry, entry_date, risk, e, min_rr, planned_rr, ANY_VALUE(stop) AS stop, ANY_VALUE(target) AS target,
  COALESCE(MIN(bi) FILTER (st IS NOT NULL), MAX(bi)) AS j, COALESCE(ARG_MIN(st, bi) FILTER (st IS NOT NULL), 'time') AS status,
  ARG_MIN(bo, bi) FILTER (st IS NOT NULL) AS xo, ARG_MAX(bc, bi) AS lc, COALESCE(ARG_MIN(bd, bi) FILTER (st IS NOT NULL), MAX(bd)) AS exit_date
  FROM tm_f WHERE planned_rr > 0 GROUP BY ALL),
tm_p AS (SELECT *, CASE WHEN status LIKE 'gap%' THEN xo WHEN status = 'stop' THEN stop WHEN status = 'target' THEN target ELSE lc END AS px, j - e + 1 AS held FROM tm_h),
timed AS MATERIALIZED (SELECT *, {_GROSS} - {_COST} AS r FROM tm_p)"""
_TRADE_COLS = "ticker, CAST(entry_date AS VARCHAR) AS entry_date, CAST(exit_date AS VARCHAR) AS exit_date, status, ROUND(r, 5) + 0 AS r"


def _trade_out(t, *more):
    return t.select(*more, "ticker", day("entry_date"), day("exit_date"), "status", rnd("r", 5).alias("r"))


def timed(spark, sf):
    rows, signals = variant_rows(spark, sf)
    return ba.label_timed(signals.filter(~C("variant").startswith("reversion")), rows, max_hold=10)


@query(
    "barrier_timed",
    q.with_ctes(q.BARS, SWING, ANY, VARIANT_ROWS, TIMED_SIG, TIMED, select=f"SELECT variant, {_TRADE_COLS}, held, ROUND(planned_rr, 5) AS planned_rr FROM timed"),
)
def barrier_timed(spark, sf):
    t = timed(spark, sf)
    return _trade_out(t, "variant", "held", rnd("planned_rr", 5).alias("planned_rr"))


REV_SIG = "rsig AS (SELECT variant, side, ticker, i, stop FROM vsig WHERE variant LIKE 'reversion%')"


def moved_sql(name: str, arm: str, status: str, limit: str, hold: int) -> str:
    """Stop first, else next open after the first armed bar, else the last close."""
    return f"""{name}_h AS (SELECT side, ticker, i, entry, entry_date, risk, e, n, stop, MIN(bi) FILTER ({_GAP} OR {_STOP}) AS s,
  MIN(bi) FILTER ({arm}) AS a, MAX(bi) AS last FROM {name}_w GROUP BY ALL),
{name}_j AS (SELECT *, CASE WHEN s IS NOT NULL AND (a IS NULL OR s <= a) THEN 'stop' WHEN a IS NOT NULL AND a + 1 < {limit} THEN '{status}' ELSE 'time' END AS k FROM {name}_h),
{name}_x AS (SELECT j.*, b.i AS j, b.dt AS exit_date, b.open AS xo, b.close AS xc FROM {name}_j j JOIN bars b ON b.ticker = j.ticker
  AND b.i = CASE k WHEN 'stop' THEN s WHEN 'time' THEN last ELSE a + 1 END),
{name}_p AS (SELECT *, CASE WHEN k = 'stop' AND CASE side WHEN 'long' THEN xo <= stop ELSE xo >= stop END THEN 'gap_stop' ELSE k END AS status, j - e + 1 AS held FROM {name}_x),
{name}_q AS (SELECT *, CASE status WHEN 'stop' THEN stop WHEN 'time' THEN xc ELSE xo END AS px FROM {name}_p),
{name} AS MATERIALIZED (SELECT *, {_GROSS} - {_COST} AS r FROM {name}_q)"""


@query(
    "barrier_reversion",
    q.with_ctes(
        q.BARS,
        SWING,
        ANY,
        VARIANT_ROWS,
        REV_SIG,
        sided_sql("rsig", 10, "rev"),
        moved_sql("rev", "CASE WHEN lng THEN bc > ema5 ELSE bc < ema5 END AND bi + 1 < n", "ema5_recovery", "n", 10),
        select=f"SELECT side, held, {_TRADE_COLS} FROM rev",
    ),
)
def barrier_reversion(spark, sf):
    rows, signals = variant_rows(spark, sf)
    t = ba.label_reversion(signals.filter(C("variant").startswith("reversion")), rows, max_hold=10)
    return _trade_out(t, "side", "held")


TRAIL_SIG = f"""bk AS (SELECT *, {q.full('MAX', 'high', 20, 1)} AS ph, {q.full('MIN', 'low', 20, 1)} AS pl, {q.full('MIN', 'low', 20)} AS l20, {q.full('MAX', 'high', 20)} AS h20 FROM sw),
ksig AS (SELECT ticker, i, CASE WHEN close > ph THEN 'long' ELSE 'short' END AS side,
  CASE WHEN close > ph THEN l20 - 0.5 * atr ELSE h20 + 0.5 * atr END AS stop FROM bk WHERE i >= 201 AND (close > ph OR close < pl))"""


def trail_signals(rows):
    from tapeloom.functions import rolling as r

    b = rows.withColumns(
        {
            "ph": r.rolling_max(C("high"), 20, skip=1),
            "pl": r.rolling_min(C("low"), 20, skip=1),
            "l20": r.rolling_min(C("low"), 20),
            "h20": r.rolling_max(C("high"), 20),
        }
    ).filter((C("i") >= 201) & ((C("close") > C("ph")) | (C("close") < C("pl"))))
    up = C("close") > C("ph")
    return b.select(
        "ticker",
        "i",
        F.when(up, "long").otherwise("short").alias("side"),
        F.when(up, C("l20") - 0.5 * C("atr")).otherwise(C("h20") + 0.5 * C("atr")).alias("stop"),
    )


@query(
    "barrier_trail",
    q.with_ctes(
        q.BARS,
        SWING,
        TRAIL_SIG,
        sided_sql("ksig", 40, "tr", 0.15),
        moved_sql("tr", "CASE WHEN lng THEN bc < ema20 ELSE bc > ema20 END", "ema_trail", "LEAST(e + 40, n)", 40),
        """best AS (SELECT t.ticker, t.i, GREATEST(MAX(CASE WHEN w.lng THEN w.bh - t.entry ELSE t.entry - w.bl END / t.risk), 0) AS mfe_r
        FROM tr t JOIN tr_w w ON w.ticker = t.ticker AND w.i = t.i AND w.bi <= CASE WHEN t.status = 'ema_trail' THEN t.j - 1 ELSE t.j END GROUP BY ALL)""",
        select=f"SELECT t.side, t.{_TRADE_COLS}, ROUND(mfe_r, 5) AS mfe_r FROM tr t JOIN best ON best.ticker = t.ticker AND best.i = t.i",
    ),
)
def barrier_trail(spark, sf):
    rows = swing_table(spark, sf)
    t = ba.label_trail(trail_signals(rows), rows, "ema20", max_hold=40)
    return _trade_out(t, "side", rnd("mfe_r", 5).alias("mfe_r"))


STAGED_SIG = f"""st0 AS (SELECT *, {q.full('MIN', 'low', 20)} - 0.1 * atr AS stop, ({q.full('MAX', 'high', 60, 1)}) * 0.995 AS resistance FROM sw),
ssig AS MATERIALIZED (SELECT ticker, i, 'long' AS side, stop, close + (close - stop) AS tp1, close + 4 * (close - stop) AS target, resistance
  FROM st0 WHERE i >= 201 AND close > ema200 AND ema50 > ema200 AND close <= ema20 AND close - stop > 0)"""


def staged_signals(rows):
    from tapeloom.functions import rolling as r

    s = rows.withColumns(
        {
            "stop": r.rolling_min(C("low"), 20) - 0.1 * C("atr"),
            "resistance": r.rolling_max(C("high"), 60, skip=1) * 0.995,
        }
    )
    ok = (C("close") > C("ema200")) & (C("ema50") > C("ema200")) & (C("close") <= C("ema20"))
    gap = C("close") - C("stop")
    return s.filter((C("i") >= 201) & ok & (gap > 0)).select(
        "ticker", "i", "stop", (C("close") + gap).alias("tp1"), (C("close") + 4 * gap).alias("target"), "resistance"
    )


RR_WINDOW = (1.5, 2.0)


@query(
    "barrier_rr_window",
    q.with_ctes(
        q.BARS,
        SWING,
        STAGED_SIG,
        "tsig AS (SELECT 'rr' AS variant, side, 0 AS min_rr, ticker, i, stop, resistance AS target FROM ssig)",
        TIMED.replace("b.i < v.e + 10", "b.i < v.e + 30"),
        select=f"""SELECT {_TRADE_COLS.replace("status,", "CASE status WHEN 'gap_target' THEN 'target' ELSE status END AS status,")}, held,
        ROUND(planned_rr, 5) AS planned_rr FROM timed WHERE planned_rr BETWEEN {RR_WINDOW[0]} AND {RR_WINDOW[1]}""",
    ),
)
def barrier_rr_window(spark, sf):
    """Targets at the resistance, where it pays 1.5 to 2 times the risk; an open beyond the target counts as the target."""
    rows = swing_table(spark, sf)
    signals = staged_signals(rows).withColumns({"side": F.lit("long"), "target": C("resistance")})
    t = ba.label_timed(signals, rows, max_hold=30, rr_window=RR_WINDOW)
    t = t.withColumn("status", F.when(C("status") == "gap_target", "target").otherwise(C("status")))
    return _trade_out(t, "held", rnd("planned_rr", 5).alias("planned_rr"))


@query(
    "barrier_two_stage",
    q.with_ctes(
        q.BARS,
        SWING,
        STAGED_SIG,
        sided_sql("ssig", 30, "ts", 0.25),
        """ts_1 AS (SELECT ticker, i, MIN(bi) FILTER (bl <= stop) AS s, MIN(bi) FILTER (bh >= target) AS t, MIN(bi) FILTER (bh >= tp1) AS h, MAX(bi) AS last FROM ts_w GROUP BY ALL),
        ts_2 AS (SELECT *, h IS NOT NULL AND h < COALESCE(LEAST(s, t), 1000000) AS half FROM ts_1),
        ts_3 AS (SELECT w.ticker, w.i, MIN(bi) FILTER (CASE WHEN half THEN bi > h AND bl <= entry ELSE bl <= stop END) AS s2, ANY_VALUE(t) AS t, ANY_VALUE(half) AS half, ANY_VALUE(last) AS last
          FROM ts_w w JOIN ts_2 o ON o.ticker = w.ticker AND o.i = w.i GROUP BY ALL),
        ts_4 AS (SELECT v.*, half, s2, t, LEAST(COALESCE(s2, last), COALESCE(t, last)) AS j, CASE WHEN half THEN entry ELSE stop END AS flr
          FROM ts_v v JOIN ts_3 o ON o.ticker = v.ticker AND o.i = v.i),
        ts_5 AS (SELECT x.*, b.dt AS exit_date, b.open AS xo, CASE WHEN s2 <= COALESCE(t, 1000000) AND b.open <= flr THEN 'gap_stop' WHEN s2 <= COALESCE(t, 1000000) AND half THEN 'be'
          WHEN s2 <= COALESCE(t, 1000000) THEN 'stop' WHEN t IS NOT NULL THEN 'target' ELSE 'time' END AS status, b.close AS xc FROM ts_4 x JOIN bars b ON b.ticker = x.ticker AND b.i = x.j),
        ts_6 AS (SELECT *, CASE WHEN status = 'gap_stop' THEN xo WHEN status IN ('be', 'stop') THEN flr WHEN status = 'target' THEN GREATEST(xo, target) ELSE xc END AS px FROM ts_5),
        ts_7 AS (SELECT *, (px - entry) / risk AS xr, (tp1 - entry) / risk AS pr FROM ts_6),
        two AS (SELECT *, CASE WHEN half THEN 0.5 * pr + 0.5 * xr ELSE xr END - 2 * 10 / 10000.0::DOUBLE * entry / risk AS r FROM ts_7)""",
        select=f"SELECT {_TRADE_COLS}, j - e + 1 AS held FROM two",
    ),
)
def barrier_two_stage(spark, sf):
    rows = swing_table(spark, sf)
    return _trade_out(ba.label_two_stage(staged_signals(rows), rows), "held")


@query(
    "barrier_structural",
    q.with_ctes(
        q.BARS,
        SWING,
        STAGED_SIG,
        sided_sql("ssig", 30, "sx", 0.15),
        """sx_1 AS (SELECT ticker, i, MIN(bi) FILTER (bl <= stop) AS s, MIN(bi) FILTER (bh >= resistance) AS h, MAX(bi) AS last FROM sx_w
          WHERE (resistance - entry) / risk >= 0.5 GROUP BY ALL),
        sx_2 AS (SELECT *, h IS NOT NULL AND h < COALESCE(s, 1000000) AS hit FROM sx_1),
        sx_3 AS (SELECT w.ticker, w.i, MIN(bi) FILTER (bi > h AND bl <= entry) AS b, MIN(bi) FILTER (bi >= h AND bc < ema20) AS a,
          ANY_VALUE(s) AS s, ANY_VALUE(hit) AS hit, ANY_VALUE(last) AS last FROM sx_w w JOIN sx_2 o ON o.ticker = w.ticker AND o.i = w.i GROUP BY ALL),
        sx_4 AS (SELECT v.*, hit, CASE WHEN NOT hit AND s IS NOT NULL THEN 'stop' WHEN hit AND b IS NOT NULL AND b <= COALESCE(a, 1000000) THEN 'be'
          WHEN hit AND a IS NOT NULL AND a + 1 < LEAST(e + 30, n) THEN 'ema20_runner' ELSE 'time' END AS k, s, a, b, last
          FROM sx_v v JOIN sx_3 o ON o.ticker = v.ticker AND o.i = v.i),
        sx_5 AS (SELECT x.*, c.dt AS exit_date, c.open AS xo, c.close AS xc, CASE WHEN hit THEN entry ELSE stop END AS flr FROM sx_4 x
          JOIN bars c ON c.ticker = x.ticker AND c.i = CASE k WHEN 'stop' THEN s WHEN 'be' THEN b WHEN 'ema20_runner' THEN a + 1 ELSE last END),
        sx_6 AS (SELECT *, CASE WHEN k IN ('stop', 'be') AND xo <= flr THEN 'gap_stop' ELSE k END AS status FROM sx_5),
        sx_7 AS (SELECT *, (CASE WHEN status IN ('gap_stop', 'ema20_runner') THEN xo WHEN status = 'time' THEN xc ELSE flr END - entry) / risk AS xr,
          (resistance - entry) / risk AS rr FROM sx_6),
        st AS (SELECT *, CASE WHEN hit THEN 2.0::DOUBLE / 3 * rr + 1.0::DOUBLE / 3 * xr ELSE xr END - 2 * 10 / 10000.0::DOUBLE * entry / risk AS r FROM sx_7)""",
        select=f"SELECT {_TRADE_COLS}, hit AS hit_target FROM st",
    ),
)
def barrier_structural(spark, sf):
    rows = swing_table(spark, sf)
    twice = staged_signals(rows)
    return _trade_out(ba.label_structural(twice.unionByName(twice.filter(C("i") % 2 == 0)), rows), "hit_target")


@query(
    "non_overlap",
    "WITH RECURSIVE "
    + ",\n".join(
        [
            q.BARS,
            SWING,
            ANY,
            VARIANT_ROWS,
            TIMED_SIG,
            TIMED,
            "ordered AS MATERIALIZED (SELECT variant, ticker, i, held, r, status, ROW_NUMBER() OVER (PARTITION BY variant, ticker ORDER BY i) AS k FROM timed WHERE planned_rr >= min_rr)",
            """walk AS (SELECT variant, ticker, k, i, TRUE AS kept, i + held + 1 AS free FROM ordered WHERE k = 1
            UNION ALL SELECT o.variant, o.ticker, o.k, o.i, o.i >= w.free, CASE WHEN o.i >= w.free THEN o.i + o.held + 1 ELSE w.free END
            FROM walk w JOIN ordered o ON o.variant = w.variant AND o.ticker = w.ticker AND o.k = w.k + 1)""",
        ]
    )
    + "\nSELECT variant, ticker, i FROM walk WHERE kept",
)
def non_overlap(spark, sf):
    trades = timed(spark, sf).filter(C("planned_rr") >= C("min_rr"))
    return ba.non_overlap(trades, ["variant", "ticker"]).select("variant", "ticker", "i")


@query(
    "pair_rotation",
    q.with_ctes(
        q.BARS,
        SWING,
        """pairs AS (SELECT * FROM (VALUES ('MKT', 'NATION_1', 'bull'), ('MKT', 'NATION_2', 'bear'), ('NATION_3', 'NATION_4', 'bull'), ('NATION_3', 'NATION_5', 'bear')) t(under, etf, side)),
        pj AS MATERIALIZED (SELECT p.under, p.etf AS ticker, p.side, d.dt, d.open, d.high, d.low, d.close, d.atr, d.ema20, u.close AS uc, u.ema50 AS u50, u.ema200 AS u200,
          ROW_NUMBER() OVER (PARTITION BY p.under, p.etf ORDER BY d.dt) - 1 AS i, COUNT(*) OVER (PARTITION BY p.under, p.etf) AS n
          FROM pairs p JOIN sw d ON d.ticker = p.etf JOIN sw u ON u.ticker = p.under AND u.dt = d.dt)""",
        f"""pk AS (SELECT *, MAX(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ph, MIN(low) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 0.5 * atr AS stop,
          LEAD(open) OVER w AS entry, LEAD(dt) OVER w AS entry_date, ABS(uc / LAG(uc, 63) OVER w - 1) AS mom, i + 1 AS e FROM pj WINDOW w AS (PARTITION BY under, ticker ORDER BY i)),
        ps AS (SELECT * FROM pk WHERE i >= 201 AND e < n AND close > ph AND stop < entry AND (entry - stop) / entry <= 0.20
          AND CASE side WHEN 'bull' THEN uc > u200 AND u50 > u200 ELSE uc < u200 AND u50 < u200 END),
        pw AS (SELECT s.under, s.ticker, s.i, s.e, s.n, s.entry, s.entry_date, s.stop, s.mom, s.side, b.i AS bi, b.low AS bl, b.close AS bc, b.ema20 AS be, b.open AS bo
          FROM ps s JOIN pj b ON b.under = s.under AND b.ticker = s.ticker AND b.i >= s.e AND b.i < s.e + 30),
        ph AS (SELECT under, ticker, i, e, n, entry, entry_date, stop, mom, side, MIN(bi) FILTER (bl <= stop) AS s, MIN(bi) FILTER (bc < be) AS a, MAX(bi) AS last FROM pw GROUP BY ALL),
        pq AS (SELECT *, CASE WHEN s IS NOT NULL AND s <= COALESCE(a, 1000000) THEN 'stop' WHEN a IS NOT NULL AND a + 1 < LEAST(e + 30, n) THEN 'trail' ELSE 'time' END AS k FROM ph),
        px AS (SELECT q.*, b.dt AS exit_date, b.open AS xo, b.close AS xc FROM pq q JOIN pj b ON b.under = q.under AND b.ticker = q.ticker AND b.i = CASE k WHEN 'stop' THEN s WHEN 'trail' THEN a + 1 ELSE last END),
        pr AS (SELECT *, CASE WHEN k = 'stop' AND xo <= stop THEN 'gap_stop' ELSE k END AS status FROM px)""",
        select="""SELECT under, ticker, side, CAST(entry_date AS VARCHAR) AS entry_date, CAST(exit_date AS VARCHAR) AS exit_date, status,
        ROUND(CASE status WHEN 'stop' THEN stop WHEN 'time' THEN xc ELSE xo END / entry - 1 - 0.002, 6) + 0 AS ret, mom AS momentum FROM pr""",
    ),
)
def pair_rotation(spark, sf):
    from tapeloom.operators.rotation import pair_trades

    pairs = {"MKT": ("NATION_1", "NATION_2"), "NATION_3": ("NATION_4", "NATION_5")}
    t = pair_trades(swing_table(spark, sf), pairs)
    return t.select("under", "ticker", "side", day("entry_date"), day("exit_date"), "status", rnd("ret").alias("ret"), "momentum")
