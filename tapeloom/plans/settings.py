"""Queries that run whole grids of settings over one labelled pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import barriers as ba
from tapeloom.operators import regimes as rg
from tapeloom.operators import rotation as ro
from tapeloom.operators import signals as sg
from tapeloom.plans import research as re_
from tapeloom.plans import sql as q
from tapeloom.plans.registry import query
from tapeloom.plans.windows import rnd
from tapeloom.session import kept

C = F.col
SPLIT = "1999-01-01"
_WIN = "AVG(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END)"
_PF = "SUM(CASE WHEN r > 0 THEN r ELSE 0 END) / NULLIF(-SUM(CASE WHEN r < 0 THEN r END), 0)"
_STATS = f"""COUNT(*) AS n, ROUND({_WIN}, 6) AS win, ROUND(AVG(r), 6) + 0 AS avg_r, ROUND({_PF}, 5) AS pf, ROUND(AVG(held), 5) AS hold,
  COUNT(*) FILTER (entry_date >= DATE '{SPLIT}') AS later_n, ROUND(AVG(r) FILTER (entry_date >= DATE '{SPLIT}'), 6) + 0 AS later_avg"""


def stats(trades, *keys):
    """One row per setting: trades, win share, mean R, profit factor, bars held, and the part after the split."""
    r, later = C("r"), C("entry_date") >= SPLIT
    lost = -F.sum(F.when(r < 0, r))
    found = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win"),
        F.avg(r).alias("avg_r"),
        F.try_divide(F.sum(F.when(r > 0, r).otherwise(0.0)), F.when(lost != 0, lost)).alias("pf"),
        F.avg("held").alias("hold"),
        F.count_if(later).alias("later_n"),
        F.avg(F.when(later, r)).alias("later_avg"),
    )
    return found.select(*keys, "n", rnd("win").alias("win"), rnd("avg_r").alias("avg_r"), rnd("pf", 5).alias("pf"),
                        rnd("hold", 5).alias("hold"), "later_n", rnd("later_avg").alias("later_avg"))


# ---- 36 reversion variants -------------------------------------------------

VARIANTS = sg.variant_grid()
HOLDS = sorted({v.max_hold for v in VARIANTS})
_ROWS = re_.variant_rows_sql(VARIANTS)


def _reversion_sql(hold: int) -> tuple[str, ...]:
    """Labels of the distinct signals of one holding time."""
    name = f"rv{hold}"
    return (
        f"{name}_g AS (SELECT DISTINCT side, ticker, i, stop FROM vsig WHERE max_hold = {hold})",
        re_.sided_sql(f"{name}_g", hold, name),
        re_.moved_sql(name, "CASE WHEN lng THEN bc > ema5 ELSE bc < ema5 END AND bi + 1 < n", "ema5_recovery", "n", hold),
    )


_ALL = " UNION ALL ".join(
    f"SELECT v.variant, v.ticker, v.i, t.held, t.r, t.entry_date FROM vsig v JOIN rv{h} t ON t.side = v.side AND t.ticker = v.ticker AND t.i = v.i AND t.stop = v.stop WHERE v.max_hold = {h}"
    for h in HOLDS
)


@query(
    "variant_settings",
    "WITH RECURSIVE "
    + ",\n".join(
        [
            q.BARS,
            re_.SWING,
            re_.ANY,
            _ROWS,
            *[x for h in HOLDS for x in _reversion_sql(h)],
            f"ordered AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY variant, ticker ORDER BY i) AS k FROM ({_ALL}))",
            """walk AS (SELECT variant, ticker, k, TRUE AS kept, i + held + 1 AS free FROM ordered WHERE k = 1
            UNION ALL SELECT o.variant, o.ticker, o.k, o.i >= w.free, CASE WHEN o.i >= w.free THEN o.i + o.held + 1 ELSE w.free END
            FROM walk w JOIN ordered o ON o.variant = w.variant AND o.ticker = w.ticker AND o.k = w.k + 1)""",
        ]
    )
    + f"\nSELECT variant, {_STATS} FROM ordered JOIN walk USING (variant, ticker, k) WHERE kept GROUP BY variant",
)
def variant_settings(spark, sf):
    """Trades that do not overlap, per variant; bars are labelled once per stop and holding time."""
    rows = re_.variant_input(spark, sf)
    legs = sg.leg_signals(rows.filter(~C("ticker").isin(*re_.INDEXES)), VARIANTS, min_volume=10.0)
    labelled = ba.label_reversion(legs, rows, max(HOLDS), carry=("fired",), own_hold=True)
    trades = kept(sg.of_variants(labelled, VARIANTS), "trades")
    return stats(ba.non_overlap(trades, ["variant", "ticker"]), "variant")


# ---- 16 momentum settings --------------------------------------------------

MOMENTUM = {
    f"f{m.formation}_b{m.breakout}_s{m.stop_lookback}_t{m.trail_ema}": m
    for m in sg.momentum_grid(rank_pct=0.4, min_volume=10.0, min_dollar_volume=1_000.0, min_names=5)
}


def _momentum_sql() -> tuple[str, ...]:
    formations = sorted({(m.formation, m.skip) for m in MOMENTUM.values()})
    panels = [re_.panel_sql(f, s).replace("panel AS", f"panel{f} AS").replace("xs AS", f"xs{f} AS").replace("FROM panel)", f"FROM panel{f})") for f, s in formations]
    lags = ", ".join(
        f"{q.full('MAX', 'high', n, 1)} AS top{n}, {q.full('MIN', 'low', n, 1)} AS floor{n}" for n in sorted({m.breakout for m in MOMENTUM.values()})
    )
    stops = ", ".join(
        f"{q.full('MIN', 'low', n)} AS low{n}, {q.full('MAX', 'high', n)} AS high{n}" for n in sorted({m.stop_lookback for m in MOMENTUM.values()})
    )
    flags = "PARTITION BY s.ticker ORDER BY s.i ROWS UNBOUNDED PRECEDING"
    base = f"""mrows AS MATERIALIZED (SELECT s.*, {lags}, {stops}, COALESCE(LAST_VALUE(r.bull IGNORE NULLS) OVER ({flags}), FALSE) AS bull,
  COALESCE(LAST_VALUE(r.bear IGNORE NULLS) OVER ({flags}), FALSE) AS bear, {", ".join(f"x{f}.rank AS rank{f}" for f, _ in formations)}
  FROM sw s LEFT JOIN rany r ON r.dt = s.dt {" ".join(f"LEFT JOIN xs{f} x{f} ON x{f}.ticker = s.ticker AND x{f}.dt = s.dt AND x{f}.names >= 5" for f, _ in formations)})""".replace(
        "PARTITION BY ticker ORDER BY i", "PARTITION BY s.ticker ORDER BY s.i"
    )
    signals = []
    for name, m in MOMENTUM.items():
        start = max(205, m.formation + 1, m.breakout + 1, m.stop_lookback + 1)
        signals.append(
            f"""SELECT '{name}' AS variant, 'ema{m.trail_ema}' AS trail, ticker, i, side,
  CASE side WHEN 'long' THEN low{m.stop_lookback} - 0.5 * atr ELSE high{m.stop_lookback} + 0.5 * atr END AS stop FROM (
  SELECT *, CASE WHEN rank{m.formation} >= 0.6 AND bull AND close > ema200 AND ema50 > ema200 AND close > top{m.breakout} THEN 'long'
    WHEN rank{m.formation} <= 0.4 AND bear AND close < ema200 AND ema50 < ema200 AND close < floor{m.breakout} THEN 'short' END AS side
  FROM mrows WHERE i >= {start} AND i < n - 1 AND vol20 >= 10 AND close * vol20 >= 1000 AND volume >= 0.8 * vol20 AND ticker NOT IN {re_.IDX}) WHERE side IS NOT NULL"""
        )
    trails = sorted({m.trail_ema for m in MOMENTUM.values()})
    labels = []
    for t in trails:
        labels.append(f"m{t}_g AS (SELECT DISTINCT ticker, i, side, stop FROM msig WHERE trail = 'ema{t}')")
        labels.append(re_.sided_sql(f"m{t}_g", 40, f"m{t}", 0.15).replace("b.ema20,", "b.ema20, b.ema10,"))
        labels.append(re_.moved_sql(f"m{t}", f"CASE WHEN lng THEN bc < ema{t} ELSE bc > ema{t} END", "ema_trail", "LEAST(e + 40, n)", 40))
    return (q.BARS, re_.SWING, re_.ANY, re_.PANEL, *panels, base, f"msig AS MATERIALIZED ({' UNION ALL '.join(signals)})", *labels)


@query(
    "momentum_settings",
    q.with_ctes(
        *_momentum_sql(),
        "mtrades AS ("
        + " UNION ALL ".join(
            f"SELECT g.variant, t.held, t.r, t.entry_date FROM msig g JOIN m{t} t ON t.ticker = g.ticker AND t.i = g.i AND t.side = g.side AND t.stop = g.stop WHERE g.trail = 'ema{t}'"
            for t in sorted({m.trail_ema for m in MOMENTUM.values()})
        )
        + ")",
        select=f"SELECT variant, {_STATS} FROM mtrades GROUP BY variant",
    ),
)
def momentum_settings(spark, sf):
    rows = re_.swing_table(spark, sf)
    found = sg.momentum_signals(rows, rg.regime_any(rows, re_.INDEXES), MOMENTUM).filter(~C("ticker").isin(*re_.INDEXES))
    signals = kept(found.select("variant", "ticker", "i", "side", "stop", "trail"), "signals")
    return stats(ba.label_trail(signals, rows, ("ema10", "ema20"), max_hold=40), "variant")


# ---- 18 rotation settings --------------------------------------------------

ROTATION = ro.rotation_grid()
PAIRS = {"MKT": ("NATION_1", "NATION_2"), "NATION_3": ("NATION_4", "NATION_5")}
_SETTINGS = "settings AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{s.name}', {s.trail_ema}, {s.stop_lookback}, {s.atr_buffer})" for s in ROTATION
) + ") t(setting, trail, lookback, buf))"


@query(
    "rotation_settings",
    q.with_ctes(
        q.BARS,
        re_.SWING,
        _SETTINGS,
        """pairs AS (SELECT * FROM (VALUES ('MKT', 'NATION_1', 'bull'), ('MKT', 'NATION_2', 'bear'), ('NATION_3', 'NATION_4', 'bull'), ('NATION_3', 'NATION_5', 'bear')) t(under, etf, side)),
        pj AS MATERIALIZED (SELECT p.under, p.etf AS ticker, p.side, d.dt, d.open, d.high, d.low, d.close, d.atr, d.ema10, d.ema20, u.close AS uc, u.ema50 AS u50, u.ema200 AS u200,
          ROW_NUMBER() OVER (PARTITION BY p.under, p.etf ORDER BY d.dt) - 1 AS i, COUNT(*) OVER (PARTITION BY p.under, p.etf) AS n
          FROM pairs p JOIN sw d ON d.ticker = p.etf JOIN sw u ON u.ticker = p.under AND u.dt = d.dt)""",
        """pk AS (SELECT *, MAX(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS ph, MIN(low) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l10,
          MIN(low) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l20, MIN(low) OVER (w ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS l40,
          LEAD(open) OVER w AS entry, LEAD(dt) OVER w AS entry_date, i + 1 AS e FROM pj WINDOW w AS (PARTITION BY under, ticker ORDER BY i)),
        ps0 AS (SELECT pk.*, setting, trail, CASE lookback WHEN 10 THEN l10 WHEN 20 THEN l20 ELSE l40 END - buf * atr AS stop FROM pk, settings),
        ps AS (SELECT * FROM ps0 WHERE i >= 201 AND e < n AND close > ph AND stop < entry AND (entry - stop) / entry <= 0.20
          AND CASE side WHEN 'bull' THEN uc > u200 AND u50 > u200 ELSE uc < u200 AND u50 < u200 END),
        pw AS (SELECT s.setting, s.under, s.ticker, s.i, s.e, s.n, s.entry, s.entry_date, s.stop, b.i AS bi, b.low AS bl, b.close AS bc, CASE s.trail WHEN 10 THEN b.ema10 ELSE b.ema20 END AS be
          FROM ps s JOIN pj b ON b.under = s.under AND b.ticker = s.ticker AND b.i >= s.e AND b.i < s.e + 30),
        ph AS (SELECT setting, under, ticker, i, e, n, entry, entry_date, stop, MIN(bi) FILTER (bl <= stop) AS s, MIN(bi) FILTER (bc < be) AS a, MAX(bi) AS last FROM pw GROUP BY ALL),
        pq AS (SELECT *, CASE WHEN s IS NOT NULL AND s <= COALESCE(a, 1000000) THEN 'stop' WHEN a IS NOT NULL AND a + 1 < LEAST(e + 30, n) THEN 'trail' ELSE 'time' END AS k FROM ph),
        px AS (SELECT q.*, b.open AS xo, b.close AS xc FROM pq q JOIN pj b ON b.under = q.under AND b.ticker = q.ticker AND b.i = CASE k WHEN 'stop' THEN s WHEN 'trail' THEN a + 1 ELSE last END),
        pr AS (SELECT *, CASE WHEN k = 'stop' AND xo <= stop THEN 'gap_stop' ELSE k END AS status FROM px),
        pt AS (SELECT *, CASE status WHEN 'stop' THEN stop WHEN 'time' THEN xc ELSE xo END / entry - 1 - 0.002 AS ret FROM pr)""",
        select=f"""SELECT setting, COUNT(*) AS n, ROUND(AVG(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win, ROUND(AVG(ret), 6) + 0 AS avg_ret,
        COUNT(*) FILTER (status = 'trail') AS trailed, COUNT(*) FILTER (entry_date >= DATE '{SPLIT}') AS later_n FROM pt GROUP BY setting""",
    ),
)
def rotation_settings(spark, sf):
    t = ro.pair_trades(re_.swing_table(spark, sf), PAIRS, ROTATION)
    found = t.groupBy("setting").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(C("ret") > 0, 1.0).otherwise(0.0)).alias("win"),
        F.avg("ret").alias("avg_ret"),
        F.count_if(C("status") == "trail").alias("trailed"),
        F.count_if(C("entry_date") >= SPLIT).alias("later_n"),
    )
    return found.select("setting", "n", rnd("win").alias("win"), rnd("avg_ret").alias("avg_ret"), "trailed", "later_n")
