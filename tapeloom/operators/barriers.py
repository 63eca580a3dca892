"""Outcome of entry signals: which exit is reached first on the bars after the fill.

A signal fills at the next bar's open and is followed for a bounded number of bars. The first bar
that touches each exit's level is found through block extremes (``touch``), for all legs of all
brackets in the same pass; closes beyond an average do not depend on the signal and are looked up
per bar. The exit bar itself is then fetched by one equality join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import rolling as r
from tapeloom.operators.touch import Touch, extremes, first_touches, next_where
from tapeloom.session import safe_unions

C = F.col
MAX_WALK = 504

# Entry cost tiers (dollar volume below, basis points) and exit cost by status.
ENTRY_TIERS = ((25e6, 35.0), (100e6, 22.0), (500e6, 13.0))
ENTRY_TOP = 8.0
EXIT_BPS = {"target": 3.0, "gap_target": 12.0, "stop": 18.0, "gap_stop": 55.0, "unresolved": 15.0}
# How far a price must pass a target to fill it (basis points), and the share of a gap that is kept.
QUEUE_BPS = 10.0
GIVEBACK = 0.5

# Features that candidates are ranked by.
RANK_FEATURES = (
    "ret252 ret126 ret21 rsi2 rsi atr_ratio vol_ratio dist_hh60 dist_ema20 ddv atr_pct".split()
)


@dataclass(frozen=True)
class Bracket:
    sl_atr: float = 2.0
    rr: float = 2.0
    sl_mode: str = "atr"
    swing_lookback: int = 10
    swing_buffer_atr: float = 0.1

    def stop(self) -> Column:
        if self.sl_mode == "atr":
            return C("entry") - self.sl_atr * C("atr")
        return C(f"ll{self.swing_lookback}") - self.swing_buffer_atr * C("atr")

    def target(self) -> Column:
        return C("entry") + self.rr * (C("entry") - self.stop())


# The grid of brackets.
def bracket_grid() -> list[Bracket]:
    """The 35 brackets of the full search."""
    return [Bracket(s, rr) for s, rr in product((1.0, 1.5, 2.0, 2.5, 3.0), (0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0))]


# The brackets of the volatility tiers.
def tier_brackets() -> list[Bracket]:
    """The 24 brackets of the tier search."""
    return [Bracket(s, rr) for s, rr in product((1.0, 1.5, 2.0, 3.0), (0.5, 1.0, 2.0, 3.0, 4.0, 6.0))]


def entry_bps(ddv: Column) -> Column:
    bps = F.when(ddv.isNull(), ENTRY_TIERS[0][1])
    for cap, cost in ENTRY_TIERS:
        bps = bps.when(ddv < cap, cost)
    return bps.otherwise(ENTRY_TOP)


def exit_bps(status: Column) -> Column:
    costs = F.create_map(*[F.lit(x) for pair in EXIT_BPS.items() for x in pair])
    return costs[status]


def with_fill(bars: DataFrame) -> DataFrame:
    """Adds the next bar (entry price, date, position ``e``) and the ticker's bar count ``n``."""
    return bars.withColumns(
        {
            "entry": F.lead("open").over(r.by_ticker()),
            "entry_date": F.lead("dt").over(r.by_ticker()),
            "e": C("i") + 1,
            "n": r.bars_count(),
        }
    )


def _path(horizon: int | Column) -> list[Column]:
    """Positions of the first and last bar that a filled signal is followed over."""
    return [C("e").alias("from_"), (F.least(C("e") + horizon, C("n")) - 1).alias("upto_")]


def _exit_bar(found: DataFrame, bars: DataFrame) -> DataFrame:
    """Fetch the bar at position ``j`` of each row."""
    side = bars.select(
        "ticker",
        C("i").alias("j"),
        C("dt").alias("exit_date"),
        *[C(c).alias(f"x_{c}") for c in ("open", "high", "low", "close")],
    )
    return found.join(side, ["ticker", "j"])


def label_brackets(
    features: DataFrame,
    signals: DataFrame,
    brackets: dict[int, Bracket],
    eval_end: str | Column | None = None,
    min_risk: float = 0.005,
    max_risk: float = 0.50,
    max_gap_days: int = 4,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Label each signal (ticker, i) once for every bracket: exit, status and net R.

    ``features`` is the feature table; ``signals`` may carry further columns named in ``carry``.
    Signals after ``eval_end`` are left out: they may lack the bars to reach an exit (``evaluation_end``).
    """
    filled = with_fill(features)
    keep = ["ticker", "i", *carry]
    s = filled.join(signals.select(keep), ["ticker", "i"])
    ok = (
        (C("e") < C("n"))
        & (F.datediff("entry_date", "dt") <= max_gap_days)
        & C("atr").isNotNull()
        & (C("entry") > 0)
    )
    if eval_end is not None:
        ok = ok & (C("dt") <= (F.lit(eval_end).cast("date") if isinstance(eval_end, str) else eval_end))
    s = s.filter(ok)

    # First touching bar of every distinct stop and target, in one pass over the paths.
    narrow = s.select("ticker", "i", *_path(MAX_WALK), "entry", "atr", *[c for c in ("ll10", "ll20") if _uses(brackets, c)])
    touches = {}
    for k, b in brackets.items():
        sl, tp = b.stop(), b.target()
        touches.setdefault(_stop_name(b), Touch(low=sl, low_open=sl, entry_open=False))
        touches[f"t{k}"] = Touch(high=tp * (1 + QUEUE_BPS / 10000.0), high_open=tp, entry_open=False)
    first = first_touches(narrow, features, touches, ["ticker", "i"], MAX_WALK)

    legs = F.array(
        *[
            F.struct(
                F.lit(k).alias("bracket"),
                b.stop().alias("sl"),
                b.target().alias("tp"),
                (F.lit(b.sl_atr) * C("atr") / C("close") if b.sl_mode == "atr" else F.lit(None).cast("double")).alias("frac"),
                C(_stop_name(b)).alias("s"),
                C(f"t{k}").alias("t"),
            )
            for k, b in brackets.items()
        ]
    )
    kept = ["ticker", "i", "dt", "entry", "entry_date", "e", "n", "close", "atr"]
    extra = [c for c in dict.fromkeys([*RANK_FEATURES, *carry]) if c not in kept]
    lows = [c for c in ("ll10", "ll20") if _uses(brackets, c)]
    rows = s.select(*kept, *extra, *lows).join(first, ["ticker", "i"])
    rows = rows.select("ticker", "i", "dt", "entry", "entry_date", "e", "n", *extra, F.inline(legs))
    risk = C("entry") - C("sl")
    rows = rows.filter((risk > 0) & (C("frac").isNull() | C("frac").between(min_risk, max_risk)))
    last = F.least(C("e") + MAX_WALK, C("n")) - 1
    rows = _exit_bar(rows.withColumn("j", F.least("s", "t", last)), features)

    o, later = C("x_open"), C("j") > C("e")
    status = (
        F.when(later & (o <= C("sl")), F.lit("gap_stop"))
        .when(later & (o >= C("tp")), F.lit("gap_target"))
        .when(C("x_low") <= C("sl"), F.lit("stop"))
        .when(C("x_high") >= C("tp") * (1 + QUEUE_BPS / 10000.0), F.lit("target"))
        .otherwise(F.lit("unresolved"))
    )
    rows = rows.withColumn("status", status)
    px = (
        F.when(C("status") == "gap_stop", o)
        .when(C("status") == "gap_target", C("tp") + GIVEBACK * (o - C("tp")))
        .when(C("status") == "stop", C("sl"))
        .when(C("status") == "target", C("tp"))
        .otherwise(C("x_close"))
    )
    rows = rows.withColumns({"px": px, "risk_pct": risk / C("entry"), "bars": C("j") - C("e") + 1})
    fee = (C("entry") * entry_bps(C("ddv")) + C("px") * exit_bps(C("status"))) / 10000.0
    return rows.withColumn("r", (C("px") - C("entry") - fee) / risk).select(
        "bracket",
        "ticker",
        "i",
        C("dt").alias("signal_date"),
        "entry_date",
        "exit_date",
        "entry",
        "sl",
        "tp",
        "risk_pct",
        "r",
        "status",
        "bars",
        *extra,
    )


def evaluation_end(bars: DataFrame, buffer_days: int = 120) -> Column:
    """The last signal date to label, so many days before the newest bar, as a scalar subquery."""
    return F.date_sub(bars.agg(F.max("dt")).scalar(), buffer_days)


def _uses(brackets: dict[int, Bracket], column: str) -> bool:
    return any(b.sl_mode != "atr" and column == f"ll{b.swing_lookback}" for b in brackets.values())


def _stop_name(b: Bracket) -> str:
    text = f"s_{b.sl_atr}" if b.sl_mode == "atr" else f"s_swing{b.swing_lookback}_{b.swing_buffer_atr}"
    return text.replace(".", "_")


# Labels below take signals(ticker, i, side, stop, ...) and give one row per valid trade.


def _sided(value_long: Column, value_short: Column) -> Column:
    return F.when(C("side") == "long", value_long).otherwise(value_short)


def _filled_signals(signals: DataFrame, bars: DataFrame, events: dict[str, Column] | None = None) -> DataFrame:
    """Signals with their fill; of ``events`` the position of the first bar from the fill on where each holds."""
    ahead = {name: next_where(event) for name, event in (events or {}).items()}
    fill = with_fill(bars).withColumns(ahead).select("ticker", "i", "entry", "entry_date", "e", "n", *ahead)
    s = signals.join(fill, ["ticker", "i"]).filter(C("e") < C("n"))
    s = s.withColumn("risk", _sided(C("entry") - C("stop"), C("stop") - C("entry")))
    return s.filter(C("risk") > 0)


def _stopped() -> Touch:
    """The stop, touched by an open or an extreme."""
    long, short = F.when(C("side") == "long", C("stop")), F.when(C("side") == "short", C("stop"))
    return Touch(low=long, low_open=long, high=short, high_open=short)


def _net_r(px: Column, cost_bps: float) -> Column:
    gross = _sided(px - C("entry"), C("entry") - px) / C("risk")
    return gross - F.lit(2 * cost_bps / 10_000) * C("entry") / C("risk")


def _hold(horizon: int) -> Column:
    return C("max_hold") if horizon < 0 else F.lit(horizon)


def _trade(rows: DataFrame, px: Column, cost_bps: float, keys: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    rows = rows.withColumn("exit", px)
    return rows.select(
        *keys,
        "i",
        "entry_date",
        "exit_date",
        "entry",
        "exit",
        "risk",
        _net_r(C("exit"), cost_bps).alias("r"),
        "status",
        (C("j") - C("e") + 1).alias("held"),
        *extra,
    )


def _keys(signals: DataFrame) -> list[str]:
    return [c for c in ("variant", "ticker", "side") if c in signals.columns]


def label_timed(
    signals: DataFrame,
    bars: DataFrame,
    max_hold: int,
    cost_bps: float = 10.0,
    rr_window: tuple[float, float] | None = None,
) -> DataFrame:
    """Stop or target within ``max_hold`` bars, else the last close. Long and short.

    On one bar the order is: open beyond stop, stop, open beyond target, target.
    """
    keys = _keys(signals)
    s = _filled_signals(signals, bars)
    reward = _sided(C("target") - C("entry"), C("entry") - C("target"))
    s = s.filter(reward > 0).withColumn("planned_rr", reward / C("risk"))
    if rr_window is not None:
        s = s.filter(C("planned_rr").between(*rr_window))
    reached = Touch(high=F.when(C("side") == "long", C("target")), low=F.when(C("side") == "short", C("target")))
    group = [*keys, "i"]
    narrow = s.select(*dict.fromkeys([*group, "side"]), *_path(max_hold), "stop", "target")
    first = first_touches(narrow, bars, {"s": _stopped(), "t": reached}, group, max_hold)
    rows = s.join(first, group).withColumn("j", F.least("s", "t", F.least(C("e") + max_hold, C("n")) - 1))
    rows = _exit_bar(rows, bars)
    o, stop, target = C("x_open"), C("stop"), C("target")
    status = (
        F.when(_sided(o <= stop, o >= stop), F.lit("gap_stop"))
        .when(_sided(C("x_low") <= stop, C("x_high") >= stop), F.lit("stop"))
        .when(_sided(o >= target, o <= target), F.lit("gap_target"))
        .when(_sided(C("x_high") >= target, C("x_low") <= target), F.lit("target"))
        .otherwise(F.lit("time"))
    )
    rows = rows.withColumn("status", status)
    px = (
        F.when(C("status").isin("gap_stop", "gap_target"), o)
        .when(C("status") == "stop", stop)
        .when(C("status") == "target", target)
        .otherwise(C("x_close"))
    )
    extra = ("planned_rr",) + (("min_rr",) if "min_rr" in signals.columns else ())
    return _trade(rows, px, cost_bps, keys, extra)


def _stop_or(rows: DataFrame, bars: DataFrame, status: str, limit: Column) -> tuple[DataFrame, Column]:
    """Exit at the stop when bar ``s`` is not after bar ``a``; else at the open after ``a`` while below ``limit``."""
    stopped = C("s").isNotNull() & (C("a").isNull() | (C("s") <= C("a")))
    moved = ~stopped & C("a").isNotNull() & (C("a") + 1 < limit)
    last = F.least(C("e") + C("hold_"), C("n")) - 1
    rows = rows.withColumns({"stopped_": stopped, "moved_": moved})
    rows = rows.withColumn("j", F.when(C("stopped_"), C("s")).when(C("moved_"), C("a") + 1).otherwise(last))
    rows = _exit_bar(rows, bars)
    gap = _sided(C("x_open") <= C("stop"), C("x_open") >= C("stop"))
    rows = rows.withColumn(
        "status",
        F.when(C("stopped_") & gap, F.lit("gap_stop"))
        .when(C("stopped_"), F.lit("stop"))
        .when(C("moved_"), F.lit(status))
        .otherwise(F.lit("time")),
    )
    px = (
        F.when(C("status") == "gap_stop", C("x_open"))
        .when(C("stopped_"), C("stop"))
        .when(C("moved_"), C("x_open"))
        .otherwise(C("x_close"))
    )
    return rows, px


def label_reversion(
    signals: DataFrame, bars: DataFrame, max_hold: int, cost_bps: float = 10.0, carry: tuple[str, ...] = (), own_hold: bool = False
) -> DataFrame:
    """Stop, or the open after the first close beyond ema5, which may lie past ``max_hold``.

    With ``own_hold`` each signal has its own ``max_hold``, at most the given one.
    """
    keys = _keys(signals)
    s = _filled_signals(signals, bars, {"above_": C("close") > C("ema5"), "below_": C("close") < C("ema5")})
    rows = _with_stops(s, bars, keys, max_hold, _sided(C("above_"), C("below_")), C("max_hold") if own_hold else None)
    rows = rows.withColumn("a", F.when(C("a") + 1 < C("n"), C("a")))
    rows, px = _stop_or(rows, bars, "ema5_recovery", C("n"))
    return _trade(rows, px, cost_bps, keys, carry)


def _with_stops(s: DataFrame, bars: DataFrame, keys: list[str], longest: int, event: Column, hold: Column | None = None) -> DataFrame:
    """Adds ``s``, the first bar at the stop, and ``a``, the event's bar, both inside ``hold`` bars."""
    group, hold = [*keys, "i"], F.lit(longest) if hold is None else hold
    paths = s.select(*dict.fromkeys([*group, "side"]), *_path(hold), "stop")
    first = first_touches(paths, bars, {"s": _stopped()}, group, longest)
    inside = F.when(event < C("e") + hold, event)
    return s.join(first, group).withColumns({"hold_": hold, "a": inside})


def label_trail(
    signals: DataFrame, bars: DataFrame, trail: str | tuple[str, ...], max_hold: int, cost_bps: float = 10.0, max_risk: float = 0.15
) -> DataFrame:
    """Stop, or the open after a close beyond the trailing average, inside ``max_hold``; adds ``mfe_r``.

    With several averages each signal names its own in ``trail``; all share one pass. The best
    excursion counts the bars up to the exit, without the bar sold at its open.
    """
    keys = _keys(signals)
    trails = (trail,) if isinstance(trail, str) else trail
    events = {f"above_{t}_": C("close") > C(t) for t in trails} | {f"below_{t}_": C("close") < C(t) for t in trails}
    s = _filled_signals(signals, bars, events)
    s = s.filter(C("risk") / C("entry") <= max_risk)
    group = [*keys, "i"]
    crossed = [_sided(C(f"below_{t}_"), C(f"above_{t}_")) for t in trails]
    crossing = crossed[0] if isinstance(trail, str) else F.coalesce(*[F.when(C("trail") == t, c) for t, c in zip(trails, crossed)])
    limit = F.least(C("e") + max_hold, C("n"))
    rows = _with_stops(s, bars, keys, max_hold, crossing)
    rows, px = _stop_or(rows, bars, "ema_trail", limit)
    rows = rows.withColumn("px", px)
    upto = F.when(C("moved_"), C("j") - 1).otherwise(C("j"))
    seen = extremes(rows.select(*group, C("e").alias("from_"), upto.alias("upto_")), bars, group, max_hold)
    best = _sided(C("top") - C("entry"), C("entry") - C("bottom")) / C("risk")
    mfe = rows.select(*dict.fromkeys([*group, "side"]), "entry", "risk").join(seen, group).select(*group, F.greatest(best, F.lit(0.0)).alias("mfe_r"))
    return _trade(rows.join(mfe, group), C("px"), cost_bps, keys, ("mfe_r",))


def label_two_stage(signals: DataFrame, bars: DataFrame, max_hold: int = 30, cost_bps: float = 10.0, max_risk: float = 0.25) -> DataFrame:
    """Half out at ``tp1``, then the stop moves to the entry from the next bar; the rest runs to ``target``. Long only."""
    s = _filled_signals(signals.withColumn("side", F.lit("long")), bars)
    s = s.filter(C("risk") / C("entry") <= max_risk)
    group = ["ticker", "i"]
    reach = lambda level: Touch(high=C(level), high_open=C(level))
    touches = {"s": Touch(low=C("stop"), low_open=C("stop")), "t": reach("target"), "h": reach("tp1")}
    first = first_touches(s.select(*group, *_path(max_hold), "stop", "tp1", "target"), bars, touches, group, max_hold)
    rows = _back_at_entry(s.join(first, group), bars, group, max_hold)
    last = F.least(C("e") + max_hold, C("n")) - 1
    early = F.least("s", "t")
    half = C("h").isNotNull() & (early.isNull() | (C("h") < early))
    rows = rows.withColumns({"half": half, "b": F.when(half, C("b"))})
    rows = rows.withColumn("j", F.when(C("half"), F.least("b", "t", last)).otherwise(F.least("s", "t", last)))
    fall = F.when(C("half"), C("b")).otherwise(C("s"))
    fell = fall.isNotNull() & (C("t").isNull() | (fall <= C("t")))
    # Told from the touching bars, not from the exit bar: a stop raised on the last bar does not count on it.
    rows = rows.withColumns({"fell_": fell, "won_": ~fell & C("t").isNotNull()})
    rows = _exit_bar(rows, bars).withColumn("floor_", F.when(C("half"), C("entry")).otherwise(C("stop")))
    fell, won = C("fell_"), C("won_")
    gap = fell & (C("x_open") <= C("floor_"))
    rows = rows.withColumn(
        "status",
        F.when(gap, F.lit("gap_stop"))
        .when(fell & C("half"), F.lit("be"))
        .when(fell, F.lit("stop"))
        .when(won, F.lit("target"))
        .otherwise(F.lit("time")),
    )
    px = (
        F.when(gap, C("x_open"))
        .when(fell, C("floor_"))
        .when(won, F.greatest("x_open", "target"))
        .otherwise(C("x_close"))
    )
    rows = rows.withColumn("exit", px)
    exit_r = (C("exit") - C("entry")) / C("risk")
    part = (C("tp1") - C("entry")) / C("risk")
    cost = F.lit(2 * cost_bps / 10_000) * C("entry") / C("risk")
    r_ = F.when(C("half"), 0.5 * part + 0.5 * exit_r).otherwise(exit_r) - cost
    return rows.select(
        "ticker", "i", "entry_date", "exit_date", "entry", "exit", "risk", r_.alias("r"), "status",
        (C("j") - C("e") + 1).alias("held"),
    )


def _back_at_entry(rows: DataFrame, bars: DataFrame, group: list[str], max_hold: int) -> DataFrame:
    """Adds ``b``, the first bar after ``h`` that falls back to the entry price."""
    after = rows.filter(C("h").isNotNull()).select(*group, (C("h") + 1).alias("from_"), _path(max_hold)[1], "entry")
    back = {"b": Touch(low=C("entry"), low_open=C("entry"))}
    return rows.join(first_touches(after.filter(C("from_") <= C("upto_")), bars, back, group, max_hold), group, "left")


def label_structural(
    signals: DataFrame,
    bars: DataFrame,
    max_hold: int = 30,
    cost_bps: float = 10.0,
    min_rr: float = 0.50,
    max_risk: float = 0.15,
) -> DataFrame:
    """Two thirds out at prior resistance; the rest trails ema20 with its stop at the entry. Long only.

    ``signals`` carry stop and resistance. A close below ema20 on the touching bar already arms
    the trail, while the raised stop counts from the bar after it.
    """
    safe_unions(signals.sparkSession)  # the caller's signals are often stacked
    unique = signals.dropDuplicates(["ticker", "i"])
    s = _filled_signals(unique.withColumn("side", F.lit("long")), bars)
    s = s.withColumn("planned_rr", (C("resistance") - C("entry")) / C("risk"))
    s = s.filter((C("i") >= 60) & (C("risk") / C("entry") <= max_risk) & (C("planned_rr") >= min_rr))
    group = ["ticker", "i"]
    touches = {"s": Touch(low=C("stop"), low_open=C("stop")), "h": Touch(high=C("resistance"), high_open=C("resistance"))}
    first = first_touches(s.select(*group, *_path(max_hold), "stop", "resistance"), bars, touches, group, max_hold)
    rows = _back_at_entry(s.join(first, group), bars, group, max_hold)
    # From the touching bar on, the first close below the average.
    under = bars.select("ticker", C("i").alias("h"), next_where(C("close") < C("ema20"), own=True).alias("a"))
    rows = rows.join(under, ["ticker", "h"], "left")
    limit = F.least(C("e") + max_hold, C("n"))
    hit = C("h").isNotNull() & (C("s").isNull() | (C("h") < C("s")))
    rows = rows.withColumns(
        {
            "hit_target": hit,
            "a": F.when(C("a") < C("e") + max_hold, C("a")),
            "limit_": limit,
        }
    )
    at_entry = C("hit_target") & C("b").isNotNull() & (C("a").isNull() | (C("b") <= C("a")))
    run = C("hit_target") & ~at_entry & C("a").isNotNull() & (C("a") + 1 < C("limit_"))
    at_stop = ~C("hit_target") & C("s").isNotNull()
    rows = rows.withColumns({"at_entry": at_entry, "run": run, "at_stop": at_stop})
    j = (
        F.when(C("at_entry"), C("b"))
        .when(C("run"), C("a") + 1)
        .when(C("at_stop"), C("s"))
        .otherwise(C("limit_") - 1)
    )
    rows = _exit_bar(rows.withColumn("j", j), bars)
    floor_ = F.when(C("hit_target"), C("entry")).otherwise(C("stop"))
    gap = (C("at_entry") | C("at_stop")) & (C("x_open") <= floor_)
    rows = rows.withColumn(
        "status",
        F.when(gap, F.lit("gap_stop"))
        .when(C("at_entry"), F.lit("be"))
        .when(C("at_stop"), F.lit("stop"))
        .when(C("run"), F.lit("ema20_runner"))
        .otherwise(F.lit("time")),
    )
    px = (
        F.when((C("status") == "gap_stop") | C("run"), C("x_open"))
        .when(C("at_entry") | C("at_stop"), floor_)
        .otherwise(C("x_close"))
    )
    exit_r = (px - C("entry")) / C("risk")
    cost = F.lit(2 * cost_bps / 10_000) * C("entry") / C("risk")
    r_ = F.when(C("hit_target"), F.lit(2 / 3) * C("planned_rr") + F.lit(1 / 3) * exit_r).otherwise(exit_r) - cost
    return rows.select("ticker", "i", "entry_date", "exit_date", r_.alias("r"), "planned_rr", "status", "hit_target")


def _walked(names: list[str], start: int) -> Callable:
    """Keeps a sorted stream of (keys, i, held) rows that start when the one kept before has ended."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, free = None, start
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            mask = []
            for *now, i, held in zip(*columns):
                if now != key:
                    key, free = now, start
                mask.append(i >= free)
                if mask[-1]:
                    free = i + held + 1
            yield batch.filter(pa.array(mask, pa.bool_())).select([*names, "i"])

    return walk


def non_overlap(trades: DataFrame, keys: list[str], start: int = 0) -> DataFrame:
    """Per key, keep a trade only when the one kept before has ended: next start > i + held.

    Trades of a key that start on one bar are first reduced to the shortest, which alone decides,
    so a key has at most one row per bar of the calendar however many tickers share it. Those are
    read once in order; a task remembers one key and where it is free again.
    """
    starts = trades.groupBy(*keys, "i").agg(F.min("held").alias("held"))
    ordered = starts.select(*keys, C("i").cast("bigint").alias("i"), C("held").cast("bigint").alias("held"))
    ordered = (ordered.repartition(*keys) if keys else ordered.coalesce(1)).sortWithinPartitions(*keys, "i")
    found = ordered.mapInArrow(_walked(keys, start), ordered.drop("held").schema)
    same = [C(f"a.{k}").eqNullSafe(C(f"b.{k}")) for k in [*keys, "i"]]
    return trades.alias("a").join(found.alias("b"), same, "left_semi")
