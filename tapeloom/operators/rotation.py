"""Rotation between the up and down fund of an underlying, by the underlying's regime."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import rolling as r
from tapeloom.operators.barriers import label_trail

C = F.col


# The settings of the rotation and their defaults.
@dataclass(frozen=True)
class Rotation:
    trail_ema: int = 20
    stop_lookback: int = 20
    atr_buffer: float = 0.5

    @property
    def name(self) -> str:
        return f"trail{self.trail_ema}_stop{self.stop_lookback}_buf{self.atr_buffer}"


# The 18 settings of the rotation.
def rotation_grid() -> list[Rotation]:
    """The 18 settings of trailing average, stop and buffer."""
    return [Rotation(t, s, b) for t, s, b in product((10, 20), (10, 20, 40), (0.25, 0.5, 1.0))]


def pair_trades(
    rows: DataFrame,
    pairs: dict[str, tuple[str, str]],
    settings: Sequence[Rotation] = (Rotation(),),
    max_hold: int = 30,
    cost_bps: float = 10.0,
) -> DataFrame:
    """Trades of each fund on 20-bar breakouts while its underlying is in the fund's regime, per setting.

    Only dates both trade are used. The underlyings and funds are a short fixed list. All settings share
    the entries, which are opened into one signal a setting and followed in one pass.
    """
    links = [(u, fund, side) for u, funds in pairs.items() for fund, side in zip(funds, ("bull", "bear"))]
    listed = F.inline(
        F.array(
            *[
                F.struct(F.lit(u).alias("under"), F.lit(f).alias("fund"), F.lit(s).alias("leg"))
                for u, f, s in links
            ]
        )
    )
    funds = rows.filter(C("ticker").isin([f for _, f, _ in links])).select("*", listed).filter(C("fund") == C("ticker"))
    base = rows.filter(C("ticker").isin(list(pairs))).select(
        C("ticker").alias("under"), "dt", *[C(c).alias(f"u_{c}") for c in ("close", "ema50", "ema200")]
    )
    # One key per pair from here on, numbered over the common dates.
    joined = funds.join(base, ["under", "dt"]).withColumn("ticker", F.concat_ws(">", "under", "fund"))
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("dt")).cast("bigint") - 1
    joined = joined.withColumn("i", place)
    up = (C("u_close") > C("u_ema200")) & (C("u_ema50") > C("u_ema200"))
    down = (C("u_close") < C("u_ema200")) & (C("u_ema50") < C("u_ema200"))
    lows = {f"low_{n}": r.rolling_min(C("low"), n) for n in sorted({s.stop_lookback for s in settings})}
    marked = joined.withColumns({"prior": r.rolling_max(C("high"), 20, skip=1), "momentum": F.abs(r.change(C("u_close"), 63)), **lows})
    regime = F.when(C("leg") == "bull", up).otherwise(down)
    each = F.array(
        *[
            F.struct(
                F.lit(s.name).alias("variant"),
                F.lit(f"ema{s.trail_ema}").alias("trail"),
                (C(f"low_{s.stop_lookback}") - s.atr_buffer * C("atr")).alias("stop"),
            )
            for s in settings
        ]
    )
    entries = marked.filter((C("i") >= 201) & regime & (C("close") > C("prior")))
    signals = entries.select("ticker", "i", F.lit("long").alias("side"), F.inline(each))
    trails = tuple(sorted({f"ema{s.trail_ema}" for s in settings}))
    t = label_trail(signals, joined, trails, max_hold, cost_bps, max_risk=0.20)
    t = t.join(entries.select("ticker", "i", "leg", "momentum"), ["ticker", "i"])
    names = F.split("ticker", ">")
    return t.select(
        C("variant").alias("setting"),
        names[0].alias("under"),
        names[1].alias("ticker"),
        C("leg").alias("side"),
        "entry_date",
        "exit_date",
        F.when(C("status") == "ema_trail", F.lit("trail")).otherwise(C("status")).alias("status"),
        (C("exit") / C("entry") - 1 - 2 * cost_bps / 10_000).alias("ret"),
        "momentum",
    )
