"""Technical indicators per ticker. Each adds columns to bars(ticker, i, open..volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import rolling as r
from tapeloom.functions.recursive import Smooth, smooth, span, wilder

C = F.col


def with_true_range(bars: DataFrame) -> DataFrame:
    return bars.withColumn("tr", r.true_range())


def atr_simple(bars: DataFrame, n: int = 14) -> DataFrame:
    return with_true_range(bars).withColumn("atr", r.sma(C("tr"), n))


def atr_wilder(bars: DataFrame, n: int = 14, min_rows: int = 1) -> DataFrame:
    return smooth(with_true_range(bars), {"atr": wilder(C("tr"), n, min_rows)})


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds ``tr``, ``atr`` and ``adx``; directional moves count as 0 on the first row."""
    up = C("high") - r.prev(C("high"))
    down = r.prev(C("low")) - C("low")
    zero = F.lit(0.0)
    moved = with_true_range(bars).withColumns({"up_": up, "down_": down})
    moved = moved.withColumns(
        {
            "plus_": F.when((C("up_") > C("down_")) & (C("up_") > 0), C("up_")).otherwise(zero),
            "minus_": F.when((C("down_") > C("up_")) & (C("down_") > 0), C("down_")).otherwise(zero),
        }
    )
    first = smooth(
        moved,
        {"atr": wilder(C("tr"), n), "sp_": wilder(C("plus_"), n), "sm_": wilder(C("minus_"), n)},
    )
    plus_di = F.try_divide(100.0 * C("sp_"), C("atr"))
    minus_di = F.try_divide(100.0 * C("sm_"), C("atr"))
    dx = F.coalesce(F.try_divide(100.0 * F.abs(plus_di - minus_di), plus_di + minus_di), zero)
    second = smooth(first.withColumn("dx_", dx), {"adx": wilder(C("dx_"), n)})
    return second.drop("up_", "down_", "plus_", "minus_", "sp_", "sm_", "dx_")


def _rsi(gain: Column, loss: Column) -> Column:
    return 100 - 100 / (1 + F.try_divide(gain, loss))


def rsi_simple(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI on plain rolling means; null when nothing fell in the window."""
    gain, loss = r.gain_loss()
    zero = F.lit(0.0)
    moved = bars.withColumns({"g_": F.coalesce(gain, zero), "l_": F.coalesce(loss, zero)})
    moved = moved.withColumns({"ag_": r.sma(C("g_"), n), "al_": r.sma(C("l_"), n)})
    return moved.withColumn("rsi", _rsi(C("ag_"), C("al_"))).drop("g_", "l_", "ag_", "al_")


def with_rsi_wilder(bars: DataFrame, periods: dict[str, int], cap_without_loss: bool) -> DataFrame:
    """Wilder RSI; without any loss it is 100 when ``cap_without_loss``, else null."""
    gain, loss = r.gain_loss()
    moved = bars.withColumns({"g_": gain, "l_": loss})
    parts: dict[str, Smooth] = {}
    for name, n in periods.items():
        parts[f"{name}_g_"] = wilder(C("g_"), n, n)
        parts[f"{name}_l_"] = wilder(C("l_"), n, n)
    moved = smooth(moved, parts)
    for name in periods:
        g, lo = C(f"{name}_g_"), C(f"{name}_l_")
        value = _rsi(g, lo)
        if cap_without_loss:
            value = F.when((lo == 0) & (g > 0), F.lit(100.0)).otherwise(value)
        moved = moved.withColumn(name, value)
    return moved.drop("g_", "l_", *parts)


def macd(bars: DataFrame) -> DataFrame:
    fast_slow = smooth(bars, {"f_": span(C("close"), 12), "s_": span(C("close"), 26)})
    line = fast_slow.withColumn("macd", C("f_") - C("s_")).drop("f_", "s_")
    return smooth(line, {"macd_signal": span(C("macd"), 9)})


def tightening(n: int = 10) -> Column:
    """Is the high-low range of the last ``n`` rows below that of the ``n`` before? False if short."""
    now = r.rolling_max(C("high"), n) - r.rolling_min(C("low"), n)
    earlier = r.rolling_max(C("high"), n, skip=n) - r.rolling_min(C("low"), n, skip=n)
    return F.coalesce(now < earlier, F.lit(False))


def features(bars: DataFrame) -> DataFrame:
    """The research feature table: one row per bar, inputs of rules and brackets."""
    close, volume = C("close"), C("volume")
    df = with_true_range(bars)
    gain, loss = r.gain_loss()
    df = df.withColumns({"g_": gain, "l_": loss})
    df = smooth(
        df,
        {f"ema{n}": span(close, n, n) for n in (10, 20, 50, 200)}
        | {
            "atr": wilder(C("tr"), 14, 14),
            "atr50_": wilder(C("tr"), 50, 50),
            "g14_": wilder(C("g_"), 14, 14),
            "l14_": wilder(C("l_"), 14, 14),
            "g2_": wilder(C("g_"), 2, 2),
            "l2_": wilder(C("l_"), 2, 2),
        },
    )

    def rsi(n: int) -> Column:
        g, lo = C(f"g{n}_"), C(f"l{n}_")
        return F.when((lo == 0) & (g > 0), F.lit(100.0)).otherwise(_rsi(g, lo))

    df = df.withColumns(
        {
            "rsi": rsi(14),
            "rsi2": rsi(2),
            "ddv": r.rolling_median(close * volume, 20),
            "hh20": r.rolling_max(C("high"), 20),
            "hh60": r.rolling_max(C("high"), 60),
            "ll10": r.rolling_min(C("low"), 10),
            "ll20": r.rolling_min(C("low"), 20),
            **{f"ret{n}": r.change(close, n) for n in (21, 63, 126, 252)},
            "vol_ratio": F.try_divide(r.sma(volume, 3), r.sma(volume, 50)),
        }
    )
    df = df.withColumns(
        {
            "atr_ratio": F.try_divide(C("atr"), C("atr50_")),
            "atr_pct": C("atr") / close,
            "dist_ema20": close / C("ema20") - 1,
            "dist_ema50": close / C("ema50") - 1,
            "dist_hh60": close / C("hh60") - 1,
        }
    )
    return df.drop("tr", "g_", "l_", "atr50_", "g14_", "l14_", "g2_", "l2_")


def swing_columns(bars: DataFrame) -> DataFrame:
    """Columns of the variant research: ema5/10/20/50/200, rsi, rsi2 (null without loss), atr, vol3, vol20."""
    gain, loss = r.gain_loss()
    df = with_true_range(bars).withColumns({"g_": gain, "l_": loss})
    parts = {f"ema{n}": span(C("close"), n, n) for n in (5, 10, 20, 50, 200)} | {"atr": wilder(C("tr"), 14, 14)}
    for n in (14, 2):
        parts |= {f"g{n}_": wilder(C("g_"), n, n), f"l{n}_": wilder(C("l_"), n, n)}
    df = smooth(df, parts)
    return df.withColumns(
        {
            "rsi": _rsi(C("g14_"), C("l14_")),
            "rsi2": _rsi(C("g2_"), C("l2_")),
            "vol3": r.sma(C("volume"), 3),
            "vol20": r.sma(C("volume"), 20),
        }
    ).drop("tr", "g_", "l_", "g14_", "l14_", "g2_", "l2_")
