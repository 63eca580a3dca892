"""Staged screen: cheap gates first, detailed measures only for the tickers left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import rolling as r
from tapeloom.functions.recursive import smooth, span
from tapeloom.operators import indicators as ind
from tapeloom.session import safe_unions, settle
from tapeloom.sources.store import stored

C = F.col


@dataclass(frozen=True)
class ScreenParams:
    min_history: int = 1300
    min_dollar_volume: float = 20e6
    min_price: float = 5.0
    max_stale_days: int = 0
    min_weeks: int = 210
    dollar_window: int = 60
    touch_rows: int = 3
    touch_band: float = 1.02


def with_tail(bars: DataFrame, rows: int | None = None) -> DataFrame:
    """Adds ``n`` (bars of the ticker) and ``back`` (1 = last bar), counted from the end; optionally keeps the last rows."""
    out = bars.withColumn("n", r.bars_count()).withColumn("back", r.rows_from_end().cast("bigint"))
    return out if rows is None else out.filter(C("back") <= rows)


def fresh_tickers(bars: DataFrame, max_stale_days: int = 0) -> DataFrame:
    """Per ticker: bars, last date, and whether it is at most ``max_stale_days`` behind the store."""
    each = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("dt").alias("last_dt"))
    store_dt = each.agg(F.max("last_dt")).scalar()
    return each.withColumn("fresh", F.datediff(store_dt, "last_dt") <= max_stale_days)


def liquidity_gate(bars: DataFrame, p: ScreenParams) -> DataFrame:
    """Median dollar volume of the last rows and the last price, per ticker."""
    tail = with_tail(bars, p.dollar_window)
    each = tail.groupBy("ticker").agg(
        F.first("n").alias("n"),
        F.max("dt").alias("last_dt"),
        F.percentile(C("close") * C("volume"), F.lit(0.5)).alias("dollar_vol"),
        F.max_by("close", "i").alias("price"),
    )
    ok = (C("dollar_vol") >= p.min_dollar_volume) & (C("price") >= p.min_price)
    return each.withColumn("liquid", F.coalesce(ok, F.lit(False)))


def week_ending(d: Column) -> Column:
    """Friday closing the week of a date; weekend days belong to the next Friday."""
    return F.next_day(F.date_sub(d, 1), "FRI")


def weekly_order(bars: DataFrame, min_weeks: int = 210) -> DataFrame:
    """Trailing streak of weeks in rising order (close > 20 > 50 > 200 averages), per ticker.

    ``po_weeks`` is 0 when the newest week, finished or not, is out of order.
    """
    weekly = (
        bars.groupBy("ticker", week_ending(C("dt")).alias("week"))
        .agg(F.max_by("close", "dt").alias("close"))
        .withColumn("i", F.row_number().over(Window.partitionBy("ticker").orderBy("week")).cast("bigint") - 1)
    )
    w = weekly.withColumns({f"m{n}": r.sma(C("close"), n) for n in (20, 50, 200)})
    w = w.withColumns({f"m{n}_4": r.prev(C(f"m{n}"), 4) for n in (20, 50, 200)})
    ok = (
        (C("close") > C("m20"))
        & (C("m20") > C("m50"))
        & (C("m50") > C("m200"))
        & (C("m20") > C("m20_4"))
        & (C("m50") > C("m50_4"))
        & (C("m200") > C("m200_4"))
    )
    return (
        w.withColumn("ok", F.coalesce(ok, F.lit(False)))
        .groupBy("ticker")
        .agg(
            F.count(F.lit(1)).alias("weeks"),
            F.max(F.when(~C("ok"), C("i"))).alias("last_off"),
        )
        .select(
            "ticker",
            "weeks",
            F.when(C("weeks") >= min_weeks, C("weeks") - 1 - F.coalesce("last_off", F.lit(-1)))
            .otherwise(F.lit(0))
            .cast("bigint")
            .alias("po_weeks"),
        )
    )


def dip_check(bars: DataFrame, p: ScreenParams = ScreenParams()) -> DataFrame:
    """Tickers closing above their 20-bar smoothed price after touching it in the last rows."""
    e = smooth(with_tail(bars), {"ema20": span(C("close"), 20)}).filter(C("back") <= p.touch_rows)
    touched = C("low") <= C("ema20") * p.touch_band
    return (
        e.groupBy("ticker")
        .agg(
            F.min(F.when(touched, C("back"))).alias("touch_days_ago"),
            F.max_by("close", "i").alias("price"),
            F.max_by("open", "i").alias("open"),
            F.max_by("ema20", "i").alias("ema20"),
        )
        .filter(C("touch_days_ago").isNotNull() & (C("price") > C("ema20")))
        .select(
            "ticker",
            "touch_days_ago",
            (C("price") > C("open")).alias("bounced"),
            "ema20",
            (C("price") / C("ema20") - 1).alias("ema20_dist"),
        )
    )


def period_returns(bars: DataFrame, periods: tuple[int, ...] = (63, 126)) -> DataFrame:
    """Return over the last n rows of each ticker, null while it has no more than n rows."""
    tail = with_tail(bars.filter(C("close").isNotNull()), max(periods) + 1)
    last = F.max_by("close", "i")
    return tail.groupBy("ticker").agg(
        *[
            (last / F.max(F.when(C("back") == n + 1, C("close"))) - 1).alias(f"ret{n}")
            for n in periods
        ]
    )


def relative_strength(bars: DataFrame, benchmark: str, periods: tuple[int, ...] = (63, 126)) -> DataFrame:
    """Own return less the benchmark's, each over its own last rows."""
    own = period_returns(bars, periods)
    base = period_returns(bars.filter(C("ticker") == benchmark), periods)
    market = base.agg(F.first(F.struct(*[f"ret{n}" for n in periods]))).scalar()
    return own.withColumn("market_", market).select(
        "ticker", *[(C(f"ret{n}") - C(f"market_.ret{n}")).alias(f"rs{n}") for n in periods]
    )


def pivots(bars: DataFrame, k: int = 5, lookback: int | None = 300) -> DataFrame:
    """Confirmed pivots: rows equal to the extreme of the 2k+1 rows around them; ties all count."""
    around = r.by_ticker().rowsBetween(-k, k)
    marked = with_tail(bars).withColumns(
        {
            "hi_": C("high") == F.max("high").over(around),
            "lo_": C("low") == F.min("low").over(around),
        }
    )
    size = C("n") if lookback is None else F.least(C("n"), F.lit(lookback))
    inside = marked.withColumn("pos", C("i") - (C("n") - size)).filter(
        (C("pos") >= k) & (C("pos") < size - k)
    )
    kinds = F.filter(
        F.array(
            F.when(C("hi_"), F.struct(F.lit("high").alias("kind"), C("high").alias("value"))),
            F.when(C("lo_"), F.struct(F.lit("low").alias("kind"), C("low").alias("value"))),
        ),
        lambda x: x.isNotNull(),
    )
    return inside.select("ticker", "dt", "i", "pos", F.inline(kinds))


def last_pivots(found: DataFrame) -> DataFrame:
    """Newest two highs and lows per ticker: high_1 is the newest, high_2 the one before."""
    newest = Window.partitionBy("ticker", "kind").orderBy(F.desc("i"))
    ranked = found.withColumn("k", F.row_number().over(newest)).filter(C("k") <= 2)
    return ranked.groupBy("ticker").agg(
        *[
            F.max(F.when((C("kind") == kind) & (C("k") == k), C("value"))).alias(f"{kind}_{k}")
            for kind in ("high", "low")
            for k in (1, 2)
        ]
    )


def dow_trend() -> Column:
    """Trend from the columns of ``last_pivots``."""
    h1, h2, l1, l2 = C("high_1"), C("high_2"), C("low_1"), C("low_2")
    known = h1.isNotNull() & h2.isNotNull() & l1.isNotNull() & l2.isNotNull()
    return (
        F.when(~known, F.lit("unknown"))
        .when((h1 > h2) & (l1 > l2), F.lit("up"))
        .when((h1 < h2) & (l1 < l2), F.lit("down"))
        .otherwise(F.lit("neutral"))
    )


def volume_band(bars: DataFrame, bins: int = 20, window: int = 60) -> DataFrame:
    """Price band holding most volume over the last rows; the lower band wins a tie."""
    tail = with_tail(bars, window).filter(C("close").isNotNull() & C("volume").isNotNull())
    per = Window.partitionBy("ticker")
    t = tail.withColumns({"lo_": F.min("close").over(per), "hi_": F.max("close").over(per)})
    spot = F.floor(F.try_divide(C("close") - C("lo_"), C("hi_") - C("lo_")) * bins)
    t = t.withColumn("bin", F.least(F.coalesce(spot, F.lit(0)), F.lit(bins - 1)).cast("bigint"))
    totals = t.groupBy("ticker", "bin").agg(
        F.sum("volume").alias("total"), F.first("lo_").alias("lo_"), F.first("hi_").alias("hi_")
    )
    best = totals.groupBy("ticker").agg(
        F.max_by("bin", F.struct("total", -C("bin"))).alias("bin"),
        F.first("lo_").alias("lo_"),
        F.first("hi_").alias("hi_"),
    )
    width = (C("hi_") - C("lo_")) / bins
    flat = C("hi_") == C("lo_")
    return best.select(
        "ticker",
        F.when(flat, C("lo_")).otherwise(C("lo_") + C("bin") * width).alias("band_low"),
        F.when(flat, C("hi_")).otherwise(C("lo_") + (C("bin") + 1) * width).alias("band_high"),
    )


def gates(bars: DataFrame, p: ScreenParams) -> DataFrame:
    """One row per ticker with the cumulative funnel flags universe, liquid, po, dip.

    The gates run one after the other: each is settled, and the next reads the bars of the tickers
    left by a semi join below its windows, so the dear stages see survivors only. What a dropped
    ticker would have measured further on is null.
    """
    store_dt = bars.agg(F.max("dt")).scalar()
    base = liquidity_gate(bars, p).withColumn(
        "universe",
        (C("n") >= p.min_history) & (F.datediff(store_dt, "last_dt") <= p.max_stale_days),
    )
    base = settle(base.withColumn("liquid", C("universe") & C("liquid")))
    weekly = weekly_order(survivors(bars, base.filter("liquid")), p.min_weeks).select("ticker", "po_weeks")
    weekly = settle(weekly)
    dips = dip_check(survivors(bars, weekly.filter(C("po_weeks") > 0)), p)
    joined = base.join(weekly, "ticker", "left").join(dips, "ticker", "left")
    joined = joined.withColumn("po", C("liquid") & F.coalesce(C("po_weeks") > 0, F.lit(False)))
    return joined.withColumn("dip", C("po") & C("touch_days_ago").isNotNull())


def survivors(bars: DataFrame, left: DataFrame) -> DataFrame:
    """The bars of the tickers left."""
    return bars.join(left.select("ticker"), "ticker", "left_semi")


def funnel(gated: DataFrame) -> DataFrame:
    return gated.agg(*[F.count_if(C(c)).alias(c) for c in ("universe", "liquid", "po", "dip")])


def screen(bars: DataFrame, benchmark: str, p: ScreenParams = ScreenParams()) -> DataFrame:
    """Tickers through every gate, with trend, strength, volume and level measures.

    ``bars`` should be a stored table. The gates' outcome and the bars of the tickers left are
    settled, so that the measures read only those and the gates run once.
    """
    from tapeloom.operators.volume import volume_assessment

    safe_unions(bars.sparkSession)
    passed = settle(
        gates(bars, p)
        .filter("dip")
        .select("ticker", "price", "dollar_vol", "po_weeks", "touch_days_ago", "bounced", "ema20", "ema20_dist")
    )
    left = stored(bars.join(passed.select("ticker"), "ticker", "left_semi"))
    last_adx = with_tail(ind.adx(left), 1).select("ticker", "adx", "atr")
    strength = relative_strength(
        left.filter(C("ticker") != benchmark).unionByName(bars.filter(C("ticker") == benchmark)), benchmark
    )
    trend = last_pivots(pivots(left))
    return (
        passed.join(last_adx, "ticker", "left")
        .join(strength, "ticker", "left")
        .join(trend, "ticker", "left")
        .join(volume_band(left), "ticker", "left")
        .join(volume_assessment(left, passed.select("ticker", "bounced")), "ticker", "left")
        .select(
            "ticker",
            "price",
            F.when(C("bounced"), F.lit("bounced")).otherwise(F.lit("pulling")).alias("state"),
            "touch_days_ago",
            dow_trend().alias("dow_trend"),
            "adx",
            "rs63",
            "rs126",
            F.try_divide(C("atr"), C("price")).alias("atr_pct"),
            "dollar_vol",
            "ema20_dist",
            "po_weeks",
            "volume",
            F.struct(
                "ema20",
                C("high_1").alias("swing_high"),
                C("low_1").alias("swing_low"),
                F.array("band_low", "band_high").alias("vol_band"),
            ).alias("levels"),
        )
    )


def stage2(bars: DataFrame, every_row: bool = False) -> DataFrame:
    """Stage-2 uptrend flag on the last bar of each ticker (or on every bar).

    Fewer than 200 bars, or any missing input, gives false.
    """
    df = ind.macd(ind.rsi_simple(bars))
    close, volume = C("close"), C("volume")
    df = df.withColumns(
        {
            "sma50": r.sma(close, 50),
            "sma200": r.sma(close, 200),
            "vol50": r.sma(volume, 50),
            "high_52w": F.max("high").over(r.last_rows(252)),
            "tight": ind.tightening(),
            "n": r.bars_count(),
        }
    )
    ok = (
        (close > C("sma50"))
        & (C("sma50") > C("sma200"))
        & C("rsi").between(40, 70)
        & (C("macd") > C("macd_signal"))
        & (close / C("high_52w") - 1 >= -0.15)
        & ((volume < C("vol50")) | C("tight"))
    )
    flagged = df.withColumn("stage2", F.coalesce(ok, F.lit(False)))
    if not every_row:
        flagged = flagged.filter(C("i") == C("n") - 1)
    return flagged.select("ticker", "dt", "i", "stage2")


def stock_summary(bars: DataFrame) -> DataFrame:
    """Plan of each ticker at its last bar: averages, stop, target, reward to risk, tier, verdict."""
    close, volume = C("close"), C("volume")
    df = ind.macd(ind.rsi_simple(ind.atr_simple(bars)))
    df = smooth(df, {"ema10": span(close, 10), "ema21": span(close, 21)})
    df = df.withColumns(
        {
            "n": r.bars_count(),
            **{f"sma{k}": r.sma(close, k) for k in (20, 50, 200)},
            "vol20": r.sma(volume, 20),
            "vol50": r.sma(volume, 50),
            "high_52w": F.max("high").over(r.last_rows(252)),
            "low_52w": F.min("low").over(r.last_rows(252)),
            "tight": ind.tightening(),
            "low20": F.min("low").over(r.last_rows(20)),
            "high100": F.max("high").over(r.last_rows(100)),
            "before": r.prev(close),
        }
    )
    df = df.filter((C("n") >= 60) & (C("i") == C("n") - 1))
    df = df.withColumn("atr", F.coalesce("atr", F.lit(0.0)))
    stop = F.least(F.greatest(C("low20"), close - C("atr") * 2.0), close - C("atr"))
    df = df.withColumn("stop", stop).withColumn("risk", close - C("stop")).filter(C("risk") > 0)
    guessed = C("high100") <= close
    df = df.withColumn("target", F.when(guessed, close + C("atr") * 3.0).otherwise(C("high100")))
    df = df.withColumns(
        {
            "target_source": F.when(guessed, F.lit("atr")).otherwise(F.lit("high")),
            "reward": C("target") - close,
            "rr": (C("target") - close) / C("risk"),
            "change_pct": (close - C("before")) / C("before") * 100,
            "pct_from_high": F.when(C("high_52w") > 0, close / C("high_52w") - 1).otherwise(-1) * 100,
            "vol_ratio": F.coalesce(F.try_divide(volume, C("vol20")), F.lit(0.0)),
            "vol_contraction": F.coalesce(volume < C("vol50"), F.lit(False)),
            "stage2_uptrend": F.coalesce((close > C("sma50")) & (C("sma50") > C("sma200")), F.lit(False)),
        }
    )
    rr = C("rr")
    df = df.withColumn(
        "tier",
        F.when(rr >= 2.0, F.lit("Tier1")).when(rr >= 1.5, F.lit("Tier2")).otherwise(F.lit("REJECTED")),
    )
    df = df.withColumn(
        "verdict",
        F.when(rr < 1.5, F.lit("NO-BUY"))
        .when(~C("stage2_uptrend"), F.lit("NO-BUY"))
        .when(C("tier") == "Tier1", F.lit("BUY"))
        .when(C("tier") == "Tier2", F.lit("WATCH"))
        .otherwise(F.lit("NO-BUY")),
    )
    return df.withColumns({"reasons": entry_reasons(), "risks": risk_factors()}).select(
        "ticker", "dt", close.alias("price"), "change_pct", "volume", "vol_ratio", "sma20", "sma50", "sma200",
        "ema10", "ema21", "rsi", "macd", "macd_signal", "atr", "high_52w", "low_52w", "pct_from_high",
        "stage2_uptrend", C("tight").alias("vcp_tightening"), "vol_contraction", close.alias("entry"), "stop",
        "target", "target_source", "risk", "reward", "rr", "tier", "verdict", "reasons", "risks",
    )


def _said(*lines: Column) -> Column:
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


def entry_reasons() -> Column:
    """Texts speaking for an entry, built from the summary's columns."""
    off = F.abs(C("pct_from_high"))
    return _said(
        F.when(C("stage2_uptrend"), F.lit("stage 2 uptrend (close > SMA50 > SMA200)")),
        F.when(F.round("rsi", 2).between(40, 70), F.format_string("RSI %.1f", C("rsi"))),
        F.when(C("macd") > C("macd_signal"), F.lit("MACD above signal")),
        F.when(F.round(off, 2) <= 15, F.format_string("%.1f%% off the 52-week high", off)),
        F.when(C("tight"), F.lit("range tightening")),
        F.when(C("vol_contraction"), F.lit("volume contraction")),
        F.when(F.round("vol_ratio", 2) >= 1.5, F.format_string("volume %.1f times average", C("vol_ratio"))),
        F.format_string("RR %.2f (target %.2f, stop %.2f)", C("rr"), C("target"), C("stop")),
    )


def risk_factors() -> Column:
    """Texts speaking against an entry."""
    off = F.abs(C("pct_from_high"))
    return _said(
        F.when(F.round("rsi", 2) > 65, F.format_string("RSI %.1f is stretched", C("rsi"))),
        F.when(F.round(off, 2) > 10, F.format_string("%.1f%% below the 52-week high", off)),
        F.when(~C("tight"), F.lit("no range tightening")),
        F.when((C("vol_ratio") > 0) & (F.round("vol_ratio", 2) < 0.5), F.lit("thin volume")),
        F.when(F.round("rr", 2) < 2.0, F.format_string("RR %.2f below tier 1", C("rr"))),
    )
