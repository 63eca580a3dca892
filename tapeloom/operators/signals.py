"""Entry signals over the feature table. Rule sets are parameter records, evaluated in one pass."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import rolling as r
from tapeloom.operators.regimes import with_regime

C = F.col


# What a rule checks and its defaults.
@dataclass(frozen=True)
class Rule:
    """Long entry rule: thresholds on the feature table, a family, and optional filters."""

    family: str
    min_ddv: float = 1e7
    min_price: float = 5.0
    use_regime: bool = True
    trend: bool = True
    mom_min: float = -1.0
    rsi2_max: float = 100.0
    rsi14_max: float = 100.0
    ret21_max: float = 1.0
    dist_ema20_max: float = 1.0
    dist_ema50_min: float = -1.0
    dist_hh60_min: float = -1.0
    atr_ratio_max: float = 10.0
    vol_ratio_min: float = 0.0
    atr_pct_min: float = 0.0
    atr_pct_max: float = 1.0
    up_close: bool = False
    strong_close: bool = False

    @property
    def name(self) -> str:
        set_ = [f"{f.name}={getattr(self, f.name)}" for f in fields(self)[1:] if getattr(self, f.name) != f.default]
        return ":".join([self.family, *set_])


# The grid of 46 rules.
def rule_grid(**common) -> list[Rule]:
    """The 46 rules of the full search."""
    rules = [
        Rule("meanrev", rsi2_max=rsi2, dist_ema20_max=0.0, dist_ema50_min=d50, up_close=up, mom_min=0.0, **common)
        for rsi2, d50, up in product((5.0, 10.0, 20.0), (-1.0, -0.05), (False, True))
    ]
    rules += [
        Rule("pullback", ret21_max=r21, strong_close=strong, mom_min=mom, up_close=True, **common)
        for r21, strong, mom in product((1.0, -0.02, -0.05), (False, True), (-1.0, 0.0, 0.15))
    ]
    rules += [
        Rule("breakout", atr_ratio_max=squeeze, vol_ratio_min=busy, mom_min=mom, **common)
        for squeeze, busy, mom in product((10.0, 0.85), (0.0, 1.3), (-1.0, 0.0, 0.15))
    ]
    rules += [
        Rule("meanrev", dist_hh60_min=hh, rsi14_max=rsi, mom_min=0.15, dist_ema20_max=0.0, up_close=True, **common)
        for hh, rsi in product((-0.10, -0.05), (100.0, 50.0))
    ]
    return rules


# Volatility tiers by ATR as a share of price; both edges belong to a tier.
TIERS = {
    "t1_calm": (0.000, 0.020),
    "t2_normal": (0.020, 0.030),
    "t3_active": (0.030, 0.045),
    "t4_hot": (0.045, 0.070),
    "t5_wild": (0.070, 0.200),
}


# The rules of each volatility tier.
def tier_rules(**common) -> dict[str, list[Rule]]:
    """The six coarse rules of the tier search, per volatility tier."""
    base = [
        Rule("pullback", up_close=True, strong_close=True, mom_min=0.0, **common),
        Rule("pullback", up_close=True, mom_min=0.15, **common),
        Rule("breakout", mom_min=0.0, **common),
        Rule("breakout", mom_min=0.15, vol_ratio_min=1.3, **common),
        Rule("meanrev", rsi2_max=10.0, dist_ema20_max=0.0, mom_min=0.0, **common),
        Rule("meanrev", dist_hh60_min=-0.10, mom_min=0.15, dist_ema20_max=0.0, up_close=True, **common),
    ]
    return {t: [replace(x, atr_pct_min=lo, atr_pct_max=hi) for x in base] for t, (lo, hi) in TIERS.items()}


def with_tiers(features: DataFrame) -> DataFrame:
    """One row per volatility tier of a bar; a value on an edge is in both tiers."""
    hits = F.filter(
        F.array(*[F.when(C("atr_pct").between(lo, hi), F.lit(t)) for t, (lo, hi) in TIERS.items()]),
        lambda x: x.isNotNull(),
    )
    return features.withColumn("tier", F.explode(hits))


def prepare_rules(features: DataFrame) -> DataFrame:
    """Adds what rules need besides features: previous close and high mark, and the row limits.

    Rows lacking any feature, the first 250 bars and the last bar never fire and are dropped.
    """
    ahead = features.withColumns(
        {
            "prev_close": r.prev(C("close")),
            "prev_hh20": r.prev(C("hh20")),
            "n": r.bars_count(),
        }
    )
    needed = ["ema200", "atr", "ddv", "ret126", "rsi2", "rsi", "ret21", "dist_ema20", "dist_ema50"]
    needed += ["dist_hh60", "atr_ratio", "vol_ratio", "atr_pct"]
    return ahead.filter((C("i") >= 250) & (C("i") < C("n") - 1)).dropna(subset=needed)


def fires(rule: Rule) -> Column:
    """Does a prepared row meet the rule?"""
    c = C("close")
    tests = [
        C("ddv") >= rule.min_ddv,
        c >= rule.min_price,
        C("ret126") >= rule.mom_min,
        C("ret21") <= rule.ret21_max,
        C("dist_ema20") <= rule.dist_ema20_max,
        C("atr_ratio") <= rule.atr_ratio_max,
        C("atr_pct").between(rule.atr_pct_min, rule.atr_pct_max),
    ]
    # These thresholds cannot fail at their widest setting, since the inputs are known to be present.
    if rule.rsi2_max < 100.0:
        tests.append(C("rsi2") <= rule.rsi2_max)
    if rule.rsi14_max < 100.0:
        tests.append(C("rsi") <= rule.rsi14_max)
    if rule.dist_ema50_min > -1.0:
        tests.append(C("dist_ema50") >= rule.dist_ema50_min)
    if rule.dist_hh60_min > -1.0:
        tests.append(C("dist_hh60") >= rule.dist_hh60_min)
    if rule.vol_ratio_min > 0.0:
        tests.append(C("vol_ratio") >= rule.vol_ratio_min)
    if rule.use_regime:
        tests.append(C("regime"))
    if rule.trend:
        tests += [c > C("ema200"), C("ema50") > C("ema200")]
    if rule.up_close:
        tests.append(c > C("prev_close"))
    if rule.strong_close:
        tests.append((c - C("low")) > 0.5 * (C("high") - C("low")))
    if rule.family == "breakout":
        tests.append(c > C("prev_hh20"))
    elif rule.family == "pullback":
        tests.append(c <= C("ema20"))
    ok = tests[0]
    for t in tests[1:]:
        ok = ok & t
    return F.coalesce(ok, F.lit(False))


def rule_signals(prepared: DataFrame, rules: dict[int, Rule]) -> DataFrame:
    """Rows with the array ``rules`` of the ids that fire; rows where none fires are dropped."""
    ids = F.array(*[F.when(fires(rule), F.lit(k)) for k, rule in rules.items()])
    return prepared.withColumn("rules", F.filter(ids, lambda x: x.isNotNull())).filter(F.size("rules") > 0)


# The parameters of a variant and their defaults.
@dataclass(frozen=True)
class Variant:
    """Long or short variant of pullback, reversion, retest or breakout."""

    name: str
    strategy: str
    side: str
    ema_zone: float = 0.0
    rsi_lo: float = 0.0
    rsi_hi: float = 100.0
    volume_ratio: float = 1.0
    stop_lookback: int = 20
    atr_buffer: float = 0.5
    target_lookback: int = 20
    min_rr: float = 0.0
    max_hold: int = 10
    require_reversal: bool = False
    momentum_min: float = 0.0


# The 36 variants.
def variant_grid() -> list[Variant]:
    """The 36 reversion variants."""
    return [
        Variant(
            f"reversion_{side}_rsi2_{t}_stop20_atr{buffer}_hold{hold}",
            "reversion",
            side,
            rsi_lo=t,
            rsi_hi=100 - t,
            atr_buffer=buffer,
            max_hold=hold,
        )
        for side, t, buffer, hold in product(("long", "short"), (2, 5, 10), (0.5, 1.0, 1.5), (5, 10))
    ]


def _variant_rows(rows: DataFrame, variants: list[Variant], min_volume: float) -> DataFrame:
    """Bars on which a variant may fire, with all levels the variants look at."""
    c = C("close")
    levels: dict[str, Column] = {}

    def level(high: bool, n: int, skip: int) -> Column:
        """Highest high or lowest low of n rows; the same window is worked out once for all variants."""
        name = f"{'hi' if high else 'lo'}_{n}_{skip}"
        levels[name] = r.rolling_max(C("high"), n, skip) if high else r.rolling_min(C("low"), n, skip)
        return C(name)

    for v in variants:
        long = v.side == "long"
        level(not long, v.stop_lookback, 0)
        level(not long, v.stop_lookback, 1)
        level(long, v.target_lookback, 1)
    df = rows.withColumns(
        {
            "n": r.bars_count(),
            "pc": r.prev(c),
            "ph": r.prev(C("high")),
            "pl": r.prev(C("low")),
            "mom": c / r.prev(c, 126) - 1,
            **levels,
        }
    )
    last5 = r.by_ticker().rowsBetween(-5, -1)
    breaks = {_break_name(v): v for v in variants if v.strategy == "retest"}
    df = df.withColumns({f"at_{k}": _breakout_mark(v) for k, v in breaks.items()})
    df = df.withColumns({k: F.last(f"at_{k}", ignorenulls=True).over(last5) for k in breaks})
    known = (
        C("ema200").isNotNull() & C("rsi").isNotNull() & C("atr").isNotNull() & (C("vol20") >= min_volume)
    )
    return df.filter((C("i") >= 201) & (C("i") < C("n") - 1) & known)


def variant_signals(rows: DataFrame, variants: list[Variant], min_volume: float = 1e6) -> DataFrame:
    """Signals of all variants with stop and target, from one pass over the bars.

    ``rows`` carry ema20/50/200, rsi, rsi2, atr, vol3, vol20 and the regime flags bull, bear.
    Short variants mirror long ones: signs are flipped, highs and lows swapped.
    """
    df = _variant_rows(rows, variants, min_volume)
    fired = F.filter(F.array(*[_variant_struct(v) for v in variants]), lambda x: x.isNotNull())
    return df.select("ticker", "dt", "i", "close", F.inline(fired))


def shared_legs(variants: list[Variant]) -> dict[str, list[Variant]]:
    """Variants by what their outcome depends on: those of one leg differ only in when they fire."""
    legs: dict[str, list[Variant]] = {}
    for v in variants:
        leg = f"{v.strategy}_{v.side}_stop{v.stop_lookback}_atr{v.atr_buffer}_target{v.target_lookback}_hold{v.max_hold}"
        legs.setdefault(leg, []).append(v)
    return legs


def leg_signals(rows: DataFrame, variants: list[Variant], min_volume: float = 1e6) -> DataFrame:
    """One row per bar and leg on which any variant of the leg fires, with ``fired``, the bitmap of those that do.

    Columns are those of ``variant_signals`` with the leg as ``variant``; a leg holds at most 62 variants.
    """
    df = _variant_rows(rows, variants, min_volume)
    found = []
    for leg, same in shared_legs(variants).items():
        if len(same) > 62:
            raise ValueError("a leg holds at most 62 variants")
        parts = [_variant_parts(v) for v in same]
        bits = sum((F.when(signal, F.lit(1 << k)).otherwise(F.lit(0)) for k, (signal, _, _) in enumerate(parts)), F.lit(0).cast("bigint"))
        _, stop, target = parts[0]
        found.append(
            F.struct(
                F.lit(leg).alias("variant"),
                F.lit(same[0].side).alias("side"),
                F.lit(same[0].max_hold).alias("max_hold"),
                stop.alias("stop"),
                target.alias("target"),
                bits.alias("fired"),
            )
        )
    return df.select("ticker", "dt", "i", "close", F.inline(F.filter(F.array(*found), lambda x: x["fired"] > 0)))


def of_variants(trades: DataFrame, variants: list[Variant]) -> DataFrame:
    """Trades of legs, with ``variant`` and ``fired``, as trades of the variants that fired."""
    names = [
        F.struct(F.lit(leg).alias("leg"), F.lit(1 << k).cast("bigint").alias("bit"), F.lit(v.name).alias("name"))
        for leg, same in shared_legs(variants).items()
        for k, v in enumerate(same)
    ]
    mine = F.filter(F.array(*names), lambda x: (x["leg"] == C("variant")) & (C("fired").bitwiseAND(x["bit"]) > 0))
    rest = [c for c in trades.columns if c not in ("variant", "fired")]
    return trades.select(*rest, F.explode(F.transform(mine, lambda x: x["name"])).alias("variant"))


def _near(v: Variant, skip: int) -> Column:
    return C(f"{'lo' if v.side == 'long' else 'hi'}_{v.stop_lookback}_{skip}")


def _far(v: Variant) -> Column:
    return C(f"{'hi' if v.side == 'long' else 'lo'}_{v.target_lookback}_1")


def _beyond(v: Variant, a: Column, b: Column) -> Column:
    return a > b if v.side == "long" else a < b


def _break_name(v: Variant) -> str:
    return f"brk_{v.side}_{v.target_lookback}_{v.stop_lookback}"


def _breakout_mark(v: Variant) -> Column:
    """On a breakout row: the level broken, the momentum, and the far end of its base."""
    broke = (C("i") >= v.target_lookback) & _beyond(v, C("close"), _far(v))
    return F.when(broke, F.struct(_far(v).alias("level"), "mom", _near(v, 1).alias("base")))


def _variant_parts(v: Variant) -> tuple[Column, Column, Column]:
    """Whether the variant fires, its stop and its target."""
    long = v.side == "long"
    c, o, h, lo = C("close"), C("open"), C("high"), C("low")
    e20, e50, e200, atr = C("ema20"), C("ema50"), C("ema200"), C("atr")
    beyond = lambda a, b: _beyond(v, a, b)
    away = F.lit(-v.atr_buffer if long else v.atr_buffer) * atr
    enough = lambda m: m >= v.momentum_min if long else m <= -v.momentum_min
    trend = beyond(c, e200) & beyond(e50, e200) & C("bull" if long else "bear")
    busy = C("vol20") * v.volume_ratio
    vol_ok = C("vol3") <= busy if v.strategy == "pullback" else C("vol3") >= busy
    stop, target = _near(v, 0) + away, _far(v)
    if v.strategy == "reversion":
        stretched = C("rsi2") <= v.rsi_lo if long else C("rsi2") >= v.rsi_hi
        signal = trend & stretched & beyond(C("pc"), c)
        target = e20
    elif v.strategy == "retest":
        # The last breakout among the five bars before, with the level it broke.
        brk = C(_break_name(v))
        level = brk["level"]
        touched = lo <= level * (1 + v.ema_zone) if long else h >= level * (1 - v.ema_zone)
        held = c >= level * (1 - v.ema_zone) if long else c <= level * (1 + v.ema_zone)
        mom = F.coalesce(brk["mom"], F.lit(0.0))
        signal = trend & vol_ok & touched & held & beyond(c, o) & beyond(c, C("pc")) & enough(mom)
        target = level + (level - brk["base"])
    elif v.strategy == "breakout":
        signal = trend & vol_ok & beyond(c, _far(v)) & enough(C("mom"))
        stop = _near(v, 1) + away
        target = _far(v) + (_far(v) - _near(v, 1))
    else:
        zone = F.least(F.abs(c / e20 - 1), F.abs(c / e50 - 1)) <= v.ema_zone
        signal = trend & zone & vol_ok & C("rsi").between(v.rsi_lo, v.rsi_hi)
        if v.require_reversal:
            signal = signal & beyond(c, o) & beyond(c, C("ph" if long else "pl"))
    start = max(201, v.target_lookback + 1, v.stop_lookback + 1)
    return signal & (C("i") >= start), stop, target


def _variant_struct(v: Variant) -> Column:
    signal, stop, target = _variant_parts(v)
    return F.when(
        signal,
        F.struct(
            F.lit(v.name).alias("variant"),
            F.lit(v.side).alias("side"),
            F.lit(v.max_hold).alias("max_hold"),
            F.lit(v.min_rr).alias("min_rr"),
            stop.alias("stop"),
            target.alias("target"),
        ),
    )


def panel_momentum(bars: DataFrame, formation: int, skip: int) -> DataFrame:
    """Momentum on the common calendar: close ``skip`` sessions ago over close ``formation`` sessions ago.

    Sessions are those of the whole market, so a ticker counts on dates it did not trade,
    and has no value when it has no bar on one of the two dates.
    """
    days = bars.select("dt").distinct()
    numbered = days.withColumn("pos", F.row_number().over(Window.orderBy("dt")).cast("bigint") - 1)
    apart = formation - skip
    there = Window.partitionBy("ticker").orderBy("pos").rangeBetween(-apart, -apart)
    placed = bars.select("ticker", "dt", "close").join(numbered, "dt")
    moved = placed.select(
        "ticker", (C("pos") + skip).alias("pos"), (C("close") / F.max("close").over(there) - 1).alias("momentum")
    )
    return moved.filter(C("momentum").isNotNull()).join(numbered, "pos").select("ticker", "dt", "momentum")


def average_rank(rows: DataFrame, by: str, value: str, min_names: int = 100, buckets: int = 128, salts: int = 16) -> DataFrame:
    """Percentile rank of ``value`` within ``by``: mean rank of ties over the non-null count.

    A date holds every ticker, so it may be far too large for one window. Equal values are
    counted first, dates are cut into value ranges of about equal size, and a rank is the
    count in the ranges below plus the count below inside the range. The cut points are fixed
    by a checkpoint, since both steps must see the same ones; they are joined under ``salts`` copies of
    each date, so that a date's values meet them in many tasks.
    """
    from tapeloom.session import settle

    # The same positions of both zeros: -0.0 and 0.0 are one value.
    known = rows.filter(C(value).isNotNull()).withColumn(value, C(value) + F.lit(0.0))
    tied = known.groupBy(by, value).agg(F.count(F.lit(1)).alias("ties"))
    points = [k / buckets for k in range(1, buckets)]
    cuts = settle(tied.groupBy(by).agg(F.percentile_approx(value, points, 1000).alias("cuts")))
    copies = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = tied.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(salts)).cast("int"))
    placed = salted.join(copies, [by, "salt"]).withColumn(
        "range", F.size(F.filter("cuts", lambda s: s < C(value)))
    ).drop("cuts", "salt")
    sizes = placed.groupBy(by, "range").agg(F.sum("ties").alias("held"))
    below = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns(
        {
            "below": F.coalesce(F.sum("held").over(below), F.lit(0)),
            "names": F.sum("held").over(Window.partitionBy(by)),
        }
    ).drop("held")
    inside = Window.partitionBy(by, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("before", F.coalesce(F.sum("ties").over(inside), F.lit(0))).join(sizes, [by, "range"])
    rank = (C("below") + C("before") + (C("ties") + 1) / 2) / C("names")
    ranks = ranked.select(by, value, F.when(C("names") >= min_names, rank).alias("rank"))
    return known.join(ranks, [by, value])


# The momentum settings and their defaults.
@dataclass(frozen=True)
class Momentum:
    formation: int = 126
    skip: int = 21
    breakout: int = 20
    stop_lookback: int = 20
    atr_buffer: float = 0.5
    trail_ema: int = 20
    max_hold: int = 40
    rank_pct: float = 0.10
    min_volume: float = 1e6
    min_dollar_volume: float = 20e6
    min_names: int = 100


# The 16 momentum settings.
def momentum_grid(**common) -> list[Momentum]:
    """The 16 cross-sectional settings."""
    return [
        Momentum(formation=f, breakout=b, stop_lookback=s, trail_ema=t, **common)
        for f, b, s, t in product((126, 252), (20, 55), (20, 40), (10, 20))
    ]


def momentum_candidates(rows: DataFrame, regime: DataFrame, m: Momentum) -> DataFrame:
    """Strongest long and weakest short breakouts by momentum rank, with their stops.

    ``rows`` carry ema50, ema200, atr and vol20.
    """
    c = C("close")
    df = rows.withColumns(
        {
            "prior_high": r.rolling_max(C("high"), m.breakout, skip=1),
            "prior_low": r.rolling_min(C("low"), m.breakout, skip=1),
            "stop_low": r.rolling_min(C("low"), m.stop_lookback),
            "stop_high": r.rolling_max(C("high"), m.stop_lookback),
            "n": r.bars_count(),
        }
    )
    ranks = average_rank(panel_momentum(rows, m.formation, m.skip), "dt", "momentum", m.min_names)
    ranked = with_regime(df, regime, ("bull", "bear")).join(ranks, ["ticker", "dt"])
    start = max(205, m.formation + 1, m.breakout + 1, m.stop_lookback + 1)
    base = (
        (C("i") >= start)
        & (C("i") < C("n") - 1)
        & C("rank").isNotNull()
        & (C("vol20") >= m.min_volume)
        & (c * C("vol20") >= m.min_dollar_volume)
        & (C("volume") >= 0.8 * C("vol20"))
    )
    up = (C("rank") >= 1 - m.rank_pct) & C("bull") & (c > C("ema200")) & (C("ema50") > C("ema200")) & (c > C("prior_high"))
    down = (C("rank") <= m.rank_pct) & C("bear") & (c < C("ema200")) & (C("ema50") < C("ema200")) & (c < C("prior_low"))
    side = F.when(up, F.lit("long")).when(down, F.lit("short"))
    stop = F.when(up, C("stop_low") - m.atr_buffer * C("atr")).otherwise(C("stop_high") + m.atr_buffer * C("atr"))
    return (
        ranked.filter(base)
        .withColumn("side", side)
        .filter(C("side").isNotNull())
        .select("ticker", "dt", "i", "side", "rank", "momentum", stop.alias("stop"))
    )


def momentum_signals(rows: DataFrame, regime: DataFrame, settings: dict[str, Momentum]) -> DataFrame:
    """Candidates of several settings at once: ticker, dt, i, variant, side, stop, trail, rank, momentum.

    Every distinct formation is ranked once and every distinct level is one window; a bar's settings are
    conditions on those, opened only where they hold.
    """
    c = C("close")
    df = rows
    levels: dict[str, Column] = {}
    for m in settings.values():
        levels[f"top_{m.breakout}"] = r.rolling_max(C("high"), m.breakout, skip=1)
        levels[f"floor_{m.breakout}"] = r.rolling_min(C("low"), m.breakout, skip=1)
        levels[f"low_{m.stop_lookback}"] = r.rolling_min(C("low"), m.stop_lookback)
        levels[f"high_{m.stop_lookback}"] = r.rolling_max(C("high"), m.stop_lookback)
    df = with_regime(df.withColumns(levels | {"n": r.bars_count()}), regime, ("bull", "bear"))
    for formation, skip, least in sorted({(m.formation, m.skip, m.min_names) for m in settings.values()}):
        ranks = average_rank(panel_momentum(rows, formation, skip), "dt", "momentum", least)
        name = f"{formation}_{skip}_{least}"
        df = df.join(ranks.select("ticker", "dt", C("rank").alias(f"rank_{name}"), C("momentum").alias(f"mom_{name}")), ["ticker", "dt"], "left")

    def one(name: str, m: Momentum) -> Column:
        own = f"{m.formation}_{m.skip}_{m.min_names}"
        rank = C(f"rank_{own}")
        start = max(205, m.formation + 1, m.breakout + 1, m.stop_lookback + 1)
        base = (C("i") >= start) & (C("i") < C("n") - 1) & rank.isNotNull() & (C("vol20") >= m.min_volume)
        base = base & (c * C("vol20") >= m.min_dollar_volume) & (C("volume") >= 0.8 * C("vol20"))
        up = (rank >= 1 - m.rank_pct) & C("bull") & (c > C("ema200")) & (C("ema50") > C("ema200")) & (c > C(f"top_{m.breakout}"))
        down = (rank <= m.rank_pct) & C("bear") & (c < C("ema200")) & (C("ema50") < C("ema200")) & (c < C(f"floor_{m.breakout}"))
        away = m.atr_buffer * C("atr")
        stop = F.when(up, C(f"low_{m.stop_lookback}") - away).otherwise(C(f"high_{m.stop_lookback}") + away)
        found = F.struct(
            F.lit(name).alias("variant"),
            F.when(up, F.lit("long")).otherwise(F.lit("short")).alias("side"),
            stop.alias("stop"),
            F.lit(f"ema{m.trail_ema}").alias("trail"),
            rank.alias("rank"),
            C(f"mom_{own}").alias("momentum"),
        )
        return F.when(base & (up | down), found)

    fired = F.filter(F.array(*[one(name, m) for name, m in settings.items()]), lambda x: x.isNotNull())
    return df.select("ticker", "dt", "i", F.inline(fired))


def candle_features(bars: DataFrame) -> DataFrame:
    """Shape of each candle: body, lower wick and place of the close, as shares of its range."""
    height = F.greatest(C("high") - C("low"), F.lit(1e-9))
    return bars.withColumns(
        {
            "body_pct": (C("close") - C("open")) / height,
            "lower_wick": (F.least("open", "close") - C("low")) / height,
            "close_location": (C("close") - C("low")) / height,
            "mom63": r.change(C("close"), 63),
            "vol_vs_20": C("volume") / F.avg("volume").over(r.last_rows(20, skip=1)),
        }
    )


def top_per_day(rows: DataFrame, day: str, feature: str, keep: int, ascending: bool = False) -> DataFrame:
    """Best ``keep`` signals of each entry day by a feature; ticker settles ties.

    Spark cuts each map task to ``keep`` rows per day before the shuffle.
    """
    order = C(feature).asc_nulls_last() if ascending else C(feature).desc_nulls_last()
    place = F.row_number().over(Window.partitionBy(day).orderBy(order, "ticker"))
    return rows.withColumn("place", place).filter(C("place") <= keep)
