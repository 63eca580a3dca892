"""Filtering, counting and ordering of screen results (picks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col

# Facet -> admitted values, and the order weight of each volume verdict.
FACETS: dict[str, tuple[str, ...]] = {
    "verdict": (
        "bounce_confirmed",
        "healthy_pullback",
        "accumulation",
        "selling_climax",
        "quiet_setup",
        "neutral",
        "weak_bounce",
        "distribution",
        "selling_pressure",
    ),
    "dow_trend": ("up", "neutral", "down"),
    "state": ("bounced", "pulling"),
    "price_zone": ("high", "mid", "low"),
}
VERDICT_WEIGHT = {
    "bounce_confirmed": 3,
    "healthy_pullback": 2,
    "accumulation": 2,
    "selling_climax": 1,
    "quiet_setup": 0,
    "neutral": 0,
    "weak_bounce": -1,
    "distribution": -2,
    "selling_pressure": -2,
}
DEFAULT_SELECTION = {
    "verdict": FACETS["verdict"],
    "dow_trend": ("up", "neutral"),
    "state": FACETS["state"],
    "price_zone": FACETS["price_zone"],
}
NUMBER_KEYS = ("price", "touch_days_ago", "adx", "rs63", "rs126", "atr_pct", "ema20_dist", "dollar_vol", "po_weeks")
SORT_KEYS = ("ticker", "state", "dow_trend", "verdict", *NUMBER_KEYS)


def checked_adx(value: float | None, default: float = 25.0) -> float:
    return value if value is not None and 15 <= value <= 35 else default


def checked_selection(chosen: dict[str, object] | None) -> dict[str, tuple[str, ...]]:
    """Chosen facet values, unknown ones removed; a facet that is no list of texts falls back to its default."""
    out = {}
    for facet, values in FACETS.items():
        given = (chosen or {}).get(facet)
        ok = isinstance(given, (list, tuple)) and all(isinstance(v, str) for v in given)
        out[facet] = tuple(v for v in values if v in given) if ok else DEFAULT_SELECTION[facet]
    return out


def checked_sorts(sorts: list[tuple[str | None, int]] | None) -> list[tuple[str, int]]:
    """Up to three (key, direction) pairs; unknown keys fall back, a missing first key voids the rest."""
    fallback = [("rs126", -1), (None, -1), (None, -1)]
    if not sorts or len(sorts) != 3:
        sorts = fallback
    fixed = [
        s if s[0] is None or s[0] in SORT_KEYS else fallback[k] for k, s in enumerate(sorts)
    ]
    if fixed[0][0] is None:
        return [("rs126", -1)]
    return [(k, 1 if d == 1 else -1) for k, d in fixed if k is not None]


def _facet_column(facet: str) -> Column:
    return C(f"volume.{facet}") if facet in ("verdict", "price_zone") else C(facet)


def _passes(facet: str, selected: tuple[str, ...]) -> Column:
    """Null-aware membership; an empty selection passes all, and so does a pick without volume."""
    if not selected:
        return F.lit(True)
    member = F.coalesce(_facet_column(facet).isin(*selected), F.lit(False))
    return member | C("volume").isNull() if facet in ("verdict", "price_zone") else member


def _adx_passes(adx_min: float | None) -> Column:
    return F.lit(True) if adx_min is None else F.coalesce(C("adx") >= adx_min, F.lit(False))


def filter_picks(picks: DataFrame, adx_min: float | None, selection: dict[str, tuple[str, ...]]) -> DataFrame:
    kept = _adx_passes(adx_min)
    for facet, selected in selection.items():
        kept = kept & _passes(facet, selected)
    return picks.filter(kept)


def facet_counts(picks: DataFrame, adx_min: float | None, selection: dict[str, tuple[str, ...]]) -> DataFrame:
    """For every facet value, the picks passing all other facets: one aggregation pass."""
    counters, labels = [], []
    for facet, values in FACETS.items():
        others = _adx_passes(adx_min)
        for other, selected in selection.items():
            if other != facet:
                others = others & _passes(other, selected)
        for value in values:
            counters.append(F.count_if(others & (_facet_column(facet) == value)).alias(f"c{len(labels)}"))
            labels.append((facet, value))
    row = picks.agg(*counters)
    pairs = [
        F.struct(F.lit(f).alias("facet"), F.lit(v).alias("value"), C(f"c{k}").alias("n"))
        for k, (f, v) in enumerate(labels)
    ]
    return row.select(F.inline(F.array(*pairs)))


def sort_picks(picks: DataFrame, sorts: list[tuple[str, int]], *position: str) -> DataFrame:
    """Order by up to three keys, missing values last in both directions, then by input position."""
    weights = F.create_map(*[F.lit(x) for pair in VERDICT_WEIGHT.items() for x in pair])
    order = []
    for key, direction in sorts:
        col = F.coalesce(weights[C("volume.verdict")], F.lit(0)) if key == "verdict" else C(key)
        order.append(col.asc_nulls_last() if direction > 0 else col.desc_nulls_last())
    return picks.orderBy(*order, *[C(p).asc() for p in position])


def latest_picks(history: DataFrame) -> DataFrame:
    newest = history.agg(F.max("scan_date")).scalar()
    return history.filter(C("scan_date") == newest).orderBy("ticker")


def latest_levels(history: DataFrame) -> DataFrame:
    """Levels of each ticker's newest pick (scan date, then id)."""
    return history.groupBy("ticker").agg(F.max_by("levels", F.struct("scan_date", "id")).alias("levels"))


def parse_levels(text: Column) -> Column:
    """JSON object of numbers; anything else gives an empty map."""
    empty = F.create_map().cast("map<string,double>")
    return F.coalesce(F.from_json(text, "map<string,double>"), empty)


# Level name -> line label.
LEVEL_LABELS = {
    "ema20": "日足EMA20",
    "swing_high": "直近スイング高値",
    "swing_low": "直近スイング安値",
    "band_high": "出来高集中帯上端",
    "band_low": "出来高集中帯下端",
}


def level_lines(levels: DataFrame) -> DataFrame:
    """One line per known level of the ``levels`` struct."""
    band = C("levels.vol_band")
    values = {
        "ema20": C("levels.ema20"),
        "swing_high": C("levels.swing_high"),
        "swing_low": C("levels.swing_low"),
        "band_high": F.when(F.size(band) == 2, F.try_element_at(band, F.lit(2))),
        "band_low": F.when(F.size(band) == 2, F.try_element_at(band, F.lit(1))),
    }
    lines = F.filter(
        F.array(
            *[F.struct(F.lit(LEVEL_LABELS[k]).alias("label"), v.cast("double").alias("price")) for k, v in values.items()]
        ),
        lambda x: x["price"].isNotNull(),
    )
    return levels.select("ticker", F.inline(lines))


def reconcile(stored: DataFrame, expected: DataFrame, values: list[str], tolerance: float = 0.011) -> DataFrame:
    """Stored against recomputed plans by verdict: counts, range of rr, rr in 1.5..2.0, and mismatches."""
    again = expected.select("ticker", *[C(v).alias(f"want_{v}") for v in values])
    ok = F.lit(True)
    for v in values:
        ok = ok & F.coalesce(F.abs(C(v) - C(f"want_{v}")) < tolerance, F.lit(False))
    return (
        stored.join(again, "ticker", "left")
        .groupBy("verdict")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("rr").alias("lo"),
            F.max("rr").alias("hi"),
            F.count_if(C("rr").between(1.5, 2.0)).alias("in_range"),
            F.count_if(~ok).alias("errors"),
        )
    )
