"""Chart patterns on intraday bars, for all tickers at once.

Only the last few sessions of a ticker are looked at (26 regular quarter-hour bars each),
so its pivots fit one row: a *chart* holds the bar times and the pivot highs and lows as
arrays, and every pattern is an expression over that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalar import unix_seconds
from tapeloom.operators.screen import pivots

C = F.col
TINY = 2.220446049250313e-16

# Labels of the drawn lines and of the break marker.
LABELS = {
    "trendline": "下降トレンドライン",
    "inverse": "逆三尊 ネックライン",
    "double": "ダブルボトム ネックライン",
    "tri_upper": "三角収束 上辺",
    "tri_lower": "三角収束 下辺",
    "flag_upper": "上昇フラッグ 上辺",
    "flag_lower": "上昇フラッグ 下辺",
    "break": "ブレイク",
}


def format_intraday(raw: DataFrame, extended: bool = False, sessions: int = 5, zone: str = "America/New_York") -> DataFrame:
    """Feed bars (ticker, t, o, h, l, c, v) -> bars of each ticker's newest sessions.

    ``t`` (epoch seconds or milliseconds) becomes chart time, which reads as local clock;
    regular sessions run from 09:30:00 to 15:59:59 local. ``i`` numbers the bars from 0.
    """
    known = raw.dropna(subset=["t", "o", "h", "l", "c"])
    at = F.timestamp_seconds(unix_seconds(C("t")))
    offset = F.unix_micros(F.from_utc_timestamp(at, zone)) - F.unix_micros(at)
    b = known.select(
        "ticker",
        (unix_seconds(C("t")) + F.floor(offset / 1_000_000)).cast("bigint").alias("time"),
        C("o").cast("double").alias("open"),
        C("h").cast("double").alias("high"),
        C("l").cast("double").alias("low"),
        C("c").cast("double").alias("close"),
        F.coalesce(C("v").cast("double"), F.lit(0.0)).alias("volume"),
    )
    clock = F.pmod(C("time"), F.lit(86400))
    if not extended:
        b = b.filter(clock.between(9 * 3600 + 1800, 16 * 3600 - 1))
    b = b.withColumn("session", F.floor(C("time") / 86400))
    newest = Window.partitionBy("ticker").orderBy(F.desc("session"))
    recent = (
        b.select("ticker", "session")
        .distinct()
        .withColumn("k", F.row_number().over(newest))
        .filter(C("k") <= sessions)
        .select("ticker", "session")
    )
    kept = b.join(recent, ["ticker", "session"], "left_semi")
    pos = F.row_number().over(Window.partitionBy("ticker").orderBy("time")).cast("bigint") - 1
    return kept.withColumn("i", pos).select("ticker", "i", "time", "open", "high", "low", "close", "volume")


def chart_pivots(bars: DataFrame, k: int = 3) -> DataFrame:
    return pivots(bars.withColumn("dt", C("time")), k=k, lookback=None)


def charts(bars: DataFrame, k: int = 3) -> DataFrame:
    """One row per ticker: n, times, last close, and pivot arrays of (pos, value) in time order."""
    found = chart_pivots(bars, k)
    point = F.struct("pos", "value")
    marks = found.groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.when(C("kind") == "high", point))).alias("highs"),
        F.sort_array(F.collect_list(F.when(C("kind") == "low", point))).alias("lows"),
    )
    base = bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_list("time")).alias("times"),
        F.max_by("close", "i").alias("last_close"),
    )
    none = F.array().cast("array<struct<pos:bigint,value:double>>")
    return base.join(marks, "ticker", "left").withColumns(
        {"highs": F.coalesce("highs", none), "lows": F.coalesce("lows", none)}
    )


def _neighbours(points: Column, size: int) -> Column:
    """Runs of ``size`` adjacent pivots, oldest first."""
    count = F.greatest(F.size(points) - (size - 1), F.lit(0))
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts, lambda s: F.struct(*[F.element_at(points, s + k).alias(f"p{k}") for k in range(size)])
    )


def _newest(runs: Column) -> Column:
    return F.try_element_at(runs, F.lit(-1))


def _at(pos: Column) -> Column:
    return F.element_at("times", (pos + 1).cast("int"))


def _line(kind: str, label: str, start: Column, first: Column, last: Column) -> Column:
    point = lambda t, p: F.struct(t.alias("time"), p.alias("price"))
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(LABELS[label]).alias("label"),
        F.array(point(_at(start), first), point(_at(C("n") - 1), last)).alias("points"),
    )


def _wide_enough(start: Column, end: Column, ratio: float) -> Column:
    return (end > start) & ((end - start) >= C("n") * ratio)


def with_descending_pair(chart: DataFrame) -> DataFrame:
    """Adds the newest adjacent pivot highs of which the later is lower, and the slope between them."""
    pair = _newest(F.filter(_neighbours(C("highs"), 2), lambda r: r["p1"]["value"] < r["p0"]["value"]))
    fall = C("pair.p1.value") - C("pair.p0.value")
    out = chart.withColumn("pair", pair)
    return out.withColumn("pair_slope", fall / (C("pair.p1.pos") - C("pair.p0.pos")))


def trendline(ratio: float = 0.15) -> Column:
    """Falling line from the first pivot of the pair to the last bar."""
    start, slope = C("pair.p0.pos"), C("pair_slope")
    base = C("pair.p0.value") - slope * start
    drawn = _line("trendline", "trendline", start, slope * start + base, slope * (C("n") - 1) + base)
    return F.when(_wide_enough(start, C("pair.p1.pos"), ratio), F.array(drawn))


def break_marker() -> Column:
    """Marker on the last bar when it closes above the projected line; the width does not matter."""
    projected = C("pair.p1.value") + C("pair_slope") * (C("n") - 1 - C("pair.p1.pos"))
    return F.when(
        C("last_close") > projected,
        F.struct(_at(C("n") - 1).alias("time"), F.lit(LABELS["break"]).alias("text")),
    )


def _neck(start: Column, end: Column) -> Column:
    """Highest pivot high strictly between two positions, null without any."""
    between = F.filter("highs", lambda h: (h["pos"] > start) & (h["pos"] < end))
    return F.array_max(F.transform(between, lambda h: h["value"]))


def _alike(a: Column, b: Column, tol: float) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(TINY)) <= tol


def with_bottoms(chart: DataFrame, tol: float = 0.015, ratio: float = 0.15) -> DataFrame:
    """Adds the newest inverse head and shoulders and the newest double bottom, with their necks."""

    def shoulders(r: Column) -> Column:
        left, head, right = r["p0"], r["p1"], r["p2"]
        return (
            (head["value"] < left["value"])
            & (head["value"] < right["value"])
            & _alike(left["value"], right["value"], tol)
            & _wide_enough(left["pos"], right["pos"], ratio)  # before the searches below, which cost most
            & _neck(left["pos"], head["pos"]).isNotNull()
            & _neck(head["pos"], right["pos"]).isNotNull()
        )

    def twin(r: Column) -> Column:
        a, b = r["p0"], r["p1"]
        return (
            _alike(a["value"], b["value"], tol)
            & _wide_enough(a["pos"], b["pos"], ratio)
            & _neck(a["pos"], b["pos"]).isNotNull()
        )

    found = chart.withColumns(
        {
            "ihs": _newest(F.filter(_neighbours(C("lows"), 3), shoulders)),
            "dbl": _newest(F.filter(_neighbours(C("lows"), 2), twin)),
        }
    )
    return found.withColumns(
        {
            "ihs_neck": (
                _neck(C("ihs.p0.pos"), C("ihs.p1.pos")) + _neck(C("ihs.p1.pos"), C("ihs.p2.pos"))
            )
            / 2.0,
            "dbl_neck": _neck(C("dbl.p0.pos"), C("dbl.p1.pos")),
        }
    )


def bottoms() -> Column:
    """Neckline of the inverse head and shoulders, else of the double bottom."""
    ihs, dbl = C("ihs_neck"), C("dbl_neck")
    return F.when(ihs.isNotNull(), F.array(_line("neckline", "inverse", C("ihs.p0.pos"), ihs, ihs))).when(
        dbl.isNotNull(), F.array(_line("neckline", "double", C("dbl.p0.pos"), dbl, dbl))
    )


def with_rails(chart: DataFrame, found: DataFrame, count: int = 3) -> DataFrame:
    """Adds least-squares lines through the newest pivot highs (u\\_) and lows (l\\_)."""
    newest = Window.partitionBy("ticker", "kind").orderBy(F.desc("pos"))
    recent = found.withColumn("k", F.row_number().over(newest)).filter(C("k") <= count)
    fits = recent.groupBy("ticker").pivot("kind", ["high", "low"]).agg(
        F.count(F.lit(1)).alias("k"),
        F.min("pos").alias("first"),
        F.max("pos").alias("last"),
        F.regr_slope("value", "pos").alias("slope"),
        F.regr_intercept("value", "pos").alias("base"),
        F.avg("value").alias("mean"),
    )
    fits = fits.filter((C("high_k") == count) & (C("low_k") == count))
    return chart.join(fits.drop("high_k", "low_k"), "ticker", "left")


def flag_triangle(
    ratio: float = 0.15,
    convergence: float = 0.70,
    horizontal: float = 0.0005,
    parallel: float = 0.0015,
    steepest: float = 0.02,
) -> Column:
    """Contracting triangle, else bull flag, from the rails of ``with_rails``."""
    start = F.least("high_first", "low_first")
    end = F.greatest("high_last", "low_last")
    wide = _wide_enough(start, end, ratio)

    def rail(side: str, x: Column) -> Column:
        return C(f"{side}_slope") * x + C(f"{side}_base")

    def steepness(side: str) -> Column:
        return C(f"{side}_slope") / F.greatest(F.abs(C(f"{side}_mean")), F.lit(TINY))

    upper, lower = steepness("high"), steepness("low")
    w0 = rail("high", start) - rail("low", start)
    w1 = rail("high", end) - rail("low", end)
    triangle = (upper < 0) & (lower > 0) & (w0 > 0) & (w1 >= 0) & (w1 < w0) & (w1 <= w0 * convergence)
    flag = (
        upper.between(-steepest, horizontal)
        & lower.between(-steepest, horizontal)
        & (F.abs(upper - lower) <= parallel)
    )
    last = C("n") - 1

    def pair(kind: str) -> Column:
        return F.array(
            *[
                _line(f"{kind}_{name}", f"{kind}_{name}", C(f"{side}_first"), rail(side, C(f"{side}_first")), rail(side, last))
                for side, name in (("high", "upper"), ("low", "lower"))
            ]
        )

    return F.when(wide & triangle, pair("tri")).when(wide & flag, pair("flag"))


def detect(bars: DataFrame, k: int = 3, ratio: float = 0.15, convergence: float = 0.70) -> DataFrame:
    """Per ticker: lines of the first pattern found (flag or triangle, bottoms, trendline) and the marker."""
    chart = with_rails(charts(bars, k), chart_pivots(bars, k))
    chart = with_bottoms(with_descending_pair(chart), ratio=ratio)
    none = F.array().cast("array<struct<type:string,label:string,points:array<struct<time:bigint,price:double>>>>")
    lines = F.coalesce(flag_triangle(ratio, convergence), bottoms(), trendline(ratio), none)
    return chart.select("ticker", lines.alias("lines"), break_marker().alias("marker"))


def explode_lines(found: DataFrame, lines: str = "lines") -> DataFrame:
    """One row per drawn line with its two end points."""
    line = found.select("ticker", F.explode(lines).alias("x"))
    p = C("x.points")
    return line.select(
        "ticker",
        C("x.type").alias("type"),
        C("x.label").alias("label"),
        p[0]["time"].alias("t1"),
        p[0]["price"].alias("p1"),
        p[1]["time"].alias("t2"),
        p[1]["price"].alias("p2"),
    )


# Base pattern names and marker texts.
CUP, VCP, ASCENDING, FLAT = "カップ&ハンドル", "VCP", "アセンディング△", "フラットベース"
MARKS = {"bottom": "カップ底", "rim": "左リム", "handle": "ハンドル", "start": "ベース開始", "break": "ブレイクアウト✓"}


def base_marks(bars: DataFrame, bases: DataFrame) -> DataFrame:
    """Markers of each ticker's base: the last base_length + 5 bars, marked as its pattern asks.

    bases(ticker, pattern, base_length, breakout). Gives (ticker, dt, label).
    """
    b = bars.join(bases, "ticker").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker")))
    m = F.least(C("n"), C("base_length") + 5)
    b = b.withColumn("m", m).withColumn("pos", C("i") - (C("n") - C("m"))).filter(C("pos") >= 0)
    whole = Window.partitionBy("ticker")
    around = Window.partitionBy("ticker").orderBy("i").rowsBetween(-3, 3)
    seg = F.greatest(F.lit(5), F.floor(C("m") / 4))
    b = b.withColumns({"seg": seg, "part": F.floor(C("pos") / seg), "height": C("high") - C("low")})
    in_part = Window.partitionBy("ticker", "part").orderBy("height", "pos")
    inner = (C("pos") >= 3) & (C("pos") < C("m") - 3)
    b = b.withColumns(
        {
            "bottom": F.min_by("pos", F.struct("low", "pos")).over(whole),
            "tight": F.row_number().over(in_part) == 1,
            "swing": inner & (C("low") == F.min("low").over(around)),
        }
    )
    b = b.withColumn(
        "swing_no",
        F.sum(C("swing").cast("int")).over(Window.partitionBy("ticker").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)),
    )
    pos, pattern = C("pos"), C("pattern")
    handle = F.greatest(F.lit(0), C("m") - F.floor(C("m") * 0.25))
    cup, vcp, asc, flat = (pattern == x for x in (CUP, VCP, ASCENDING, FLAT))
    labels = F.array(
        F.when(cup & (pos == C("bottom")), F.lit(MARKS["bottom"])),
        F.when(cup & (pos == 0), F.lit(MARKS["rim"])),
        F.when(cup & (pos == handle) & (handle > C("bottom")), F.lit(MARKS["handle"])),
        F.when(
            vcp & C("tight") & (C("part") * C("seg") < C("m") - C("seg")),
            F.concat(F.lit("T"), (C("part") + 1).cast("string")),
        ),
        F.when(asc & C("swing"), F.concat(F.lit("L"), C("swing_no").cast("string"))),
        F.when(flat & (pos == 0), F.lit(MARKS["start"])),
        F.when(flat & (pos == C("m") - 1), F.concat(C("m").cast("string"), F.lit("日"))),
        F.when(C("breakout") & (pos == C("m") - 1), F.lit(MARKS["break"])),
        F.when((C("m") > 2) & (pos == F.floor(C("m") / 2)), pattern),
    )
    return b.select("ticker", "dt", F.explode(F.filter(labels, lambda x: x.isNotNull())).alias("label"))


def base_rails(bars: DataFrame, bases: DataFrame) -> DataFrame:
    """High and low rail of each ticker's base."""
    b = bars.join(bases, "ticker").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker")))
    inside = b.filter(C("n") - C("i") <= C("base_length") + 5)
    return inside.groupBy("ticker").agg(F.max("high").alias("base_high"), F.min("low").alias("base_low"))
