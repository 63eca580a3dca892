"""Statistics of labelled trades (ticker, i, entry_date, exit_date, r, ...) per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalar import float_div
from tapeloom.operators.scale import deepest_fall, exact_median, exact_percentiles

C = F.col

# Evaluation splits [from, to).
SPLITS = {
    "train": ("2012-01-01", "2019-01-01"),
    "valid": ("2019-01-01", "2023-01-01"),
    "hold": ("2023-01-01", "2027-01-01"),
}


def profit_factor() -> Column:
    """Gains over losses, null without a losing trade."""
    r = C("r")
    return F.try_divide(F.sum(F.when(r > 0, r).otherwise(0.0)), -F.sum(F.when(r < 0, r)))


def win_rate() -> Column:
    return F.avg(F.when(C("r") > 0, 1.0).otherwise(0.0))


def trade_summary(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Count, hit rate, means, median, profit factor, payoff, and deepest fall of the summed R.

    The running R follows ticker, then signal, as trades are produced.
    """
    r = C("r")
    base = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        win_rate().alias("win_rate"),
        F.avg(r).alias("avg_r"),
        profit_factor().alias("profit_factor"),
        F.avg("held").alias("avg_hold"),
        *([F.avg("planned_rr").alias("avg_planned_rr")] if "planned_rr" in trades.columns else []),
        F.avg(F.when(r > 0, r)).alias("avg_win"),
        (-F.avg(F.when(r < 0, r))).alias("avg_loss"),
    )
    fall = deepest_fall(trades, keys, ["ticker", "i"], r).select(*keys, C("deepest").alias("max_dd_r"))
    median = exact_median(trades, keys, "r", "median_r")
    return base.join(fall, keys).join(median, keys).withColumn("payoff", F.try_divide("avg_win", "avg_loss"))


def by_year(trades: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """Summary per entry year and per side of a split date: parts IS, OOS and the years."""
    parts = F.array(
        F.when(C("entry_date") < F.lit(split).cast("date"), F.lit("IS")).otherwise(F.lit("OOS")),
        F.year("entry_date").cast("string"),
    )
    return (
        trades.withColumn("part", F.explode(parts))
        .groupBy(*keys, "part")
        .agg(
            F.count(F.lit(1)).alias("n"),
            win_rate().alias("win_rate"),
            F.avg("r").alias("avg_r"),
            profit_factor().alias("pf"),
        )
    )


def split_stats(trades: DataFrame, splits: dict[str, tuple[str, str]], keys: list[str]) -> DataFrame:
    """Per key and split: trades opened and closed inside it, hit rate, R, holding, yearly estimate.

    Trades closing after their split are purged. A split's length ends with the key's last entry.
    """
    day = lambda x: F.lit(x).cast("date")
    inside = F.filter(
        F.array(
            *[
                F.when(
                    (C("entry_date") >= day(a)) & (C("entry_date") < day(b)) & (C("exit_date") < day(b)),
                    F.struct(F.lit(s).alias("split"), day(a).alias("from_"), day(b).alias("to_")),
                )
                for s, (a, b) in splits.items()
            ]
        ),
        lambda x: x.isNotNull(),
    )
    last = trades.groupBy(*keys).agg(F.max("entry_date").alias("last_"))
    rows = trades.select("*", F.inline(inside))
    r = C("r")
    g = rows.groupBy(*keys, "split").agg(
        F.count(F.lit(1)).alias("n"),
        win_rate().alias("win"),
        F.avg(r).alias("avg_r"),
        profit_factor().alias("pf"),
        # Holding lengths have at most a few hundred distinct values.
        F.percentile("bars", F.lit(0.5)).alias("bars"),
        F.avg(F.when(C("status") == "unresolved", 1.0).otherwise(0.0)).alias("unres"),
        F.avg(r * C("risk_pct")).alias("pct_per_trade"),
        F.first("from_").alias("from_"),
        F.first("to_").alias("to_"),
    )
    risk = exact_median(rows, [*keys, "split"], "risk_pct", "risk_pct")
    g = g.join(risk, [*keys, "split"]).join(last, keys)
    years = F.greatest(F.datediff(F.least("to_", "last_"), C("from_")) / 365.0, F.lit(1e-9))
    return g.withColumns(
        {"per_year": C("n") / years, "ann_est": F.try_divide(252.0 * C("pct_per_trade"), C("bars"))}
    ).drop("from_", "to_", "last_")


def plateau(cells: DataFrame, metrics: tuple[str, str], stops: tuple[float, ...], targets: tuple[float, ...], min_neighbours: int = 6) -> DataFrame:
    """Cells whose grid neighbours (one step on both axes, itself included) also work, best first.

    cells(rule, sl_atr, rr, metric...). Neighbours are found by equality on shifted axis indexes.
    """
    def index(col: str, grid: tuple[float, ...]) -> Column:
        return F.array_position(F.array(*[F.lit(float(v)) for v in grid]), C(col).cast("double")) - 1

    placed = cells.withColumns({"si": index("sl_atr", stops), "ri": index("rr", targets)})
    near = F.array(*[F.struct(F.lit(a).alias("da"), F.lit(b).alias("db")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    mean = placed.groupBy("rule", "si", "ri").agg(*[F.avg(m).alias(m) for m in metrics])
    offered = mean.filter((C("si") >= 0) & (C("ri") >= 0)).select("*", F.inline(near))
    offered = offered.select("rule", (C("si") + C("da")).alias("si"), (C("ri") + C("db")).alias("ri"), *metrics)
    around = offered.groupBy("rule", "si", "ri").agg(
        *[F.min(m).alias(f"{m}_neigh_min") for m in metrics],
        *[F.avg(m).alias(f"{m}_neigh_mean") for m in metrics],
        F.count(metrics[-1]).alias("neigh_n"),
    )
    a, b = (C(f"{m}_neigh_min") for m in metrics)
    joined = placed.join(around, ["rule", "si", "ri"], "left").withColumn("plateau", F.least(a, b))
    return joined.withColumn(
        "survives", F.coalesce((a > 0) & (b > 0) & (C("neigh_n") >= min_neighbours), F.lit(False))
    ).drop("si", "ri")


def cluster_tstat(trades: DataFrame, keys: list[str], min_months: int = 3) -> DataFrame:
    """Mean R with a standard error that treats the trades of one entry month as one cluster.

    With under ``min_months`` months only the mean and counts are given. What is over an error of
    zero is infinite or NaN, and so is the error of a single month.
    """
    months = trades.groupBy(*keys, F.trunc("entry_date", "month").alias("m")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("r").alias("s"), (F.var_pop("r") * F.count("r")).alias("inside")
    )
    whole = Window.partitionBy(*keys)
    mean = F.sum("s").over(whole) / F.sum("n").over(whole)
    months = months.withColumn("mean", mean)
    off = C("n") * (C("s") / C("n") - C("mean"))  # exactly zero of a single month
    g = months.groupBy(*keys).agg(
        F.first("mean").alias("avg_r"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("clusters"),
        F.sum(off * off).alias("q"),
        # Squares around the common mean: inside each month, and of the months' means.
        F.sum(C("inside") + off * off / C("n")).alias("ss"),
    )
    n, k = C("n"), C("clusters")
    enough = k >= min_months
    se = F.when(enough, F.sqrt(float_div(C("q") / (n * n) * k, k - 1)))
    naive = F.when(enough, F.sqrt(F.try_divide(C("ss"), n - 1) / n))
    g = g.withColumns({"se_cluster": se, "se_naive": naive})
    effect = F.pow(float_div(C("se_cluster"), C("se_naive")), F.lit(2))
    return g.withColumns(
        {"design_effect": effect, "eff_n": float_div(n, effect), "t_cluster": float_div(C("avg_r"), C("se_cluster"))}
    ).drop("q", "ss")


def compound_stats(trades: DataFrame, keys: list[str], ret: Column, floor: float, order: list[str]) -> DataFrame:
    """Compounded growth of trade returns in entry order: multiple, yearly growth, deepest drawdown."""
    step = F.ln(F.greatest(F.lit(floor), 1 + ret))
    g = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("entry_date").alias("a"),
        F.max("exit_date").alias("b"),
    )
    fall = deepest_fall(trades.withColumn("step_", step), keys, order, C("step_"))
    years = F.greatest(F.datediff("b", "a") / 365.25, F.lit(0.25))
    return g.join(fall, keys).select(
        *keys,
        "n",
        F.exp("total").alias("multiple"),
        (F.exp(C("total") / years) - 1).alias("cagr"),
        (F.exp("deepest") - 1).alias("max_dd"),
    )


def series_stats(series: DataFrame, key: str = "ticker") -> DataFrame:
    """Growth, drawdown and calendar years of value series (key, dt, value); a series is bounded by the calendar.

    A series of one day has not grown, and growth over a drawdown of zero is infinite, or NaN without growth.
    """
    so_far = Window.partitionBy(key).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    s = series.withColumn("fall", C("value") / F.max("value").over(so_far) - 1)
    years = s.groupBy(key, F.year("dt").alias("year")).agg(
        F.max_by("value", "dt").alias("end"),
        F.min_by("value", "dt").alias("start"),
        F.min("dt").alias("a"),
        F.max("dt").alias("b"),
        F.min("fall").alias("fall"),
    )
    ordered = Window.partitionBy(key).orderBy("year")
    years = years.withColumn("ret", C("end") / F.coalesce(F.lag("end").over(ordered), C("start")) - 1)
    g = years.groupBy(key).agg(
        F.min_by("start", "year").alias("first"),
        F.max_by("end", "year").alias("final"),
        F.datediff(F.max("b"), F.min("a")).alias("days"),
        F.min("fall").alias("max_dd"),
        F.min("ret").alias("worst_year"),
        F.count_if(C("ret") < 0).alias("neg_years"),
        F.map_from_entries(F.collect_list(F.struct("year", "ret"))).alias("yearly"),
    )
    cagr = F.when(C("days") == 0, 0.0).otherwise(F.pow(C("final") / C("first"), F.try_divide(F.lit(365.25), C("days"))) - 1)
    return g.withColumn("cagr", cagr).withColumn("mar", float_div(C("cagr"), F.abs("max_dd"))).drop("first", "days")


def variant_rank(trades: DataFrame, split: str) -> DataFrame:
    """Variants by out-of-sample score: mean R times the root of the count."""
    later = trades.filter(C("entry_date") >= F.lit(split).cast("date"))
    g = later.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("avg_r"))
    return g.withColumn("score", C("avg_r") * F.sqrt("n")).orderBy(F.desc("score"), "variant")


CELL_SUMS = ("n", "wins", "sum_r", "gain", "loss", "losers")


def _cell_metrics(prefix: str) -> list[Column]:
    """Metrics of a cell from its sums, with the sentinels of empty cells and of cells without losses."""
    n, wins, total, gain, loss, losers = (F.coalesce(C(f"{prefix}_{c}"), F.lit(0)) for c in CELL_SUMS)
    empty = n == 0
    mean_win, mean_loss = F.try_divide(gain, wins), F.try_divide(loss, losers)
    return [
        n.cast("bigint").alias(f"{prefix}_n"),
        F.when(empty, 0.0).otherwise(F.try_divide(wins, n)).alias(f"{prefix}_win"),
        F.when(empty, -9.0).otherwise(F.try_divide(total, n)).alias(f"{prefix}_avg"),
        F.when(empty, 0.0).when(loss > 0, F.try_divide(gain, loss)).otherwise(99.0).alias(f"{prefix}_pf"),
        F.when(empty, 0.0).otherwise(F.try_divide(mean_win, mean_loss)).alias(f"{prefix}_payoff"),
    ]


PARTS = ("train", "valid", "hold")


def _pair_sums(features: list[str], slots: int) -> Callable:
    """Sums of a task's rows for each part and each pair of slots of two features, or of one paired with itself.

    Rows hold part, r and the slot of each feature, null for a missing value, which joins no cell.
    """
    pairs = [(a, b) for a in range(len(features)) for b in range(a, len(features))]
    size = len(PARTS) * slots * slots

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(CELL_SUMS), len(pairs), size))
        for batch in batches:
            part = pc.fill_null(pc.index_in(batch.column(0), pa.array(PARTS)), -1).to_numpy(zero_copy_only=False)
            r = np.nan_to_num(pc.fill_null(batch.column(1), 0.0).to_numpy(zero_copy_only=False))
            slot = [pc.fill_null(c, -1).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[2:]]
            gain, loss = np.maximum(r, 0.0), np.maximum(-r, 0.0)
            weights = (None, (r > 0).astype(float), r, gain, loss, (r < 0).astype(float))
            for k, (a, b) in enumerate(pairs):
                inside = (part >= 0) & (slot[a] >= 0) & (slot[b] >= 0)
                cell = ((part * slots + slot[a]) * slots + slot[b])[inside]
                for out, w in zip(held, weights):
                    out[k] += np.bincount(cell, None if w is None else w[inside], size)
        pair, cell = np.nonzero(held[0])
        one, two = np.array(pairs, np.int64)[pair].T
        names = pa.array(features)
        found = [held[k][pair, cell] for k in range(len(CELL_SUMS))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(PARTS).take(pa.array(cell // (slots * slots))),
                names.take(pa.array(one)),
                pa.array((cell // slots % slots).astype(np.int32)),
                names.take(pa.array(two)),
                pa.array((cell % slots).astype(np.int32)),
                *[pa.array(x if c in ("sum_r", "gain", "loss") else x.astype(np.int64)) for c, x in zip(CELL_SUMS, found)],
            ],
            ["part", "fa", "sa", "fb", "sb", *CELL_SUMS],
        )

    return add


def condition_mining(
    rows: DataFrame,
    features: list[str],
    shares: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8),
    min_n: int = 60,
    min_win: float = 0.42,
    top: int = 300,
) -> DataFrame:
    """Best single and paired threshold conditions on train rows, with their figures on the other parts.

    rows(part in train, valid, hold; r; features). Thresholds are train percentiles. A row is
    reduced to the slot of each feature between the thresholds; every task sums its rows per pair of
    slots and passes on those sums alone, so the conditions are worked out on a small table.
    """
    long = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), C(f).cast("double").alias("value")) for f in features]))
    train = rows.filter(C("part") == "train").select(long)
    cuts = exact_percentiles(train, ["feature"], "value", list(shares))
    # A map of the fixed feature list to its few thresholds.
    table = cuts.groupBy("feature").agg(F.sort_array(F.collect_list("quantile")).alias("cuts"))
    packed = table.agg(F.map_from_entries(F.collect_list(F.struct("feature", "cuts")))).scalar()
    r = C("r")
    slotted = rows.withColumn("cuts", packed).select("part", "r", *[_slot(f).alias(f) for f in features])
    kinds = "part string, fa string, sa int, fb string, sb int, n bigint, wins bigint, sum_r double, gain double, loss double, losers bigint"
    cells = slotted.select("part", r.cast("double"), *features).mapInArrow(_pair_sums(features, 2 * len(shares) + 1), kinds)
    sums = cells.groupBy("part", "fa", "sa", "fb", "sb").agg(*[F.sum(c).alias(c) for c in CELL_SUMS])

    # Slot 2k is strictly between thresholds k-1 and k, slot 2k+1 is threshold k itself.
    def met(slot: Column) -> Column:
        tests = []
        for k in range(len(shares)):
            for op, ok in ((">=", slot >= 2 * k + 1), ("<=", slot <= 2 * k + 1)):
                tests.append(F.when(ok, F.struct(F.lit(op).alias("op"), F.lit(k).alias("k"))))
        return F.filter(F.array(*tests), lambda x: x.isNotNull())

    single = C("fa") == C("fb")
    none = F.array(F.struct(F.lit("").alias("op"), F.lit(-1).alias("k")))
    spread = sums.withColumn("ca", F.explode(met(C("sa")))).withColumn(
        "cb", F.explode(F.when(single, none).otherwise(met(C("sb"))))
    )
    totals = spread.groupBy("fa", "ca", "fb", "cb").pivot("part", ["train", "valid", "hold"]).agg(
        *[F.sum(c).alias(c) for c in CELL_SUMS]
    )
    figures = totals.select(
        "fa", "ca", "fb", "cb", *[m for p in ("train", "valid", "hold") for m in _cell_metrics(p)]
    )
    kept = figures.filter((C("train_n") >= min_n) & (C("train_avg") > 0) & (C("train_win") >= min_win))
    # Rounded, so that conditions choosing the same rows tie, and their names decide.
    kept = kept.withColumn("score", F.round(F.least("train_win", F.lit(0.7)) + C("train_avg") * 0.1, 9))
    best = kept.orderBy(F.desc("score"), "fa", "ca", "fb", "cb").limit(top)
    return best.withColumn(
        "selection_score", F.least("train_win", "valid_win") + F.least("train_avg", "valid_avg") * 0.1
    )


def _slot(feature: str) -> Column:
    cuts, x = C("cuts")[feature], C(feature)
    below = F.size(F.filter(cuts, lambda c: c < x))
    on = F.exists(cuts, lambda c: c == x)
    return F.when(x.isNotNull(), 2 * below + F.when(on, 1).otherwise(0))
