"""Bootstraps and permutation nulls. Draws come from a hash of their coordinates, so runs repeat."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C = F.col


def draw(seed: str, *at: Column) -> Column:
    """Uniform whole number in [0, 2**32) at the given coordinates."""
    text = F.concat_ws("/", F.lit(seed), *[c.cast("string") for c in at])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def block_bootstrap(
    spark: SparkSession, trades: DataFrame, iters: int = 2000, seed: str = "block", min_months: int = 5
) -> DataFrame:
    """Interval of the mean R when whole entry months are resampled; no row under ``min_months`` months.

    Trades are summed per month first, so what is resampled has one row per calendar month.
    """
    months = trades.groupBy(F.trunc("entry_date", "month").alias("m")).agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"))
    placed = months.select(
        "s",
        "n",
        (F.row_number().over(Window.orderBy("m")) - 1).cast("bigint").alias("k"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("g"),
    ).filter(C("g") >= min_months)
    size = placed.agg(F.max("g")).scalar()
    picks = (
        spark.range(iters)
        .select(C("id").alias("it"), size.alias("g"))
        .filter(C("g").isNotNull())
        .select("it", "g", F.explode(F.sequence(F.lit(0).cast("bigint"), C("g") - 1)).alias("pos"))
        .select("it", (draw(seed, C("it"), C("pos")) % C("g")).alias("k"))
    )
    means = picks.join(placed.drop("g"), "k").groupBy("it").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return means.agg(
        F.count(F.lit(1)).alias("iters"),
        F.percentile("mean", F.lit(0.025)).alias("ci_lo"),
        F.percentile("mean", F.lit(0.975)).alias("ci_hi"),
        F.avg(F.when(C("mean") <= 0, 1.0).otherwise(0.0)).alias("p_le_zero"),
    ).filter(C("iters") > 0)


def stationary_paths(spark: SparkSession, series: DataFrame, iters: int, block: int = 40, seed: str = "path") -> DataFrame:
    """Resampled paths of one daily value series (dt, value): final multiple, drawdown and lowest point.

    Every step restarts at a random day with chance 1/block, else it goes on to the next day,
    wrapping at the end. A path is as long as the series, which the calendar bounds. Series of
    fewer than three blocks give no rows.
    """
    order = Window.orderBy("dt")
    rets = series.withColumn("ret", C("value") / F.lag("value").over(order) - 1).filter(C("ret").isNotNull())
    rets = rets.select(
        (F.row_number().over(order) - 1).cast("bigint").alias("k"),
        F.log1p("ret").alias("step"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n"),
    ).filter(C("n") >= 3 * block)
    size = rets.agg(F.max("n")).scalar()
    steps = (
        spark.range(iters)
        .select(C("id").alias("it"), size.alias("n"))
        .filter(C("n").isNotNull())
        .select("it", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), C("n") - 1)).alias("pos"))
    )
    restart = (C("pos") == 0) | (draw(seed + "-go", C("it"), C("pos")) % block == 0)
    start = F.when(restart, F.struct(C("pos").alias("at"), (draw(seed + "-to", C("it"), C("pos")) % C("n")).alias("day")))
    path = Window.partitionBy("it").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    held = steps.withColumn("start", start).withColumn("from_", F.last("start", ignorenulls=True).over(path))
    walked = held.select("it", "pos", "n", ((C("from_.day") + C("pos") - C("from_.at")) % C("n")).alias("k"))
    levels = walked.join(rets.select("k", "step"), "k").withColumn("level", F.sum("step").over(path))
    falls = levels.withColumn("fall", C("level") - F.max("level").over(path))
    return falls.groupBy("it").agg(
        F.exp(F.max_by("level", "pos")).alias("final"),
        (F.exp(F.min("fall")) - 1).alias("drawdown"),
        F.exp(F.min("level")).alias("lowest"),
        (F.first("n") / 252.0).alias("years"),
    )


def realised_drawdown(series: DataFrame) -> DataFrame:
    """Deepest fall of one daily value series (dt, value) below its running maximum. One row."""
    so_far = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)  # one row per calendar day
    return series.select((C("value") / F.max("value").over(so_far) - 1).alias("fall")).agg(F.min("fall").alias("dd_realised"))


def path_report(paths: DataFrame, ruin: float = 0.10) -> DataFrame:
    """Spread of drawdown and yearly growth over resampled paths, ruin share and hit shares."""
    p = paths.withColumn("cagr", F.pow("final", 1 / C("years")) - 1)
    share = lambda ok: F.avg(F.when(ok, 1.0).otherwise(0.0))
    q = lambda c, s: F.percentile(c, F.lit(s))
    return p.agg(
        F.count(F.lit(1)).alias("iters"),
        q("drawdown", 0.5).alias("dd_p50"),
        q("drawdown", 0.05).alias("dd_p95"),
        share(C("drawdown") > -0.30).alias("p_within_30"),
        q("cagr", 0.05).alias("cagr_p05"),
        q("cagr", 0.5).alias("cagr_p50"),
        q("cagr", 0.95).alias("cagr_p95"),
        share(C("lowest") <= ruin).alias("p_ruin"),
        share(C("cagr") >= 3.0).alias("p_hit_300"),
        share(C("cagr") >= 0.5).alias("p_hit_50"),
    )


def _rotated(iters: int, seed: str) -> Callable:
    """Per ticker and iteration: how many labels its rotated signals meet, how many hold a value, and their sum."""

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, held = np.zeros(iters, np.int64), np.zeros(iters, np.int64)
        total = np.zeros(iters)
        for batch in batches:
            for ticker, n, signals, at, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:]):
                where = signals.values.to_numpy(zero_copy_only=False)
                labelled, value = np.zeros(n, np.int64), np.zeros(n)
                known = np.zeros(n, np.int64)
                spots, values = at.values.to_numpy(zero_copy_only=False), r.values.to_numpy(zero_copy_only=False).astype(float)
                inside = spots < n
                spots, values = spots[inside], values[inside]
                there = ~np.isnan(values)
                np.add.at(labelled, spots, 1)
                np.add.at(known, spots[there], 1)
                np.add.at(value, spots[there], values[there])
                for it in range(iters):
                    drawn = int(hashlib.md5(f"{seed}/{it}/{ticker}".encode()).hexdigest()[:8], 16)
                    spot = (where + (260 + drawn % max(n - 520, 1) if n > 600 else 0)) % n
                    met[it] += labelled[spot].sum()
                    held[it] += known[spot].sum()
                    total[it] += value[spot].sum()
        yield pa.RecordBatch.from_arrays(list(map(pa.array, (np.arange(iters), met, held, total))), ["it", "met", "held", "total"])

    return rotate


def permutation_means(signals: DataFrame, labels: DataFrame, iters: int, seed: str = "shift") -> DataFrame:
    """Mean R per iteration when each ticker's signals are shifted around its own bars.

    signals(ticker, i, n) and labels(ticker, i, r), where every bar was labelled once. A ticker
    of over 600 bars shifts by 260 or more from both ends, a shorter one not at all. A ticker's
    signals and labels, at most one calendar each, are arrays of one row, and a shift rotates
    positions inside it: nothing is multiplied by iterations, and each task gives one row for each.
    """
    spots = signals.groupBy("ticker").agg(F.max("n").alias("n"), F.collect_list("i").alias("signals"))
    pair = F.sort_array(F.collect_list(F.struct("i", "r")))
    known = labels.groupBy("ticker").agg(pair.alias("labels")).select("ticker", C("labels.i").alias("at"), C("labels.r").alias("r"))
    rows = spots.join(known, "ticker").select("ticker", "n", "signals", "at", "r")
    sums = rows.mapInArrow(_rotated(iters, seed), "it bigint, met bigint, held bigint, total double")
    each = sums.groupBy("it").agg(F.sum("met").alias("n"), (F.try_divide(F.sum("total"), F.sum("held"))).alias("mean_r"))
    return each.filter(C("n") > 0)


def null_report(means: DataFrame, observed: DataFrame, n_configs: int) -> DataFrame:
    """Does the observed mean R clear the best of ``n_configs`` noise draws? One row.

    ``observed`` is one row with column ``observed``.
    """
    null = means.agg(
        F.count(F.lit(1)).alias("iters"),
        F.avg("mean_r").alias("mean"),
        F.when(F.count(F.lit(1)) > 2, F.stddev_samp("mean_r")).alias("sd"),
        F.percentile("mean_r", F.lit(0.95)).alias("p95"),
    )
    threshold = C("sd") * math.sqrt(2 * math.log(max(n_configs, 2)))
    both = null.withColumn("observed", observed.scalar())
    both = both.withColumns({"selection_threshold": threshold, "excess": C("observed") - C("mean")})
    return both.withColumns(
        {
            "clears": C("excess") > C("selection_threshold"),
            "timing_share": F.try_divide("excess", "observed"),
        }
    )
