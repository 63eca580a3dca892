"""Exact ordered and quantile aggregates over groups too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import kept

C = F.col


def _fold(parts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Join neighbouring pieces of a running sum into one piece per key.

    A piece knows its total, the highest and lowest running sum inside it, and its deepest fall.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    p = parts.withColumn("base_", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    p = p.withColumns({"top_": C("base_") + C("high"), "low_": C("base_") + C("low")})
    p = p.withColumn("fall_", F.least("fall", C("low_") - F.max("top_").over(before)))
    return p.groupBy(*keys).agg(
        F.sum("total").alias("total"),
        F.max("top_").alias("high"),
        F.min("low_").alias("low"),
        F.min("fall_").alias("fall"),
    )


def deepest_fall(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Deepest fall of the running sum of ``value`` below its running maximum, per key.

    Rows are range-partitioned by key and order, so a key holding most rows is spread over many
    tasks; each task's piece is summed up first and the few pieces of a key are joined after.
    """
    pieces = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.select(*keys, *order, value.cast("double").alias("total")).repartitionByRange(pieces, *keys, *order)
    one = spread.withColumns(
        {"piece_": F.spark_partition_id(), "high": C("total"), "low": C("total"), "fall": F.lit(0.0)}
    )
    return _fold(_fold(one, [*keys, "piece_"], order), keys, ["piece_"]).select(
        *keys, "total", C("fall").alias("deepest")
    )


def positions(ordered: DataFrame, name: str) -> DataFrame:
    """Adds each row's place, from 1, in a sorted table; only one count per sorted partition meets in one task."""
    at = F.monotonically_increasing_id()  # partition number and place in it
    placed = kept(ordered.withColumn(name, at), "placed").withColumn("part_", F.shiftright(name, 33))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part_").agg(F.count(F.lit(1)).alias("held_"))
    starts = starts.select("part_", F.coalesce(F.sum("held_").over(before), F.lit(0)).alias("start_"))
    place = C("start_") + C(name).bitwiseAND((1 << 33) - 1) + 1
    return placed.join(starts, "part_").withColumn(name, place.cast("bigint")).drop("part_", "start_")


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Exact interpolated percentiles per key: columns keys, share, quantile.

    Equal values are counted first. Distinct values are range-partitioned by key and value, so that a key
    holding most of them is spread; a value's rank is what lies in the ranges before plus what lies
    before it in its own. Nulls are left out, and a key without values has no row.
    """
    known = rows.filter(C(value).isNotNull())
    tied = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties_"))
    pieces = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = tied.repartitionByRange(pieces, *keys, value).withColumn("piece_", F.spark_partition_id())
    ranged = kept(ranged, "ranged")
    held = ranged.groupBy(*keys, "piece_").agg(F.sum("ties_").alias("held_"))
    # One row per key and range that holds the key.
    each = Window.partitionBy(*keys)
    held = held.select(
        *keys,
        "piece_",
        F.sum("held_").over(each).alias("n_"),
        F.coalesce(F.sum("held_").over(each.orderBy("piece_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"),
    )
    inside = Window.partitionBy(*keys, "piece_").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "piece_"]]
    ranked = ranged.withColumn("within_", F.sum("ties_").over(inside)).alias("a").join(held.alias("b"), same).select("a.*", "n_", "before_")
    upto = C("before_") + C("within_")
    place = (C("n_") - 1) * C("share")
    # One row per value and share that it can be an end of: ``shares`` is a short fixed list.
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    near = ranked.select(*keys, value, "ties_", "n_", upto.alias("upto_"), wanted)
    near = near.filter((C("upto_") > F.floor(place)) & (C("upto_") - C("ties_") <= F.ceil(place)))
    ends = near.groupBy(*keys, "share").agg(
        F.first("n_").alias("n_"), F.min(value).alias("v0"), F.min(F.when(C("upto_") > F.ceil(place), C(value))).alias("v1")
    )
    return ends.select(*keys, "share", (C("v0") + (C("v1") - C("v0")) * (place - F.floor(place))).alias("quantile"))


def exact_median(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return exact_percentiles(rows, keys, value, [0.5]).select(*keys, C("quantile").alias(name))
