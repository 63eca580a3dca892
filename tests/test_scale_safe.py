"""What must not grow with one hot key, date or ticker."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import barriers as ba
from tapeloom.operators import resample as rs
from tapeloom.operators import signals as sg
from tapeloom.session import clustered, scratch

C = F.col


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def folded(spans, start=0):
    kept, free = set(), start
    for i, held in sorted(spans):
        if i >= free:
            kept.add(i)
            free = i + held + 1
    return kept


@pytest.mark.parametrize("keys", [["side"], ["side", "ticker"], []])
def test_non_overlap_is_the_fold(spark, keys):
    rng = random.Random(len(keys))
    rows = [(rng.choice("LLLLLS") if k % 9 else None, f"T{rng.randint(0, 30)}", rng.randint(0, 400), rng.randint(0, 12)) for k in range(3000)]
    df = spark.createDataFrame(rows, "side string, ticker string, i int, held bigint").repartition(5)
    groups = {}
    for side, ticker, i, held in rows:
        groups.setdefault(tuple({"side": side, "ticker": ticker}[k] for k in keys), []).append((i, held))
    kept = {g: folded(spans, 5) for g, spans in groups.items()}
    want = sorted(map(str, [r for r in rows if r[2] in kept[tuple({"side": r[0], "ticker": r[1]}[k] for k in keys)]]))
    assert sorted(map(str, map(tuple, ba.non_overlap(df, keys, start=5).collect()))) == want


def test_rotated_null_is_the_join(spark):
    rng = np.random.default_rng(8)
    signals, labels = [], []
    for t, n in (("A", 900), ("B", 620), ("C", 300)):
        signals += [(t, int(i), n) for i in rng.integers(0, n, 40)]
        labels += [(t, i, float(rng.normal()) if rng.random() > 0.1 else None) for i in range(n) if rng.random() > 0.2]
    s = spark.createDataFrame(signals, "ticker string, i bigint, n bigint").repartition(3)
    lab = spark.createDataFrame(labels, "ticker string, i bigint, r double")
    got = {r.it: (r.n, r.mean_r) for r in rs.permutation_means(s, lab, 30).collect()}
    shift = F.when(C("n") > 600, 260 + rs.draw("shift", C("it"), C("ticker")) % F.greatest(C("n") - 520, F.lit(1))).otherwise(0)
    moved = s.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(29)))).select("it", "ticker", ((C("i") + shift) % C("n")).alias("i"))
    want = moved.join(lab, ["ticker", "i"]).groupBy("it").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_r"))
    assert got == {r.it: (r.n, pytest.approx(r.mean_r)) for r in want.collect()}


def test_a_date_with_nearly_all_rows_is_ranked_in_many_tasks(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if k % 50 else "cold", float(v) if k % 17 else None) for k, v in enumerate(rng.integers(0, 3000, 20_000))]
    df = spark.createDataFrame(rows, "day string, value double").repartition(4)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = sg.average_rank(df, "day", "value", min_names=1)
        assert "[day#" in plan_of(ranked) and "salt#" in plan_of(ranked)
        got = sorted((r.day, r.value, round(r["rank"], 9)) for r in ranked.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept["spark.sql.autoBroadcastJoinThreshold"])
    pdf = df.toPandas().dropna()
    pdf["rank"] = pdf.groupby("day")["value"].rank(pct=True)
    assert got == sorted((d, v, round(x, 9)) for d, v, x in pdf.itertuples(index=False))


def test_bucketed_bars_need_no_shuffle(spark):
    from pyspark.sql import Window

    bars = spark.range(4000).select((C("id") % 40).cast("string").alias("ticker"), (C("id") / 40).cast("bigint").alias("i"), C("id").alias("x"))
    with scratch(spark):
        kept = clustered(bars, "ticker", "i")
        name = kept.inputFiles()[0].split("/")[-2]
        each = Window.partitionBy("ticker").orderBy("i")
        walked = kept.withColumn("sum", F.sum("x").over(each)).groupBy("ticker").agg(F.max("sum").alias("most"))
        both = walked.join(clustered(bars, "ticker", "i").groupBy("ticker").agg(F.sum("x").alias("total")), "ticker")
        assert "Exchange" not in plan_of(walked)
        kept_at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            assert "SortMergeJoin" in plan_of(both.select("*")) and "Exchange" not in plan_of(both.select("*"))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept_at)
        assert both.filter(C("most") != C("total")).count() == 0 and both.count() == 40
    assert not spark.catalog.tableExists("tapeloom_" + name.replace("-", "_"))


def test_legs_hold_the_variants_that_fire(spark):
    grid = sg.variant_grid()
    legs = sg.shared_legs(grid)
    assert len(grid) == 36 and len(legs) == 12 and sum(map(len, legs.values())) == 36
    rows = [(leg, mask, leg) for leg in legs for mask in (1, 3, 7)]
    got = sg.of_variants(spark.createDataFrame(rows, "variant string, fired bigint, leg string"), grid).groupBy("variant").count().collect()
    times = {v.name: 3 - k for same in legs.values() for k, v in enumerate(same)}
    assert {r.variant: r["count"] for r in got} == times
