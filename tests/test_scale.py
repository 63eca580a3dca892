import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapeloom.operators import scale, signals


def test_percentiles_are_exact_with_and_without_slices(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=30_000), np.full(12_000, 0.25)])
    pdf = pd.DataFrame({"k": "hot", "v": values})
    pdf = pd.concat([pdf, pd.DataFrame({"k": "small", "v": [1.0, 2.0, 4.0, 8.0]})])
    shares = [0.0, 0.1, 0.5, 0.975, 1.0]
    got = scale.exact_percentiles(spark.createDataFrame(pdf), ["k"], "v", shares).toPandas()
    for k, g in got.groupby("k"):
        want = np.quantile(pdf[pdf.k == k].v, shares)
        np.testing.assert_allclose(g.sort_values("share")["quantile"], want, rtol=1e-12)


def test_deepest_fall_of_a_hot_key(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": ["hot"] * 5000 + ["cold"] * 7, "i": list(range(5000)) + list(range(7)), "r": rng.normal(size=5007)})
    shuffled = pdf.sample(frac=1, random_state=1)
    got = scale.deepest_fall(spark.createDataFrame(shuffled), ["k"], ["i"], F.col("r")).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        eq = g.sort_values("i").r.cumsum()
        assert np.isclose(got.loc[k, "deepest"], (eq - eq.cummax()).min())
        assert np.isclose(got.loc[k, "total"], eq.iloc[-1])


def test_average_rank_with_ties_matches_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"d": rng.integers(0, 3, 4000), "name": range(4000), "v": np.round(rng.normal(size=4000), 1)})
    pdf.loc[pdf.index % 3 == 0, "v"] = 0.5  # one value held by a third of the rows
    pdf.loc[:5, "v"] = np.nan
    rows = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = signals.average_rank(rows, "d", "v", min_names=10, buckets=16).toPandas().set_index("name")["rank"]
    want = pdf.groupby("d").v.rank(pct=True)
    want.index = pdf.name
    np.testing.assert_allclose(got.sort_index(), want.dropna().sort_index(), rtol=1e-12)


def test_a_scope_leaves_no_folder(spark):
    import os

    from tapeloom import session

    outside = session.shared_folder(spark, "outside")
    spark.range(1).write.mode("overwrite").parquet(outside)
    with session.scratch(spark):
        rows = scale.exact_percentiles(spark.range(50).withColumn("k", F.lit(1)), ["k"], "id", [0.5]).collect()
        made = list(session.SCOPES[-1])
        assert made and all(map(os.path.exists, made))
    assert [x.quantile for x in rows] == [24.5]
    assert not any(map(os.path.exists, made)) and os.path.exists(outside)


def test_one_key_with_nearly_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in rng.integers(0, 300, 5000)] + [(None, 2.0), ("one", 7.0), ("none", None)]
    table = spark.createDataFrame(rows, "k string, v double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(x.k, x.share): x.quantile for x in scale.exact_percentiles(table, ["k"], "v", [0.0, 0.2, 0.75, 1.0]).collect()}
        ranked = scale.positions(table.orderBy("k", "v"), "place").orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hot = [v for k, v in rows if k == "hot"]
    want = {("hot", s): float(np.quantile(hot, s)) for s in (0.0, 0.2, 0.75, 1.0)}
    want |= {(k, s): v for k, v in ((None, 2.0), ("one", 7.0)) for s in (0.0, 0.2, 0.75, 1.0)}
    assert got == want
    assert [x.place for x in ranked] == list(range(1, len(rows) + 1))
