"""First touches through block extremes against a walk over every bar, and what the plan reads."""

import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators.touch import Touch, extremes, first_touches, next_where, sizes

C = F.col


def tables(spark, seed, horizon):
    rng = random.Random(seed)
    bars, paths = [], []
    for t, n in (("A", 3 * horizon + 7), ("B", 5), ("C", horizon)):
        level = 100.0
        for i in range(n):
            level += rng.gauss(0, 1)
            opened = level + rng.gauss(0, 2)  # opens may lie outside of low and high
            bars.append((t, i, opened, level + rng.random(), level - rng.random()))
        for k in range(40):
            start = rng.randrange(n)
            end = min(n - 1, start + rng.randint(0, horizon - 1))
            paths.append((t, k, start, end, level + rng.gauss(0, 6) if k % 7 else None, level + rng.gauss(0, 6)))
    b = spark.createDataFrame(bars, "ticker string, i bigint, open double, high double, low double")
    p = spark.createDataFrame(paths, "ticker string, k bigint, from_ bigint, upto_ bigint, x double, y double")
    return bars, paths, b, p


@pytest.mark.parametrize("horizon", [3, 30, 504])
def test_same_as_walking_every_bar(spark, horizon):
    bars, paths, b, p = tables(spark, horizon, horizon)
    at = {(t, i): (o, h, low) for t, i, o, h, low in bars}
    touches = {
        "down": Touch(low=C("x"), low_open=C("x")),
        "up": Touch(high=C("y"), high_open=C("x"), entry_open=False),
        "gap": Touch(low_open=C("y"), entry_open=False),
        "any": Touch(low=C("x"), high=C("y")),
    }
    tests = {
        "down": lambda o, h, low, x, y, first: x is not None and (low <= x or o <= x),
        "up": lambda o, h, low, x, y, first: h >= y or (not first and x is not None and o >= x),
        "gap": lambda o, h, low, x, y, first: not first and o <= y,
        "any": lambda o, h, low, x, y, first: (x is not None and low <= x) or h >= y,
    }
    got = {(r.ticker, r.k): tuple(r[n] for n in touches) for r in first_touches(p, b, touches, ["ticker", "k"], horizon).collect()}
    want = {
        (t, k): tuple(next((i for i in range(start, end + 1) if tests[n](*at[t, i], x, y, i == start)), None) for n in touches)
        for t, k, start, end, x, y in paths
    }
    assert got == want
    found = {(r.ticker, r.k): (r.top, r.bottom) for r in extremes(p, b, ["ticker", "k"], horizon).collect()}
    assert found == {
        (t, k): (max(at[t, i][1] for i in range(start, end + 1)), min(at[t, i][2] for i in range(start, end + 1)))
        for t, k, start, end, _, _ in paths
    }


def test_long_paths_read_few_rows(spark):
    """About 23 blocks and two opened blocks a path, instead of 504 bars."""
    size, span = sizes(504)
    assert (size, span) == (22, 24)
    n = 2000
    bars = spark.range(n).select(F.lit("A").alias("ticker"), C("id").alias("i"), *[F.lit(v).alias(c) for c, v in (("open", 10.0), ("high", 11.0), ("low", 9.0))])
    spiked = bars.withColumn("high", F.when(C("i") % 400 == 399, 20.0).otherwise(C("high")))
    paths = spark.range(1000).select(F.lit("A").alias("ticker"), C("id").alias("k"), C("id").alias("from_"), (C("id") + 503).alias("upto_"), F.lit(15.0).alias("x"))
    got = first_touches(paths, spiked, {"up": Touch(high=C("x"))}, ["ticker", "k"], 504)
    rows = {r.k: r.up for r in got.collect()}
    assert all(rows[k] == k + (399 - k) % 400 for k in range(1000))
    met = [
        int(node.metrics().apply("numOutputRows").value())
        for node in joins(got._jdf.queryExecution().executedPlan())
    ]
    assert met and max(met) <= 1000 * 2 * size + 1000


def joins(plan):
    """Join nodes of a plan that ran, through adaptive stages."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return joins(plan.executedPlan())
    if "QueryStage" in name:
        return joins(plan.plan())
    out = [plan] if "Join" in name and plan.metrics().contains("numOutputRows") else []
    children = plan.children()
    for k in range(children.size()):
        out += joins(children.apply(k))
    return out


def test_next_event(spark):
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate([0, 1, 0, None, 1, 0])], "ticker string, i bigint, v int")
    got = {r.i: (r.a, r.b) for r in df.select("i", next_where(C("v") == 1).alias("a"), next_where(C("v") == 1, own=True).alias("b")).collect()}
    assert got == {0: (1, 1), 1: (4, 1), 2: (4, 4), 3: (4, 4), 4: (None, 4), 5: (None, None)}
