import pytest
from pyspark.sql import functions as F

from tapeloom.llm.mixing import AXES, calibrated, mixed, raked, sampled

from .conftest import EDGES


def test_raking_meets_its_targets(spark):
    cells = [(s, l, t, 1 + 7 * i % 5 + 3 * j + k) for i, s in enumerate("abc") for j, l in enumerate("xy") for k, t in enumerate("pq")]
    cells = spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint")
    wanted = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.1, "q": 0.9}}
    targets = {axis: spark.createDataFrame(list(w.items()), f"{axis} string, share double") for axis, w in wanted.items()}
    got = raked(cells, targets, rounds=8)
    for axis, w in wanted.items():
        for r in got.groupBy(axis).agg(F.sum("weight").alias("w")).collect():
            assert r.w == pytest.approx(w[r[axis]], abs=1e-6)


def test_calibration_spends_the_budget(spark):
    cells = spark.createDataFrame([("a", 10, 0.9), ("b", 1000, 0.1), ("c", 0, 0.0)], "source string, tokens bigint, weight double")
    got = {r.source: r for r in calibrated(cells, 0.5).collect()}
    assert got["a"].probability == 1 and got["c"].probability == 0
    assert sum(r.probability * r.tokens for r in got.values()) == pytest.approx(505)


def test_edges(edges, nothing):
    got = mixed(edges, rounds=2).collect()
    assert len(got) == len(EDGES) and all(0 <= r.probability <= 1 for r in got)
    assert {r.source for r in got if r.source == "(none)"} == {"(none)"}
    same = {}
    for r in got:
        assert same.setdefault((r.doc_id, *[r[a] for a in AXES]), r.selected) == r.selected
    kept = sampled(edges, rounds=2)
    assert kept.columns == edges.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.selected)
    assert mixed(nothing, rounds=1).count() == 0 and sampled(nothing, rounds=1).count() == 0
