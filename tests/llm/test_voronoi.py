import math
import random

from tapeloom.llm.voronoi import nearest

SCHEMA = "vec_id bigint, embedding array<float>, label int, cell int, score bigint"


def brute(rows, every, k):
    vectors = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i, q in vectors:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)}
    return out


def run(spark, rows, every=5, k=5):
    table = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA).repartition(3)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(table, every, k).collect()}
    assert got == brute(rows, every, k)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr("tapeloom.llm.voronoi.PIVOTS", 8)
    monkeypatch.setattr("tapeloom.llm.voronoi.PIECE", 20)
    monkeypatch.setattr("tapeloom.llm.voronoi.ASKING", 16)
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(k, [round((x + rng.gauss(0, 0.1)) * 64) / 64 for x in centres[k % 5]]) for k in range(300)]
    rows += [(1000 + k, rows[0][1]) for k in range(60)]  # a common vector
    run(spark, rows)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (5, None), (10, [1.0, None]), (15, [math.nan, 1.0]), (20, [math.inf]), (None, [1.0, 1.0]), (25, []), (30, [0.5]), (7, [1.0, 2.0])]
    run(spark, rows)
    run(spark, [(0, [1.0])])
    run(spark, [])
