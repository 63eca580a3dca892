"""Exact top-k by integer inner product: a Voronoi join.

Vectors belong to the cell of their nearest pivot. A cell's summary holds its radius, its largest norm and a
few of its own vectors. The summaries' vectors give each query a score that its k-th best reaches at
least; a query is sent only to the cells whose bound (pivot score plus norm times radius) reaches that
score. Queries form groups of their own cell, and a piece of a cell is copied only to the groups that
ask for it. Pieces and groups are of bounded size and solved locally; each query's pieces are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import kept, safe_unions

C = F.col
PIVOTS = 2048  # at most; else the square root of the number of vectors, a sample of them
SHOWN = 8  # vectors of a cell that its summary holds
PIECE = 1024  # vectors of a cell that are solved together
ASKING = 4096  # queries of a group


def integers(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, vec: floor(scale * x) of each component as double; rows that take no part are gone."""
    x = C("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * float(scale)).cast("bigint"))
    picked = rows.select(C("vec_id").cast("bigint").alias("vec_id"), whole.alias("vec"), sound.alias("sound"))
    return picked.filter(C("vec_id").isNotNull() & C("vec").isNotNull() & C("sound")).select("vec_id", "vec").distinct()


def matrix(vectors, width: int | None = None) -> np.ndarray:
    """Rows of integers; shorter vectors are filled with zeros, which add nothing to a score."""
    lists = [np.asarray(v, np.int64) for v in vectors]
    width = max([width or 0, *map(len, lists)])
    out = np.zeros((len(lists), width), np.int64)
    for row, v in zip(out, lists):
        row[: len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; as doubles while they are exact, else as 64-bit integers, which wrap."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    top = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * width
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if top < 2**52 else a @ b.T


def _cells(pivots: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column(1).to_pylist(), pivots.shape[1]).astype(float)
            p = np.pad(pivots.astype(float), ((0, 0), (0, m.shape[1] - pivots.shape[1])))
            apart = (m * m).sum(1)[:, None] - 2 * (m @ p.T) + (p * p).sum(1)[None, :]
            cell = apart.argmin(1)
            distance = np.sqrt(((m - p[cell]) ** 2).sum(1))
            columns = [pa.array(cell.astype(np.int32)), pa.array(distance), pa.array(np.sqrt((m * m).sum(1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["vec_id", "vec", "cell", "distance", "norm"])

    return assign


class Summary:
    """What is known of all cells: pivots, radii, norms, and some vectors of each."""

    def __init__(self, cells: list, pivots: np.ndarray, shown: list) -> None:
        self.cell = np.array([c["cell"] for c in cells], np.int32)
        self.pivots, self.radius = pivots[self.cell], np.array([c["radius"] for c in cells])
        self.norm, self.pieces = np.array([c["norm"] for c in cells]), np.array([c["pieces"] for c in cells])
        self.ids = np.array([r["vec_id"] for r in shown], np.int64)
        self.vectors = matrix([r["vec"] for r in shown])

    def asked(self, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """Which cells may hold one of the k best of each query."""
        sure = products(queries, self.vectors).astype(float)
        sure[ids[:, None] == self.ids[None, :]] = -np.inf
        least = np.sort(sure, axis=1)[:, -k] if sure.shape[1] >= k else np.full(len(ids), -np.inf)
        norms = np.sqrt((queries.astype(float) ** 2).sum(1))
        near = products(queries, self.pivots).astype(float) + norms[:, None] * self.radius[None, :]
        bound = np.minimum(near, norms[:, None] * self.norm[None, :])
        return bound + 1e-6 * (1 + np.abs(bound)) >= least[:, None]


def _sent(summary: Summary, k: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            asked = summary.asked(ids, matrix(batch.column(1).to_pylist()), k)
            at, cell = np.nonzero(asked)
            pieces = summary.pieces[cell]
            rows, cells = np.repeat(at, pieces), np.repeat(summary.cell[cell], pieces)
            piece = np.concatenate([np.arange(n) for n in pieces] or [np.zeros(0, int)]).astype(np.int32)
            for a in range(0, len(rows), 20_000):
                part = slice(a, a + 20_000)
                taken = batch.take(pa.array(rows[part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[part]), pa.array(piece[part]), *taken.columns], ["cell", "piece", "vec_id", "vec", "turn"]
                )

    return send


def best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k highest scores without the query's own row, ties to the smaller id."""
    open_ = ids != own
    ids, scores = ids[open_], scores[open_]
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= cut], scores[scores >= cut]
    order = np.lexsort((ids, -scores))[:k]
    return [(int(ids[n]), int(scores[n])) for n in order]


def _solved(k: int):
    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(data):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids, vectors = data["vec_id"].to_numpy(np.int64), matrix(data["vec"])
        rows = []
        for a in range(0, len(queries), 512):
            part = queries.iloc[a : a + 512]
            for own, scores in zip(part["vec_id"], products(matrix(part["vec"]), vectors)):
                rows += [(own, *hit) for hit in best(ids, scores, own, k)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return solve


def dealt(counts: dict[int, int], pivots: np.ndarray) -> tuple[dict[int, int], dict[int, int]]:
    """Per cell its first group and in how many its queries are cut: neighbours along the pivots' main direction share one."""
    away = pivots.astype(float) - pivots.mean(axis=0)
    along = away @ np.linalg.svd(away, full_matrices=False)[2][0]
    first, parts, group, held = {}, {}, 0, 0
    for cell in sorted(counts, key=lambda c: (along[c], c)):
        if held and held + counts[cell] > ASKING:
            group, held = group + 1, 0
        first[cell], parts[cell] = group, -(-counts[cell] // ASKING)
        held += counts[cell]
        if parts[cell] > 1:
            group, held = group + parts[cell], 0
    return first, parts


def _numbers(found: dict[int, int]) -> Column:
    """A map of cells to whole numbers, as a literal; cells are as many as pivots at most."""
    return F.map_from_arrays(F.lit([int(c) for c in found]), F.lit([int(n) for n in found.values()])) if found else F.lit(None).cast("map<int,int>")


def nearest(rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by ``every`` its ``k`` highest scores among all others.

    Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part;
    rows that repeat id and vector count once, and rows that share an id are never each other's result.
    Shorter vectors, empty ones included, score as if filled with zeros. Scores that exceed 64 bits
    wrap. Equal scores go to the smaller vec_id. Other columns are ignored; an empty table gives none.
    """
    spark = rows.sparkSession
    safe_unions(spark)
    vectors = kept(integers(rows), "vectors")
    count = max(1, min(PIVOTS, math.isqrt(vectors.count())))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()
    pivots = np.unique(matrix([r["vec"] for r in sample]), axis=0) if sample else np.zeros((1, 1), np.int64)
    placed = "vec_id bigint, vec array<bigint>, cell int, distance double, norm double"
    cells = kept(vectors.mapInArrow(_cells(pivots), placed), "cells")
    # Of equal vectors only the k + 1 smallest ids can be results, one of them perhaps the query's own.
    equal = Window.partitionBy("vec").orderBy("vec_id")
    data = kept(cells.withColumn("nth", F.row_number().over(equal)).filter(C("nth") <= k + 1).drop("nth"), "data")
    sizes = data.groupBy("cell").agg(
        F.max("distance").alias("radius"), F.max("norm").alias("norm"), F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces")
    )
    inner = Window.partitionBy("cell").orderBy("distance", "vec_id")
    shown = data.withColumn("nth", F.row_number().over(inner)).filter(C("nth") <= SHOWN)
    # At most PIVOTS cells and PIVOTS * SHOWN vectors reach the driver.
    summary = Summary(sizes.collect(), pivots, shown.select("vec_id", "vec").collect())
    queries = cells.filter(C("vec_id") % every == 0)
    # One count a cell reaches the driver, which deals cells to groups of queries.
    first, parts = dealt({r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}, pivots)
    own = F.pmod(F.xxhash64("vec_id"), _numbers(parts)[C("cell")]).cast("int")
    wanted = "cell int, piece int, vec_id bigint, vec array<bigint>, turn int"
    asking = queries.select("vec_id", "vec", (_numbers(first)[C("cell")] + own).cast("int").alias("turn"))
    asked = kept(asking.mapInArrow(_sent(summary, k), wanted), "asked")
    pieces = _numbers(dict(zip(summary.cell.tolist(), summary.pieces.tolist())))
    placed = data.select("cell", F.pmod(F.xxhash64("vec_id", F.lit("piece")), pieces[C("cell")]).cast("int").alias("piece"), "vec_id", "vec")
    # A turn of its own, so that the two sides below share no column.
    needed = asked.select("cell", "piece", (C("turn") + 0).alias("turn")).distinct()
    held = placed.join(needed, ["cell", "piece"])
    keys = ["cell", "piece", "turn"]
    hits = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_solved(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(C("score").desc(), "vec_id")
    hits = hits.distinct().withColumn("rank", F.row_number().over(order)).filter(C("rank") <= k)
    return hits.select("query_id", "rank", "vec_id", "score")


TOP_SQL = """
WITH v AS (
    SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
    SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.vec::DOUBLE[], d.vec::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v d ON q.vec_id <> d.vec_id
    WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
