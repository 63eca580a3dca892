"""SimHash near-duplicates found through tables of Hamming distances to reference fingerprints.

Texts never move: each is reduced to a 64-bit fingerprint where it is read. Every distinct fingerprint
gets a row of precomputed distances to fixed references (pivots), kept per block of bits. Two fingerprints
that differ in at most ``most`` bits agree on all but ``most`` blocks, so their distances to every
pivot coincide on at least two of ``most + 2`` blocks: joining on the distances of a pair of blocks
finds every link. Within a join group a pair is discarded when the largest difference of its whole
distances exceeds ``most`` (triangle inequality), and only survivors are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import fresh, kept, safe_unions
from tapeloom.llm.components import components

C = F.col
SEED = 42
PIVOTS = np.random.default_rng(2024).integers(0, 2**64, size=16, dtype=np.uint64)
GROUP = 2048  # fingerprints of a join group that are compared in one task
SMALL = 24  # groups up to this size are compared together, group size by group size


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text; zero for a text without words."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 15):
        part = [digest(line[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])]
        rows = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (bigint) for every row; null and empty texts have fingerprint zero."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    picked = docs.select(C("doc_id").cast("bigint").alias("doc_id"), C("text").cast("binary").alias("text"))
    return picked.mapInArrow(mark, "doc_id bigint, fp bigint")


def _masks(blocks: int) -> np.ndarray:
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    return np.array([sum(1 << k for k in range(a, b)) for a, b in zip(edges, edges[1:])], np.uint64)


def pivot_table(fps: np.ndarray, blocks: int) -> np.ndarray:
    """Distances of each fingerprint to each pivot, block by block: shape (fingerprints, blocks, pivots)."""
    apart = fps[:, None] ^ PIVOTS[None, :]
    return np.stack([np.bitwise_count(apart & m) for m in _masks(blocks)], axis=1)


def _keyed(blocks: int):
    """Rows of the pivot table under the key of each pair of blocks."""
    pairs = list(combinations(range(blocks), 2))
    base = np.uint64(64 // blocks + 3)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fps):
                continue
            table = pivot_table(fps, blocks)
            codes = np.zeros(table.shape[:2], np.uint64)
            for k in range(len(PIVOTS)):  # a number whose digits are the distances
                codes = codes * base + table[:, :, k]
            row = pa.array([x.tobytes() for x in table.sum(axis=1, dtype=np.uint8)], pa.binary())
            for number, (a, b) in enumerate(pairs):
                key = codes[:, a] * np.uint64(0x9E3779B97F4A7C15) + codes[:, b] * np.uint64(0xC2B2AE3D27D4EB4F)
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(number)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), row], ["key", "fp", "row"])

    return spread


def _near(fps: np.ndarray, rows: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which pairs survive the pivot bound and are truly near."""
    apart = np.abs(rows[a].astype(np.int16) - rows[b]).max(axis=-1)
    left = np.flatnonzero(apart <= most)
    return left[np.bitwise_count(fps[a[left]] ^ fps[b[left]]) <= most]


def _spanning(fps: np.ndarray, rows: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that span the components of one group, found by growing each from a seed."""
    wide, links = rows.astype(np.int16), []
    unseen = np.arange(len(fps))
    while len(unseen):
        frontier, unseen = [int(unseen[0])], unseen[1:]
        while frontier and len(unseen):
            at = frontier.pop()
            near = np.abs(wide[unseen] - wide[at]).max(axis=1) <= most
            near[near] = np.bitwise_count(fps[unseen[near]] ^ fps[at]) <= most
            links += [(at, int(k)) for k in unseen[near]]
            frontier += unseen[near].tolist()
            unseen = unseen[~near]
    return links


def _linked(most: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            fps = flat.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            rows = np.frombuffer(b"".join(flat.field("row").to_pylist()), np.uint8).reshape(-1, len(PIVOTS))
            sizes = np.asarray(lists.value_lengths())
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
            left, right = [], []
            for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
                i, j = np.triu_indices(size, 1)
                at = starts[sizes == size]
                a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                near = _near(fps, rows, a, b, most)
                left.append(fps[a[near]])
                right.append(fps[b[near]])
            for at, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
                own = fps[at : at + size]
                got = np.array(_spanning(own, rows[at : at + size], most), np.int64).reshape(-1, 2)
                left.append(own[got[:, 0]])
                right.append(own[got[:, 1]])
            ends = [np.concatenate([*x, np.zeros(0, np.uint64)]).view(np.int64) for x in (left, right)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

    return link


def near_links(distinct: DataFrame, most: int = 4) -> DataFrame:
    """a, b: links that connect every pair of fingerprints at ``most`` bits or fewer (spanning, not all pairs).

    ``distinct`` holds each fingerprint once in ``fp``. A key shared by many fingerprints is cut into
    pieces of about ``GROUP``, and each pair of pieces is its own task. The join is a merge join: Spark
    sizes ``rows`` by its input, without the rows that each fingerprint is spread to, and would broadcast it.
    """
    rows = distinct.select("fp").mapInArrow(_keyed(most + 2), "key bigint, fp bigint, row binary")
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(C("n") > 1)
    pieces = F.ceil(C("n") / GROUP).cast("int")
    mine = F.pmod(F.xxhash64("fp", "key"), C("pieces")).cast("int")
    dealt = (
        rows.join(held.hint("merge"), "key")
        .withColumn("pieces", pieces)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), C("pieces") - 1)))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", "row")
    )
    groups = dealt.groupBy("key", "i", "j").agg(F.collect_list(F.struct("fp", "row")).alias("members"))
    links = groups.filter(F.size("members") > 1).select("members").mapInArrow(_linked(most), "a bigint, b bigint")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _resolved(docs: DataFrame, words: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their fingerprints, and for each fingerprint its component's head and smallest doc_id.

    Tables of fingerprints are compressed files, smaller than the rows they hold, so none is broadcast;
    labels come with their hint.
    """
    safe_unions(docs.sparkSession)
    marked = kept(fingerprints(docs, words), "fingerprints")
    distinct = kept(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = components(near_links(distinct, most), "a", "b")
    heads = distinct.join(labels, C("fp") == C("node"), "left")
    heads = heads.select("fp", "first", F.coalesce("component", "fp").alias("head"))
    heads = kept(heads, "heads")
    least = heads.groupBy("head").agg(F.min("first").alias("component_id"))
    return marked, heads.join(least.hint("merge"), "head").select("fp", "head", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id linked to each document, itself included.

    One row per input row, repeated ids included. Null, empty and blank texts have fingerprint zero and
    are linked like any other. A null doc_id keeps its row and takes no part in the minimum, so
    component_id is null only where no linked row has an id. Other columns are ignored; an empty
    table gives an empty result.
    """
    marked, known = _resolved(docs, words, most)
    return marked.join(known.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """The documents, all columns, without near-duplicates: of each component the row with the smallest doc_id.

    Of rows that repeat that id one stays. Where a component has no id at all, one of its rows stays.
    """
    _, known = _resolved(docs, words, most)
    firsts = known.select(C("component_id").alias("doc_id")).distinct()
    named = docs.join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    mark = F.pandas_udf(lambda texts: texts.map(lambda t: np.uint64(fingerprint(t, words)).astype(np.int64)), "bigint")
    fp = fresh(docs, "fp")
    nameless = docs.filter(C("doc_id").isNull()).withColumn(fp, mark(C("text").cast("binary")))
    alone = known.filter(C("component_id").isNull() & (C("fp") == C("head"))).select(C("fp").alias(fp))
    rest = nameless.join(alone, fp, "left_semi").dropDuplicates([fp]).drop(fp)
    return named.select(*docs.columns).unionByName(rest.select(*docs.columns))
