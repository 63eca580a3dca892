"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever it meets the block size; each chunk gives one
character. A fingerprint holds the signatures at a block size and at its double, so that texts whose
block sizes are equal or neighbours can be compared, by the edit distance of their signatures.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import kept, parallelism, safe_unions

C = F.col
WINDOW = 7
LEAST = 3  # smallest block size; others are its doubles
LENGTH = 64  # characters of a signature, at most
BLOCK = 1 << 22  # bytes hashed at a time
DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
PART = 1 << 24  # characters of a range of documents
REPEATS = re.compile(r"(.)\1{3,}")
MULTIPLIERS = np.array([pow(0x01000193, k, 1 << 32) for k in range(WINDOW)], np.uint32)


def rolling(data: bytes, start: int, end: int) -> np.ndarray:
    """Mixed hash of the seven bytes that end at each place; places before the text count as zero."""
    got = np.zeros(end - start + WINDOW - 1, np.uint32)
    from_ = max(0, start - WINDOW + 1)
    got[from_ - start + WINDOW - 1 :] = np.frombuffer(data, np.uint8, end - from_, from_)
    h = got[WINDOW - 1 :].copy()
    for k in range(1, WINDOW):
        h += got[WINDOW - 1 - k : len(got) - k] * MULTIPLIERS[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


def signature(data: bytes, size: int, first: np.ndarray | None = None) -> str:
    """One character per chunk at a block size; the last of ``LENGTH`` covers all that follows."""
    sums: list[np.ndarray] = []
    carry, found = np.uint64(0), 0
    for at in range(0, len(data), BLOCK):
        end = min(len(data), at + BLOCK)
        h = first if first is not None and at == 0 else rolling(data, at, end)
        cuts = np.flatnonzero(h % np.uint32(size) == size - 1)[: max(0, LENGTH - 1 - found)] + 1
        parts = np.add.reduceat(h, np.concatenate(([0], cuts[cuts < len(h)])), dtype=np.uint64)
        if len(cuts) and cuts[-1] == len(h):
            parts = np.append(parts, np.uint64(0))
        parts[0] += carry
        carry, found = parts[-1], found + len(cuts)
        sums.append(parts[:-1])
    whole = np.concatenate([*sums, [carry]]) if len(data) else np.zeros(0, np.uint64)
    mixed = (whole * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
    return DIGITS[mixed.astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    """block size, signature at it and at its double, joined by colons."""
    data = text.encode()
    size = LEAST
    while size * LENGTH < len(data):
        size *= 2
    first = rolling(data, 0, min(len(data), BLOCK)) if data else None
    own = signature(data, size, first)
    double = signature(data, 2 * size, first)
    while size > LEAST and len(own) < LENGTH // 2:
        size //= 2
        own, double = signature(data, size, first), own
    return f"{size}:{own}:{double}"


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, all places of ``a`` at once."""
    masks: dict[str, int] = {}
    for k, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    a, b = REPEATS.sub(r"\1\1\1", a), REPEATS.sub(r"\1\1\1", b)
    if not a or not b:
        return 0.0
    run = min(WINDOW, max(2, min(len(a), len(b)) // 2), len(a), len(b))  # short signatures need a shorter common run
    if {a[k : k + run] for k in range(len(a) - run + 1)}.isdisjoint(b[k : k + run] for k in range(len(b) - run + 1)):
        return 0.0
    distance = len(a) + len(b) - 2 * common(a, b)  # insertions and deletions
    return 1.0 - distance / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1: edit-distance likeness at the block sizes both fingerprints hold; 0 if they share none."""
    if one == other:
        return 1.0
    (n, a, aa), (m, b, bb) = (x.split(":") for x in (one, other))
    n, m = int(n), int(m)
    if n == m:
        return max(_likeness(a, b), _likeness(aa, bb)) if len(a) > 1 or len(b) > 1 else _likeness(a, b)
    if n == 2 * m:
        return _likeness(a, bb)
    return _likeness(aa, b) if m == 2 * n else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
ROW = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def described(doc_id: int | None, text: str, own: str, following: str, next_own: str) -> tuple:
    new = edited(text, following)
    mark = fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own, mark, likeness(own, mark), likeness(own, next_own)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Describe each document of a sorted range by its follower; the range's first and last wait for their neighbours."""
    part = TaskContext.get().partitionId()
    held: tuple | None = None

    def out(rows: list[tuple], kind: str, text: str | None = None) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), KINDS)]
        extra = [pa.array([part] * len(rows), pa.int32()), pa.array([kind] * len(rows)), pa.array([text] * len(rows), pa.string())]
        return pa.RecordBatch.from_arrays([*columns, *extra], [*RESULT, "part", "kind", "text"])

    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            own = fingerprint(text)
            if held is None:
                yield out([(doc_id, len(text), None, own, None, None, None)], "first", text)
            else:
                rows.append(described(*held, text, own))
            held = (doc_id, text, own)
        if rows:
            yield out(rows, "done")
    if held is not None:
        yield out([(held[0], len(held[1]), None, held[2], None, None, None)], "last", held[1])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [described(d, t, f, nt, nf) for d, t, f, nt, nf in zip(*(c.to_pylist() for c in batch.columns))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], RESULT)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Documents follow each other by doc_id, nulls first, then by text; after the last comes the first, so
    a single document follows itself. Null texts count as empty; an empty text has an empty signature,
    which is like another empty one (1) and unlike any other (0). Repeated rows follow each other.
    Texts move once, into ranges of ids of about ``PART`` characters, and are read in order there;
    only each range's first and last document are compared across ranges, by a join on range numbers.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    safe_unions(spark)
    rows = docs.select(C("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(parallelism(spark), -(-chars // PART))
    ordered = rows.repartitionByRange(ranges, C("doc_id").asc_nulls_first()).sortWithinPartitions(C("doc_id").asc_nulls_first(), "text")
    walked = kept(ordered.mapInArrow(_walk, f"{ROW}, part int, kind string, text string"), "walked")
    firsts = walked.filter(C("kind") == "first").select(C("part").alias("after"), C("text").alias("next_text"), C("fingerprint").alias("next_fingerprint"))
    lasts = walked.filter(C("kind") == "last").select("part", "doc_id", "text", "fingerprint")
    # One row of numbers per range.
    after = firsts.select(C("after").alias("part")).select(
        "part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("after")
    )
    pairs = lasts.join(after, "part").join(firsts, "after").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    return walked.filter(C("kind") == "done").select(*RESULT).unionByName(pairs.mapInArrow(_meet, ROW))
