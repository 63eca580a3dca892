"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import fold_of, fresh

C = F.col
BITS = 18
SAMPLE = 8192  # labelled rows that the model is fitted on, at most
TOKEN = re.compile(rb"[\w\x80-\xff]+|[^\w\s\x80-\xff]+")


def features(text: bytes | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, runs of signs and pairs of neighbours of a text, and values of unit length."""
    tokens = TOKEN.findall(text or b"")
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(t, 7) for t in tokens], np.uint64)
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    shift = np.uint64(64 - bits)
    buckets = np.concatenate((words, pairs * np.uint64(0xD6E8FEB86659FD93))) >> shift
    found, counts = np.unique(buckets.astype(np.int64), return_counts=True)
    values = np.log1p(counts)
    return found, values / np.sqrt((values * values).sum()) if len(values) else values


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss, with an unregularised bias in the last place."""

    def __init__(self, bits: int, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.bias = 1 << bits

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, self.bias), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, folds: int = 5, bits: int = BITS, epochs: int = 3) -> np.ndarray:
    """Weights (the last is the bias) fitted on at most ``sample`` labelled rows outside the held-out fold.

    The rows are those whose ids hash lowest, so the choice does not depend on how the tables are cut;
    they are learned from in one task, in that order, several times. Rows with a null id, label or
    text are not learned from; of rows that repeat an id one is. Without any labelled row every
    weight is zero, which scores 0.5.
    """
    known = (
        labels.filter(C("doc_id").isNotNull() & C(label).isin(0, 1) & (fold_of("doc_id", folds) != 0))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y_"))
        .withColumn("at_", F.xxhash64("doc_id"))
        .orderBy("at_", "doc_id")
        .limit(sample)
    )
    # `sample` rows of three numbers at most: small enough for every executor, whatever the input.
    rows = (
        docs.filter(C("text").isNotNull())
        .select("doc_id", C("text").cast("binary").alias("text_"))
        .join(F.broadcast(known), "doc_id")
        .dropDuplicates(["doc_id"])
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(bits), []
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                at, x = features(text.as_py(), bits)
                seen.append((at.astype(np.int32), x.astype(np.float32), y.as_py()))
        for _ in range(epochs):
            for at, x, y in seen:
                model.learn(at.astype(np.int64), x.astype(float), y)
        w = model.weights(np.arange(len(model.z)))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["at", "w"])

    ordered = rows.orderBy("at_", "doc_id").limit(sample)
    found = ordered.select("text_", "y_").mapInArrow(learn, "at bigint, w double").toPandas()
    weights = np.zeros((1 << bits) + 1, np.float32)
    weights[found["at"].to_numpy()] = found["w"].to_numpy()
    return weights


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text") -> Column:
    """Probability of label 1 for each text; null and empty texts score by the bias alone."""
    bits = (len(weights) - 1).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits + 1 floats

    def score(texts: pd.Series) -> pd.Series:
        w = sent.value
        bias = float(w[-1])

        def one(t: bytes | None) -> float:
            at, x = features(t, bits)
            return 1 / (1 + np.exp(-np.clip(float(w[at] @ x) + bias, -35, 35)))

        return texts.map(one).astype(float)

    return F.pandas_udf(score, "double")(C(text).cast("binary"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Learns as ``fit`` does; scores come from the text alone. Null texts score like empty ones, a null
    doc_id counts as the empty text in the choice of the fold. Repeated rows each get a row.
    """
    score = scored(docs, fit(docs, labels, folds=folds))
    rows = docs.select("doc_id", (fold_of("doc_id", folds) == 0).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (C("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject."""
    score = fresh(docs, "score")
    return docs.withColumn(score, scored(docs, fit(docs, labels))).filter(C(score) >= threshold).drop(score)
