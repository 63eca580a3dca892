import random

import pytest

from tapeloom.llm.ftrl import accepted, features, fit, quality

from .conftest import EDGES

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture
def taught(spark, docs_of):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioustrn") for _ in range(5)) for _ in range(400)]
    rows = []
    for k in range(400):
        bad = k % 4 == 0
        rows.append((k, " ".join(rng.choice(words) + ("!!" if bad else "") for _ in range(40)), "en", "a"))
    labels = [(k, int(k % 4 != 0), 0) for k in range(0, 400)]
    return docs_of(rows), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy(taught):
    docs, labels = taught
    got = quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_are_not_learned(spark, taught):
    docs, labels = taught
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert (fit(docs, labels) == fit(docs, flipped)).all()


def test_only_the_text_counts(taught):
    docs, labels = taught
    other = docs.selectExpr("doc_id", "text", "'zz' AS lang", "'yy' AS source", "n_chars")
    a, b = ({r.doc_id: r.score for r in quality(d, labels).collect()} for d in (docs, other))
    assert a == b


def test_edges(spark, taught, edges, nothing):
    _, labels = taught
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (5, 1, 0), (5, 0, 0)], LABELS))
    got = quality(edges, odd).collect()
    assert len(got) == len(EDGES) and all(r.held_out is not None and 0 <= r.score <= 1 for r in got)
    assert quality(nothing, labels).count() == 0
    none = quality(edges, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert accepted(edges, labels.limit(0)).columns == edges.columns
    assert len(features(b"")[0]) == len(features(None)[0]) == 0
