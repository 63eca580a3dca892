"""Notices anywhere in a text: every template is found whole, also those of a single shingle."""

import pytest

from tapeloom.llm.licenses import TEMPLATES, scanned
from tapeloom.llm.queries import QUERIES

PLACES = {"start": "{} more words follow", "middle": "some words before. {} And more words follow", "line": "head\n{}\nbody text", "end": "words before {}"}


def test_query_finds_whole_templates_anywhere(spark, docs_of, tmp_path):
    rows = [(f"{place} {name}", form.format(text)) for place, form in PLACES.items() for name, text in TEMPLATES]
    docs_of([(k, text, "en", "a") for k, (_, text) in enumerate(rows)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.license): r.containment for r in QUERIES["op3_licenses"](spark, str(tmp_path)).collect()}
    assert got == {(k, name.split()[1]): pytest.approx(1.0) for k, (name, _) in enumerate(rows)}


def test_one_shingle_is_never_missed(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "concat('a', id, ' b', id, ' one two three four five c', id, ' d', id) AS text")
    known = spark.createDataFrame([("five", "one two three four five")], "license string, text string")
    assert scanned(docs, known).count() == 40_000
