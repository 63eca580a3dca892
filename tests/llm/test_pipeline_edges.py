"""The whole pipeline on edge tables."""

import corpus_pipeline
import pytest

LABELS = "doc_id bigint, quality int, toxic int, text string"


def write(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("labels", [[], [(5, 1, 0, "x"), (3, 0, 1, None), (None, 1, 0, ""), (5, 0, 0, "y")]])
def test_nulls_repeats_and_clashing_columns(spark, edges, tmp_path, labels):
    folder = write(spark, tmp_path, edges, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.kept(stage(spark, docs, folder), name)
        assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
        docs = out
    assert 0 < docs.count() <= 9  # two rows of one id, blank texts and near copies are one each
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == docs.count()


def test_empty_tables(spark, nothing, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, nothing, [])).count() == 0
