import corpus_pipeline
import pyarrow as pa
import pytest

import __spark_entry__
from tapeloom.llm.bpe import vocabulary
from tapeloom.llm.mixing import AXES, mixed
from tapeloom.llm.simhash import fingerprint

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.kept(stage(spark, out[-1], SMALL), name))
    return out


def test_stages_keep_columns_and_rows(spark, stages):
    docs, judged, deduplicated, mix, encoded = stages
    for table in (judged, deduplicated, mix):
        assert table.columns == docs.columns
        assert table.exceptAll(docs).count() == 0
    assert encoded.count() == mix.count() <= deduplicated.count() <= judged.count() <= docs.count()


def test_good_documents_stay(spark, stages):
    good = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").select("doc_id")
    assert good.join(stages[1], "doc_id", "left_anti").count() == 0


def test_one_of_each_group_stays(stages):
    rows = {r.doc_id: fingerprint(r.text.encode()) for r in stages[1].collect()}
    groups = {i: i for i in rows}
    for i in sorted(rows):
        for j in sorted(rows):
            if i < j and (rows[i] ^ rows[j]).bit_count() <= 4:
                a, b = sorted((groups[i], groups[j]))
                groups = {k: a if g == b else g for k, g in groups.items()}
    assert {r.doc_id for r in stages[2].collect()} == set(groups.values())


def test_mix_and_tokens(stages):
    drawn = {r.doc_id for r in mixed(stages[2]).filter("selected").collect()}
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    assert set(texts) == drawn and len(AXES) == 3
    v = vocabulary(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: r.n_tokens for r in stages[4].collect()} == {i: next(v.encode(pa.array([t])))[1] for i, t in texts.items()}


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op") and k[2].isdigit()}
    assert "pipeline" in names
