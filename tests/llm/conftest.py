import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp bigint, key string, batch bigint, row bigint"
#: Null and repeated ids, null, empty, blank and long texts, ties, and columns named like inner ones.
EDGES = [
    (5, "One two three four five six seven eight.", "en", "a"),
    (5, "One two three four five six seven eight.", "en", "a"),
    (3, "one TWO three four five six seven eight.", None, None),
    (None, "one two three four five six seven eight.", "en", "a"),
    (None, None, None, None),
    (7, None, "de", "b"),
    (8, "", "de", "b"),
    (9, " \t\n", "fr", "c"),
    (10, "word", "fr", "c"),
    (11, "long tail of words " * 3000, "es", "a"),
    (12, "x" * 70_000, "es", "a"),
    (13, "ünï cödé 日本語 😀 <|endoftext|> it's 42!", "de", None),
]


@pytest.fixture(autouse=True)
def _workers(spark):
    from tapeloom.llm.common import find_package, safe_unions

    find_package(spark)
    safe_unions(spark)


@pytest.fixture
def docs_of(spark):
    def make(rows):
        return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, 1, "k", 2, 3) for r in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture
def edges(docs_of):
    return docs_of(EDGES)


@pytest.fixture
def nothing(docs_of):
    return docs_of([])
