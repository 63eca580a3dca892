"""Spelling variants by reduced-alphabet generation.

Letters are hashed to ``SYMBOLS`` symbols, which makes words reduced words; words one edit apart have
reduced words at most one edit apart. Every distinct reduced word's whole one-edit neighbourhood is
generated, joined with the reduced vocabulary, and the words behind each pair are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import kept, safe_unions
from tapeloom.llm.marked import Marked, marked, mixed

C = F.col

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the reduced alphabet.
SYMBOLS = 16
#: Base of the polynomials that reduced words are coded as, and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Neighbours made at once inside a task.
AT_ONCE = 1 << 20


def vocabulary(docs: DataFrame, letters: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """word, n: runs of letters, lower-cased and one in ``every`` with a letter deleted, of ``letters`` or more found ``least`` times."""
    text = F.translate(F.coalesce(C("text").cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(C("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(text, F.lit(r"[a-zÀ-ÿ]+"), F.lit(0))).alias("run"),
    ).filter(F.length("run") >= letters)  # deleting never makes a run longer
    h = F.crc32(F.concat_ws(":", "doc", "run"))
    cut = F.concat(F.expr("substr(run, 1, cast(h % length(run) as int))"), F.expr("substr(run, cast(h % length(run) as int) + 2)"))
    words = runs.withColumn("h", h).select(F.when(C("h") % every == 0, cut).otherwise(C("run")).alias("word"))
    counted = words.filter(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(C("n") >= least)


def reduced(words: list[str]) -> list[np.ndarray]:
    """The symbols, from 1, of every word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    symbols = mixed(points) % np.uint64(SYMBOLS) + np.uint64(1)
    return np.split(symbols, np.cumsum([len(w) for w in words])[:-1])


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64), dtype=np.uint64)])


def codes(symbols: np.ndarray) -> np.ndarray:
    """One 64-bit code for each row of equally long reduced words."""
    length = symbols.shape[1]
    with np.errstate(over="ignore"):
        return mixed((symbols * _powers(length)[:length]).sum(axis=1, dtype=np.uint64), np.uint64(length))


def neighbours(symbols: np.ndarray) -> np.ndarray:
    """Codes of all reduced words at most one edit from each row: itself, deletions, replacements, insertions."""
    rows, length = symbols.shape
    power = _powers(length + 1)
    alphabet = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        terms = symbols * power[:length]
        whole = terms.sum(axis=1, dtype=np.uint64)
        before = np.concatenate([np.zeros((rows, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
        after = whole[:, None] - before  # from each place on
        deleted = before[:, :-1] + after[:, 1:] * np.uint64(INVERSE)
        replaced = (whole[:, None] - terms)[:, :, None] + alphabet * power[:length, None]
        inserted = (before + after * np.uint64(BASE))[:, :, None] + alphabet * power[: length + 1, None]
        same = np.concatenate([whole[:, None], replaced.reshape(rows, -1)], axis=1)
        return np.concatenate(
            [mixed(deleted, np.uint64(length - 1)), mixed(same, np.uint64(length)), mixed(inserted.reshape(rows, -1), np.uint64(length + 1))], axis=1
        )


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of equally long words and their symbols, a few at a time."""
    parts = reduced(words)
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, AT_ONCE // (int(size) * 2 * (SYMBOLS + 1) + SYMBOLS))
        for k in range(0, len(at), step):
            yield at[k : k + step], np.stack([parts[i] for i in at[k : k + step]])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.zeros(batch.num_rows, np.uint64)
        if batch.num_rows:
            for at, symbols in _by_length(batch.column(0).to_pylist()):
                found[at] = codes(symbols)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["word", "n", "code"])


def _near(sent: Broadcast):
    """Codes of the vocabulary's reduced words that may be near each reduced word, each once."""

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Marked(sent)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(1).to_numpy(zero_copy_only=False)
            for at, symbols in _by_length(batch.column(0).to_pylist()):
                around = np.sort(neighbours(symbols), axis=1)
                new = np.ones(around.shape, bool)
                new[:, 1:] = around[:, 1:] != around[:, :-1]
                row, column = np.nonzero(new & known.has(around))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[at[row]]), pa.array(around[row, column].view(np.int64))], ["code", "near_code"]
                )

    return generate


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every ordered pair of words exactly one inserted, deleted or replaced code point apart.

    ``words`` has distinct ``word`` and their ``n``. Words that share a reduced word are generated for
    once; a word meets only words whose reduced word is near its own.
    """
    coded = kept(words.select("word", "n").mapInArrow(_coded, "word string, n bigint, code bigint"), "coded")
    groups = coded.groupBy("code").agg(F.min("word").alias("word")).select("word", "code")
    sent = marked(groups.select("code"), coded.count())
    pairs = groups.mapInArrow(_near(sent), "code bigint, near_code bigint")
    others = coded.select(C("code").alias("near_code"), C("word").alias("near"), C("n").alias("near_n"))
    met = pairs.join(coded, "code").join(others, "near_code")
    return met.filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def rooted(forms: DataFrame) -> DataFrame:
    """word, root: the last word reached from ``word`` over ``form``; each round doubles the steps taken.

    Forms have larger counts than their words, so there are no circles and few rounds.
    """
    reached = kept(forms.select("word", C("form").alias("root")), "roots")
    while True:
        on = reached.select(C("word").alias("root"), C("root").alias("next"))
        joined = kept(reached.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), C("next").isNotNull().alias("moved")), "roots")
        reached = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return reached


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary.

    Null texts have no words; a null doc_id counts as the empty text in the choice of deletions;
    repeated rows count each; equal counts are settled by code-point order; other columns are ignored;
    an empty table gives an empty result.
    """
    safe_unions(docs.sparkSession)
    words = kept(vocabulary(docs), "words")
    best = F.min(F.struct((-C("near_n")).alias("order"), "near"))
    around = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(around, "word", "left")
    strong = -C("best.order") >= 2 * C("n")
    found = kept(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(strong, C("best.near")).alias("form"),
            F.when(strong, -C("best.order")).alias("form_n"),
        ),
        "forms",
    )
    roots = rooted(found.filter(C("form").isNotNull()))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SPELLING_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS t
  FROM range(256) AS r(b)),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
once AS (SELECT doc, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hexed AS (SELECT *, hex(encode(doc || ':' || run)) AS x FROM once),
bytes AS (
  SELECT doc, run, c, list_transform(range(0, length(x) // 2), lambda i:
    CAST(16 * (instr('0123456789ABCDEF', substr(x, CAST(2 * i + 1 AS BIGINT), 1)) - 1) + instr('0123456789ABCDEF', substr(x, CAST(2 * i + 2 AS BIGINT), 1)) - 1 AS BIGINT)) AS bs
  FROM hexed),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295, bs), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, tab),
words AS MATERIALIZED (
  SELECT word, CAST(sum(c) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
gone AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gone a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gone a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near
  FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
steps(word, reached) AS (
  SELECT word, form FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.reached WHERE f.form IS NOT NULL),
roots AS (SELECT s.word, s.reached AS root FROM steps s JOIN forms f ON f.word = s.reached WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN roots r ON r.word = f.word
"""
