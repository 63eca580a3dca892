"""Spelling variants against every pair of words compared, and the neighbourhoods' own promise."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import spelling
from tapeloom.llm.spelling import codes, neighbours, reduced, rooted, variants, vocabulary

from .conftest import EDGES


def words_of(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def apart(a, b):
    """Whether one edit makes a to b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(rows):
    n = words_of(rows)
    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(seed, docs=150):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdéÿÀ") for _ in range(rng.randint(4, 7))) for _ in range(25)]

    def word():
        w = rng.choice(base)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w = w[:k] + rng.choice(["", rng.choice("abcd×"), w[k] + rng.choice("abé")]) + w[k + 1 :]
        return w.upper() if rng.random() < 0.1 and w.isascii() else w

    chain = [(seed, "lunar " * 3 + "lunars " * 7 + "lunarsy " * 16, "en", "s")] * 2
    return chain + [(rng.choice([None, k, k, k]), rng.choice([" ", "-", "3", "."]).join(word() for _ in range(rng.randint(0, 40))), "en", "s") for k in range(docs)]


@pytest.mark.parametrize("seed", range(3))
def test_same_as_every_pair(docs_of, seed):
    rows = rows_of(seed)
    got = variants(docs_of(rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert [t for _, t in got.dtypes] == ["string", "string", "string", "bigint", "bigint", "bigint"]
    found = [tuple(r) for r in got.collect()]
    want = expected(rows)
    assert set(found) == want and len(found) == len(want)
    assert any(w[1] and w[2] != w[1] for w in want)  # longer ways are among them


def test_small_portions(docs_of, monkeypatch):
    monkeypatch.setattr(spelling, "AT_ONCE", 1)
    rows = rows_of(5, 60)
    assert {tuple(r) for r in variants(docs_of(rows)).collect()} == expected(rows)


def test_edges(edges, nothing, docs_of):
    assert {tuple(r) for r in variants(edges).collect()} == expected(EDGES)
    assert variants(nothing).count() == 0
    assert variants(docs_of([(1, None, None, None), (2, "no word here is found thrice", "en", "s")])).count() == 0
    long = [(1, "x" * 70_000 + " " + "words " * 100_000, "en", "s")]
    assert {tuple(r) for r in variants(docs_of(long)).collect()} == expected(long)


def test_deleted_letters(docs_of):
    rows = [(k, "wonderful", "en", "s") for k in range(3000)]
    assert {r.word: r.n for r in vocabulary(docs_of(rows)).collect()} == words_of(rows)
    assert len(words_of(rows)) > 3


def test_neighbourhoods_hold_every_edit_of_reduced_words():
    rng = np.random.default_rng(4)
    for length in (1, 2, 5, 9):
        symbols = rng.integers(1, spelling.SYMBOLS + 1, (7, length)).astype(np.uint64)
        around = neighbours(symbols)
        for row, found in zip(symbols.tolist(), around):
            edits = [row]
            for k in range(length + 1):
                edits += [row[:k] + [s] + row[k:] for s in range(1, spelling.SYMBOLS + 1)]
                if k < length:
                    edits += [row[:k] + row[k + 1 :]] + [row[:k] + [s] + row[k + 1 :] for s in range(1, spelling.SYMBOLS + 1)]
            want = {int(codes(np.array([e], np.uint64).reshape(1, -1))[0]) for e in edits}
            assert set(found.tolist()) == want


def test_reduced_words_of_near_words_are_near():
    a, b = reduced(["voilà", "voila"])
    assert (a != b).sum() <= 1 and len(reduced(["x"])[0]) == 1


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)] + [("x", "w5")], "word string, form string")
    got = {r.word: r.root for r in rooted(forms).collect()}
    assert got == {**{f"w{k}": "w37" for k in range(37)}, "x": "w37"}
