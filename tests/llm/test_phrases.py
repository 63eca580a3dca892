"""Collocations against plain counting, and the parse's own promises."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm import phrases
from tapeloom.llm.phrases import LAP, Tokens, collocations, counts, dictionary

from .conftest import EDGES


def pieces(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def counted(rows):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for size in range(1, 5):
                for k in range(len(words) - size + 1):
                    f[lang or "und", tuple(words[k : k + size])] += 1
    return f, n


def expected(rows, least, first=2000):
    f, n = counted(rows)
    f = {k: a for k, a in f.items() if a >= least}
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        if any(
            g == lang and len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) and 100 * b >= 80 * a
            for (g, q), b in f.items()
        ):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], score))
    return {
        (lang, rank, p, a, l, r, n[lang], score)
        for lang, found in out.items()
        for rank, (_, _, _, p, a, l, r, score) in enumerate(sorted(found)[:first], 1)
    }


def rows_of(seed, docs=120):
    rng = random.Random(seed)
    words = ["an", "bo", "cé", "Da", "e'e", "ﬁ", "g h"]
    passage = " ".join(rng.choice(words) for _ in range(70))
    out = []
    for k in range(docs):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "\r"]) for _ in range(rng.randint(0, 60)))
        if k % 3 == 0:
            text += passage + rng.choice(["", ".", " an"])
        out.append((k % 40 if k % 7 else None, text if k % 11 else None, rng.choice(["en", "de", None]), "s"))
    return out + out[:9]


@pytest.mark.parametrize("seed", range(3))
def test_same_as_plain_counting(docs_of, seed):
    rows = rows_of(seed)
    got = collocations(docs_of(rows), least=6)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    found = [tuple(r) for r in got.collect()]
    assert set(found) == expected(rows, 6) and len(found) == len(set(found))


def test_counts_in_small_blocks_and_dense_chunks(docs_of, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 50)
    rows = rows_of(7)
    found, totals = counts(docs_of(rows), 5)
    f, n = counted(rows)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.a for r in found.collect()} == {k: a for k, a in f.items() if a >= 5}
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in n.items() if v}


def test_ties_and_limit(docs_of):
    rows = [(1, "b a. d c. f e. " * 30, "en", "s")]
    got = [tuple(r)[1:3] for r in collocations(docs_of(rows), first=2).orderBy("rank").collect()]
    assert got == [(1, "b a"), (2, "d c")]


def test_edges(edges, nothing, docs_of):
    got = {tuple(r) for r in collocations(edges, least=2).collect()}
    assert got == expected(EDGES, 2)
    assert collocations(nothing).count() == 0
    assert collocations(docs_of([(1, "a b", "en", "s"), (2, None, None, None)])).count() == 0


def test_one_word_again_and_again(docs_of):
    rows = [(1, "the " * 50_000, "en", "s"), (2, "of the, " * 40, "en", "s")]
    assert {tuple(r) for r in collocations(docs_of(rows)).collect()} == expected(rows, 30)


def test_chunks_rebuild_the_texts_and_copies_share_them(docs_of):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randint(0, 999)}" for _ in range(3000))
    rows = [(k, text, "en", "s") for k in range(5)] + [(9, "before it, " + text, "en", "s")]
    found = dictionary(docs_of(rows)).collect()
    assert sum(r.times * (len(r.chunk.split(" ")) - LAP) for r in found) == sum(len([w for p in pieces(r[1]) for w in p]) for r in rows) + 1  # one break
    assert len(found) < 1.5 * 3000 / phrases.EVERY
    assert sum(r.times == 6 for r in found) > 0.9 * len(found)


def test_tokens_of_a_slice():
    texts = pa.array(["x", "A b,,c", "", " .", "dé\tÉ"])
    tokens = Tokens(texts.slice(1))
    words = tokens.words.to_pylist()
    assert [words[i] if i >= 0 else "|" for i in tokens.ids] == ["a", "b", "|", "c", "|", "dé", "É"]
    assert tokens.firsts.tolist() == [0, 4, 4, 5, 7]
    assert np.array_equal(Tokens(pa.array([""])).firsts, [0, 0]) and Tokens(pa.array([], pa.string())).firsts.tolist() == [0]
