import random

import pytest

from tapeloom.llm import ctph

from .conftest import EDGES


def expected(rows):
    ordered = sorted(((i is not None, i or 0, t or "", i) for i, t in rows))
    out = []
    for k, (_, _, text, doc_id) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][2]
        out.append(ctph.described(doc_id, text, ctph.fingerprint(text), following, ctph.fingerprint(following)))
    return sorted(out, key=str)


def test_edges(edges, nothing):
    got = sorted((tuple(r) for r in ctph.fingerprinted(edges).collect()), key=str)
    assert got == expected([r[:2] for r in EDGES])
    assert ctph.fingerprinted(nothing).count() == 0


def test_one_document_follows_itself(docs_of):
    (row,) = ctph.fingerprinted(docs_of([EDGES[0]])).collect()
    text = EDGES[0][1]
    assert row.near_next == 1.0 and row.n_chars == len(text) and row.doc_id == 5


def test_blocks_do_not_change_signatures(monkeypatch):
    rng = random.Random(10)
    texts = [bytes(rng.choice(b"abcdefgh \n") for _ in range(n)) for n in (0, 1, 6, 7, 63, 64, 65, 128, 5000)]
    whole = [ctph.signature(t, size) for t in texts for size in (3, 12, 96)]
    monkeypatch.setattr(ctph, "BLOCK", 64)
    assert [ctph.signature(t, size) for t in texts for size in (3, 12, 96)] == whole


def test_likeness_tells_edits_from_strangers():
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioustrn") for _ in range(6)) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([20, 200, 3000]))) for _ in range(60)]
    marks = list(map(ctph.fingerprint, texts))
    for k, text in enumerate(texts):
        assert ctph.likeness(marks[k], ctph.fingerprint(ctph.edited(text, texts[k - 1]))) > 0.5
        assert ctph.likeness(marks[k], marks[k - 1]) < 0.2
        assert ctph.likeness(marks[k], ctph.fingerprint(text)) == 1.0


@pytest.mark.parametrize(("a", "b", "n"), [("", "x", 0), ("abc", "abc", 3), ("abcde", "xaxcxe", 3), ("aab", "aba", 2)])
def test_common_subsequence(a, b, n):
    assert ctph.common(a, b) == n
