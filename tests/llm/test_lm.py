import collections
import math
import random
import tempfile
import zlib

import numpy as np
import pytest

from tapeloom.llm import lm

from .conftest import EDGES


def brute(rows):
    known, pairs, words, texts = [], collections.Counter(), collections.Counter(), 0
    for doc_id, text in rows:
        tokens = [*(text or "").encode().lower().split(), None]
        held = zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % 10 == 0
        known.append((doc_id, held, tokens))
        if not held:
            texts += 1
            words.update(tokens)
            pairs.update(zip(["<", *tokens], tokens))
    n, v = sum(words.values()), len(words)
    out = []
    for doc_id, held, tokens in known:
        base = [(words[t] + 0.1) / (n + 0.1 * (v + 1)) for t in tokens]
        before = [texts, *[words[t] for t in tokens]]
        each = [(pairs[p] + lm.MASS * b) / (c + lm.MASS) for p, b, c in zip(zip(["<", *tokens], tokens), base, before)]
        out.append((doc_id, held, len(tokens), sum(words[t] > 0 for t in tokens), n, sum(map(math.log10, base)), sum(map(math.log10, each))))
    return out


def same(got, rows):
    key = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=2e-6 * a[2])


def test_edges(edges, nothing):
    same(lm.scores(edges).collect(), [r[:2] for r in EDGES])
    assert lm.scores(nothing).count() == 0


def test_many_batches(docs_of, monkeypatch):
    rng = random.Random(13)
    monkeypatch.setattr(lm, "SHARD", 500)
    words = [f"w{int(rng.paretovariate(1))}" for _ in range(4000)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(200)]
    same(lm.scores(docs_of([(*r, "en", "a") for r in rows])).collect(), rows)


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], list(range(200)), [0, 2**62], sorted(random.Random(14).choices(range(10**9), k=3000))])
def test_elias_fano(values):
    values = np.array(values, np.uint64)
    ef = lm.EliasFano(lm.EliasFano.encode(values))
    at = np.arange(len(values))
    assert (ef.get(at) == values).all()
    wanted = np.array([0, 1, 5, 6, 199, 200, 2**61, *values[:50], *(values[:50] + np.uint64(1))], np.uint64)
    zero = np.zeros(len(wanted), np.int64)
    assert (ef.successor(wanted, zero, zero + len(values))[0] == np.searchsorted(values, wanted)).all()


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(15)
    contexts, successors = (np.unique(rng.integers(0, 2**40, 300).astype(np.uint64)) for _ in range(2))
    code = np.unique(rng.integers(0, len(contexts) * len(successors), 4000))
    c, s, counts = code // len(successors), code % len(successors), rng.integers(1, 9, len(code))
    with tempfile.NamedTemporaryFile() as file:
        lm.Trie.write(file, contexts, successors, c, s, counts)
        trie = lm.Trie(file.name)
        assert (trie.codes_of(contexts[c], successors[s]) == lm.quantised(counts)).all()
        other = np.setdiff1d(np.arange(len(contexts) * len(successors)), code)[:5000]
        assert not trie.codes_of(contexts[other // len(successors)], successors[other % len(successors)]).any()
        assert not trie.codes_of(contexts[:9] + np.uint64(1), successors[:9]).any()
