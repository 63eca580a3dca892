import hashlib
import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tapeloom.llm import bpe

from .conftest import EDGES

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "b", "th", "e", "'s", "'", "1", "é", "e\u0301", "İ", "ß", "Σ", "ς", " ", "\n", "<|endoftext|>", "<|start", "oftext|>", "|", "\x1c", "\x85", "日本", "😀", "\x00", "ﬁ", "가"]


@pytest.fixture(scope="module")
def known():
    library = Tokenizer.from_file(PATH)

    def make(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return make


def test_same_as_the_library(known):
    rng, v = random.Random(5), bpe.vocabulary(PATH)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts += ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "etaoinshr", "ा한字é") for n in (47, 48, 49, 3000)]
    for text, (ids, n, decoded) in zip(texts, v.encode(pa.array(texts)), strict=True):
        assert (n, *bpe._digests(ids, decoded)) == known(text)


def test_pieces_merged_together_are_merged_alone(monkeypatch):
    rng, v = random.Random(8), bpe.vocabulary(PATH)
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 48))).encode()[:48] for letters in ("ab", "etaoinshr", "éü한") for _ in range(300)]

    def alone(piece):
        symbols = [v.inner[b] for b in piece]
        symbols[-1] = v.last[symbols[-1]]
        return tuple(v.merge(symbols))

    assert v.merge_all(pieces) == list(map(alone, pieces)) and v.merge_all([]) == []
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "AT_ONCE", 3)
    for k in range(0, len(pieces), 7):
        v.learn(set(pieces[k : k + 7]))
        assert [v.run(p) for p in pieces[k : k + 7]] == list(map(alone, pieces[k : k + 7]))


def test_a_text_of_a_million_words(known):
    text = " ".join(f"w{k % 90_000} the" for k in range(500_000))
    ((ids, n, decoded),) = bpe.vocabulary(PATH).encode(pa.array([text]))
    assert (n, *bpe._digests(ids, decoded)) == known(text)


def test_joins_agree_with_one_run():
    rng, v = random.Random(6), bpe.vocabulary(PATH)
    for _ in range(100):
        symbols = [v.inner[ord(rng.choice("theandin"))] for _ in range(rng.randint(2, 90))]
        cut = rng.randint(1, len(symbols) - 1)
        assert v.join(v.merge(symbols[:cut]), v.merge(symbols[cut:])) == v.merge(symbols)


@pytest.mark.parametrize("leaf", [1 << 15, 10])
def test_edges(edges, nothing, known, leaf, monkeypatch):
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(edges, PATH, leaf=leaf).collect())
    assert got == sorted((r[0] or -1, *known(r[1])) for r in EDGES)
    assert bpe.encoded(nothing, PATH, leaf=leaf).count() == 0
