"""Scoring texts with an n-gram language model held in Elias-Fano tries.

Documents are read in batches of about ``BATCH`` tokens, each with a vocabulary of its own. A batch sends every
distinct pair of neighbours, and every distinct word, once to the shard that its hash belongs to, with
its count in training documents. A shard adds the batches up and builds a trie of the pairs seen
in training: contexts, pointers and successors are Elias-Fano sequences, values are quantised. The
trie lies in a memory-mapped file, answers every batch's pairs by a successor search within the
context's range, and the answers go back to the batches, which put the scores together. What moves
grows with the corpus; no task holds more than a batch or a shard.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import fold_of, kept, parallelism, safe_unions

C = F.col
BATCH = 1 << 20  # tokens of a batch; a longer document is a batch of its own
SHARD = 1 << 19  # tokens of the corpus for each shard
MASS = 10.0  # weight of the unigram level in the smoothed probability of a pair
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)  # stand-ins for the hashes of both ends of a text
SPLIT = np.uint64(15)  # a context's successors are spread over this many shards and one more
STEPS = float(1 << 20)  # quantiser: steps of a count's decimal logarithm
GOLD = np.uint64(0x9E3779B97F4A7C15)


def packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return zstandard.compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    sizes = np.frombuffer(data, np.int64, len(kinds), 8)
    at, out = 8 * (len(kinds) + 1), []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def _narrow(values: np.ndarray, size: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size]


def _wide(data: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = data.reshape(-1, size)
    return out.view("<u8").ravel()


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary, found again by counting bits."""

    def __init__(self, words: np.ndarray) -> None:
        """From stored words (see ``encode``)."""
        n, low, lows, highs = (int(x) for x in words[:4])
        self.n, self.width = n, np.uint64(low)
        self.lows, self.highs = words[4 : 4 + lows], words[4 + lows : 4 + lows + highs]
        self.ones = words[4 + lows + highs : 4 + lows + 2 * highs].view(np.int64)  # ones before each word
        self.zeros = np.arange(highs, dtype=np.int64) * 64 - self.ones

    @staticmethod
    def encode(values: np.ndarray) -> np.ndarray:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        low = max(0, (top // max(1, n)).bit_length() - 1)
        lows = np.zeros(n * low // 64 + 2, np.uint64)
        if low:
            part = values & np.uint64((1 << low) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(low)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(lows, word, part << shift)
            over = shift + np.uint64(low) > np.uint64(64)
            np.bitwise_or.at(lows, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        highs = np.zeros(int(places[-1]) // 64 + 2 if n else 1, np.uint64)
        np.bitwise_or.at(highs, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(highs).astype(np.int64))[:-1]))
        head = np.array([n, low, len(lows), len(highs)], np.uint64)
        return np.concatenate((head, lows, highs, ones.view(np.uint64)))

    @staticmethod
    def _place(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the rank-th one in each word, by halving."""
        place = np.zeros(len(words), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(words & np.uint64((1 << step) - 1)).astype(np.int64)
            past = rank >= count
            rank = np.where(past, rank - count, rank)
            words = np.where(past, words >> np.uint64(step), words)
            place += past * step
        return place

    def _select(self, before: np.ndarray, words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(before, rank, side="right") - 1
        return word * 64 + self._place(words[word], rank - before[word])

    def get(self, at: np.ndarray) -> np.ndarray:
        high = (self._select(self.ones, self.highs, at) - at).astype(np.uint64)
        if not self.width:
            return high
        bit = at.astype(np.uint64) * self.width
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        upper = np.where(shift > 0, self.lows[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return high << self.width | ((self.lows[word] >> shift | upper) & np.uint64((1 << int(self.width)) - 1))

    def successor(self, wanted: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place in [start, end) whose value is at least the wanted one, and the value there; ``end`` if there is none."""
        high = (wanted >> self.width).astype(np.int64)
        inside = high > 0
        at = np.zeros(len(wanted), np.int64)
        # The h-th zero ends the values whose high part is h - 1 or less.
        zeros = int(len(self.highs) * 64 - self.n)
        rank = np.minimum(high[inside] - 1, zeros - 1)
        at[inside] = self._select_zero(rank) - rank
        at = np.minimum(np.maximum(at, start), end)
        value = np.zeros(len(wanted), np.uint64)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            got = self.get(at[open_])
            value[open_] = got
            short = open_[got < wanted[open_]]
            at[short] += 1
            open_ = short[at[short] < end[short]]
        return at, value

    def _select_zero(self, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, rank, side="right") - 1
        return word * 64 + self._place(~self.highs[word], rank - self.zeros[word])


class Trie:
    """Two levels: contexts with pointers, and successors as ids relative to their context, with quantised values."""

    @staticmethod
    def write(file, contexts: np.ndarray, successors: np.ndarray, context: np.ndarray, successor: np.ndarray, counts: np.ndarray) -> None:
        """``contexts`` and ``successors`` are sorted hashes; pairs are sorted places in both, with counts."""
        pointers = np.searchsorted(context, np.arange(len(contexts) + 1))
        # Each range starts from the last value of the one before, so that the whole sequence rises.
        lasts = np.zeros(len(contexts) + 1, np.int64)
        full = np.flatnonzero(np.diff(pointers))
        lasts[full + 1] = successor[pointers[full + 1] - 1]
        base = np.cumsum(lasts)[:-1]
        parts = [EliasFano.encode(x) for x in (contexts, successors, pointers, base, successor + base[context])]
        codes = quantised(counts)
        np.array([len(p) for p in parts] + [len(codes)], np.int64).tofile(file)
        for p in parts:
            p.tofile(file)
        codes.tofile(file)
        file.flush()

    def __init__(self, path: str) -> None:
        sizes = np.memmap(path, np.int64, "r", 0, (6,))
        at, parts = 48, []
        for n in sizes[:5]:
            parts.append(EliasFano(np.memmap(path, np.uint64, "r", at, (int(n),))))
            at += int(n) * 8
        self.contexts, self.successors, self.pointers, self.base, self.sequence = parts
        self.codes = np.memmap(path, np.uint32, "r", at, (int(sizes[5]),)) if sizes[5] else np.zeros(0, np.uint32)

    def codes_of(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Quantised value of each pair of hashes; 0 for pairs never seen."""
        out = np.zeros(len(context), np.uint32)
        for a in range(0, len(context), 1 << 16):
            out[a : a + (1 << 16)] = self._codes(context[a : a + (1 << 16)], successor[a : a + (1 << 16)])
        return out

    def _codes(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        out = np.zeros(len(context), np.uint32)
        zero = np.zeros(len(context), np.int64)
        c, got = self.contexts.successor(context, zero, zero + self.contexts.n)
        s, own = self.successors.successor(successor, zero, zero + self.successors.n)
        rows = np.flatnonzero((c < self.contexts.n) & (got == context) & (s < self.successors.n) & (own == successor))
        c, s = c[rows], s[rows]
        start, end = self.pointers.get(c).astype(np.int64), self.pointers.get(c + 1).astype(np.int64)
        wanted = s.astype(np.uint64) + self.base.get(c)
        place, value = self.sequence.successor(wanted, start, end)
        hit = (place < end) & (value == wanted)
        out[rows[hit]] = self.codes[place[hit]]
        return out


def quantised(counts: np.ndarray) -> np.ndarray:
    """1 + decimal logarithm of counts in steps of 1 / ``STEPS``, rounded down: exact for 1, else 0.0002 % too low at most."""
    return (1 + np.floor(np.log10(np.maximum(counts, 1)) * STEPS)).astype(np.uint32)


def restored(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((codes.astype(float) - 1) / STEPS), 0.0)


def hashed(text: bytes | None) -> list[int]:
    return [xxhash.xxh64_intdigest(w) for w in (text or b"").lower().split()]


BATCHES = "doc_id array<bigint>, held array<boolean>, sizes array<bigint>, n bigint, train bigint, blob binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    held: list = []
    sizes: list = []
    words: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        vocabulary, tokens = np.unique(np.concatenate(words), return_inverse=True)
        n = np.array(sizes)
        row = [
            pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int64())),
            pa.array([int(n.sum())]), pa.array([int(n[~np.array(held)].sum())]), pa.array([packed(vocabulary, tokens.astype(np.uint32))]),
        ]
        for x in (ids, held, sizes, words):
            x.clear()
        return pa.RecordBatch.from_arrays(row, [c.split()[0] for c in BATCHES.split(", ")])

    total = 0
    for batch in batches:
        for doc_id, text, fold in zip(*batch.columns):
            own = np.array([*hashed(text.as_py()), int(END)], np.uint64)
            ids.append(doc_id.as_py())
            held.append(fold.as_py())
            sizes.append(len(own))
            words.append(own)
            total += len(own)
            if total >= BATCH:
                yield out()
                total = 0
    if ids:
        yield out()


class Pairs:
    """The distinct pairs and words of a batch, in the order of the shards that they belong to."""

    def __init__(self, blob: bytes, sizes: np.ndarray, held: np.ndarray, shards: int) -> None:
        self.words, tokens = unpacked(blob, "<u8", "<u4")
        self.tokens, v = tokens.astype(np.int64), len(self.words)
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        train = np.repeat(~held, sizes)
        before = np.concatenate(([v], self.tokens[:-1]))
        before[self.starts] = v
        code, self.which = np.unique(before * v + self.tokens, return_inverse=True)
        self.before, self.after = code // v, code % v
        contexts = np.append(self.words, START)[self.before]
        self.context, self.successor = contexts >> np.uint64(16), self.words[self.after] >> np.uint64(24)
        self.counts = np.bincount(self.which[train], minlength=len(code))
        self.word_counts = np.bincount(self.tokens[train], minlength=v)
        spread = (self.context ^ (self.successor & SPLIT) * np.uint64(0xD6E8FEB86659FD93)) * GOLD
        shard = ((spread >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        self.order = np.lexsort((self.successor, self.context, shard))
        self.cuts = np.searchsorted(shard[self.order], np.arange(shards + 1))
        shard = ((self.words * GOLD >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        self.word_order = np.argsort(shard, kind="stable")
        self.word_cuts = np.searchsorted(shard[self.word_order], np.arange(shards + 1))


def _message(p: Pairs, shard: int) -> bytes:
    own, words = p.order[p.cuts[shard] : p.cuts[shard + 1]], p.word_order[p.word_cuts[shard] : p.word_cuts[shard + 1]]
    contexts, runs = np.unique(p.context[own], return_counts=True)
    return packed(
        _narrow(contexts, 6), runs.astype(np.uint32), _narrow(p.successor[own], 5), p.counts[own].astype(np.uint32),
        p.words[words], p.word_counts[words].astype(np.uint32),
    )


def _parsed(blob: bytes) -> list[np.ndarray]:
    contexts, runs, successors, counts, words, word_counts = unpacked(blob, "u1", "<u4", "u1", "<u4", "<u8", "<u4")
    return [np.repeat(_wide(contexts, 6), runs), _wide(successors, 5), counts, words, word_counts]


def _sent(shards: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, held, sizes, blob in zip(*batch.columns):
                p = Pairs(blob.as_py(), np.array(sizes.as_py()), np.array(held.as_py()), shards)
                blobs = [_message(p, k) for k in range(shards)]
                yield pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array([number.as_py()] * shards, pa.int64()), pa.array(blobs)], ["shard", "batch", "blob"])

    return send


ANSWERS = "shard int, batch bigint, blob binary, n bigint, v bigint"


def answered(messages: pd.DataFrame) -> pd.DataFrame:
    """Add up a shard's messages, build its trie, and answer each message; the row of batch -1 holds the shard's totals."""
    shard, parts = int(messages["shard"].iloc[0]), [_parsed(b) for b in messages["blob"]]
    contexts, context = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    successors, successor = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    u = max(1, len(successors))
    code, which = np.unique(context * u + successor, return_inverse=True)
    counts = np.bincount(which, np.concatenate([p[2] for p in parts]), len(code)).astype(np.int64)
    context, successor, seen = code // u, code % u, counts > 0
    with tempfile.NamedTemporaryFile(prefix="trie-") as file:
        Trie.write(file, contexts, successors, context[seen], successor[seen], counts[seen])
        codes = Trie(file.name).codes_of(contexts[context], successors[successor])
    words, word = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
    word_counts = np.bincount(word, np.concatenate([p[4] for p in parts]), len(words)).astype(np.int64)
    blobs, a, b = [], 0, 0
    for p in parts:
        blobs.append(packed(codes[which[a : a + len(p[0])]], word_counts[word[b : b + len(p[3])]]))
        a, b = a + len(p[0]), b + len(p[3])
    zero = [0] * len(blobs)
    return pd.DataFrame(
        {
            "shard": shard, "batch": [-1, *messages["batch"]], "blob": [b"", *blobs],
            "n": [int(word_counts.sum()), *zero], "v": [int((word_counts > 0).sum()), *zero],
        }
    )


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scored(shards: int, n: int, v: int, texts: int):
    def score(batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame({c.split()[0]: [] for c in SCORES.split(", ")})
        row = batch.iloc[0]
        sizes, held = np.asarray(row["sizes"], np.int64), np.asarray(row["held"], bool)
        p = Pairs(row["blob"], sizes, held, shards)
        pair, word = np.zeros(len(p.order)), np.zeros(len(p.words))
        for shard, blob in zip(answers["shard"], answers["blob"]):
            codes, counts = unpacked(blob, "<u4", "<i8")
            pair[p.order[p.cuts[shard] : p.cuts[shard + 1]]] = restored(codes)
            word[p.word_order[p.word_cuts[shard] : p.word_cuts[shard + 1]]] = counts
        base = (word + 0.1) / (n + 0.1 * (v + 1))
        context = np.append(word, texts)[p.before]
        smoothed = np.log10((pair + MASS * base[p.after]) / (context + MASS))
        return pd.DataFrame(
            {
                "doc_id": pd.array(list(row["doc_id"]), "Int64"), "held_out": held, "n_tokens": sizes,
                "n_known": np.add.reduceat((word > 0)[p.tokens].astype(np.int64), p.starts), "train_tokens": n,
                "base_score": np.add.reduceat(np.log10(base)[p.tokens], p.starts), "score": np.add.reduceat(smoothed[p.which], p.starts),
            }
        )

    return score


def scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text; one row per input row.

    Learns from rows outside the held-out fold. ``base_score`` is the add-0.1 unigram score. ``score`` is the log10
    probability under pairs smoothed by that unigram level: (c(a, b) + MASS p(b)) / (c(a) + MASS), where
    a is the word before or the start of the text, b a word or the end, and c(a, b) the trie's
    value. Null texts count as empty and hold the end alone; a null doc_id counts as the empty text in
    the choice of the fold. With nothing to learn from every probability is one. Repeated rows count
    and are scored each; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    safe_unions(spark)
    rows = docs.select(C("doc_id").cast("bigint").alias("doc_id"), C("text").cast("binary").alias("text"), (fold_of("doc_id", folds) == 0).alias("held"))
    read = kept(rows.mapInArrow(_read, BATCHES).select(F.monotonically_increasing_id().alias("batch"), "*"), "batches")
    total = read.agg(F.sum("n"), F.sum(F.size(F.filter("held", lambda h: ~h)))).first()
    shards = max(parallelism(spark), -(-(total[0] or 0) // SHARD))
    messages = read.select("batch", "held", "sizes", "blob").mapInArrow(_sent(shards), "shard int, batch bigint, blob binary")
    answers = kept(messages.groupBy("shard").applyInPandas(answered, ANSWERS), "answers")
    n, v = (x or 0 for x in answers.filter(C("batch") < 0).agg(F.sum("n"), F.sum("v")).first())
    batches = read.select("batch", "doc_id", "held", "sizes", "blob").groupBy("batch")
    own = answers.filter(C("batch") >= 0).select("batch", "shard", "blob").groupBy("batch")
    return batches.cogroup(own).applyInPandas(_scored(shards, n, v, total[1] or 0), SCORES)
