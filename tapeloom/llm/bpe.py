"""BPE encoding and decoding of whole texts, with tree concatenation for long unsplit runs.

A text is cut at ASCII white space, which no piece of the vocabulary's pattern crosses. The distinct words of
a portion of texts are encoded once, all their short pieces together: each round merges every piece's
best pair, in arrays. A piece without any split point that is long is halved, the halves are
encoded on their own, and the join is mended: the tokens around it are encoded again in a window that
grows until its outer tokens agree with both sides. Adjacent tokens that arise together in one valid
encoding are valid anywhere, so the mended sequence is the encoding of the whole.

Long documents are cut into leaves that are encoded in different tasks; the leaves of a document
are then joined pairwise, as a tree. Other documents are encoded where they are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import fresh, parallelism, safe_unions
from tapeloom.llm.phrases import Tokens, blocks

C = F.col
LEAF = 1 << 15  # code points of a leaf; longer documents are spread over tasks
PIECE = 1 << 12  # symbols of an unsplit piece that one leaf holds
RUN = 48  # symbols up to which a run is merged directly
AT_ONCE = 1 << 16  # pieces merged together
NONE = 1 << 60  # the rank of pairs that do not merge
REMEMBERED = 32_000  # pieces in each of the two generations that a worker remembers
WORD = re.compile(r"[^ \t\n\r\f\v]+")
#: ASCII white space becomes blanks, all other bytes stay.
BLANKS = np.arange(256, dtype=np.uint8)
BLANKS[[9, 10, 11, 12, 13]] = 32
SCHEMA = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks, pattern and special tokens of a tokenizer file of the ``tokenizers`` format."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        ids: dict[str, int] = dict(model["vocab"])
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.known = 1 + max([*ids.values(), *self.specials.values()])
        self.suffix = model.get("end_of_word_suffix") or ""
        # Symbols that the vocabulary lacks get ids beyond it, which take part in nothing and vanish at the end.
        for symbol in byte_symbols():
            for s in (symbol, symbol + self.suffix):
                ids.setdefault(s, self.known + len(ids))
        self.inner = [ids[s] for s in byte_symbols()]
        self.last = {a: ids[s + self.suffix] for a, s in zip(self.inner, byte_symbols())}
        self.names = {i: s for s, i in ids.items()} | {i: s for s, i in self.specials.items()}
        self.ids = ids
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {ids[a] << 20 | ids[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        # The same as arrays: merges sorted by their pair, and symbols by byte.
        order = np.argsort(keys := np.fromiter(self.ranks, np.int64, len(self.ranks)))
        self.sorted_pairs, self.sorted_ranks = keys[order], np.fromiter(self.ranks.values(), np.int64, len(keys))[order]
        self.made_ids = np.array(self.made, np.int64)
        self.byte_ids = np.array(self.inner, np.int64)
        self.last_ids = np.array([self.last[a] for a in self.inner], np.int64)
        self.token_names = pa.array([self.names.get(i) for i in range(self.known)], pa.string())
        split = next(p for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) or "(?!)")
        self.runs: dict[bytes, tuple[int, ...]] = {}
        self.runs_before: dict[bytes, tuple[int, ...]] = {}
        self.apart: dict[int, list[int]] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Apply merges by rank, leftmost first, until none fits."""
        rank, none, made = self.ranks.get, NONE, self.made
        parts = list(parts)
        fits = [rank(a << 20 | b, none) for a, b in zip(parts, parts[1:])]
        fits.append(none)
        while (best := min(fits)) != none:
            at = fits.index(best)
            new = parts[at] = made[best]
            del parts[at + 1], fits[at]
            if at:
                fits[at - 1] = rank(parts[at - 1] << 20 | new, none)
            if at + 1 < len(parts):
                fits[at] = rank(new << 20 | parts[at + 1], none)
        return parts

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NONE`` where they do not merge."""
        pair = left << 20 | right
        at = np.minimum(np.searchsorted(self.sorted_pairs, pair), len(self.sorted_pairs) - 1)
        return np.where(self.sorted_pairs[at] == pair, self.sorted_ranks[at], NONE)

    def merge_all(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` of many whole pieces at once: each round merges the best pair of every piece that has one."""
        if not pieces:
            return []
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        parts = self.byte_ids[data]
        ends = np.cumsum(sizes) - 1
        parts[ends] = self.last_ids[data[ends]]
        done: list = [None] * len(pieces)
        piece = np.arange(len(pieces))  # of each row still at work
        fits = np.full(len(parts), NONE)
        fits[:-1] = self.rank_of(parts[:-1], parts[1:])
        fits[ends] = NONE  # the last part of a row has no right neighbour
        while len(piece):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(fits, starts)
            over = best == NONE
            if over.any():
                for k in np.flatnonzero(over):
                    done[piece[k]] = tuple(parts[starts[k] : starts[k] + sizes[k]].tolist())
                stay = np.repeat(~over, sizes)
                parts, fits = parts[stay], fits[stay]
                piece, sizes, best = piece[~over], sizes[~over], best[~over]
                if not len(piece):
                    break
                starts = np.cumsum(sizes) - sizes
            # The leftmost of the best pairs of each row.
            hits = np.flatnonzero(fits == np.repeat(best, sizes))
            row = np.searchsorted(starts, hits, side="right") - 1
            first = np.ones(len(hits), bool)
            first[1:] = row[1:] != row[:-1]
            at = hits[first]
            parts[at] = self.made_ids[best]
            last = at + 1 == starts + sizes - 1  # what is merged in was the row's last part
            fits[at] = NONE
            gone = np.zeros(len(parts), bool)
            gone[at + 1] = True
            at -= np.arange(len(at))  # one part before each is gone
            parts, fits = parts[~gone], fits[~gone]
            sizes = sizes - 1
            starts = starts - np.arange(len(starts))
            right = at[~last]
            fits[right] = self.rank_of(parts[right], parts[right + 1])
            left = at[at > starts] - 1
            fits[left] = self.rank_of(parts[left], parts[left + 1])
        return done

    def symbols_of(self, tokens: list[int]) -> list[int]:
        """The symbols that tokens are made of; the last one carries the word's end."""
        out: list[int] = []
        for t in tokens:
            own = self.apart.get(t)
            if own is None:
                name = self.names[t]
                ends = bool(self.suffix) and name.endswith(self.suffix) and len(name) > len(self.suffix)
                own = [self.ids[c] for c in (name[: -len(self.suffix)] if ends else name)]
                if ends:
                    own[-1] = self.last[own[-1]]
                self.apart[t] = own
            out += own
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours as one run."""
        i, j = min(2, len(left)), min(2, len(right))
        while left and right:
            window = self.merge(self.symbols_of(left[len(left) - i :] + right[:j]))
            fits_left = i == len(left) or window[0] == left[len(left) - i]
            fits_right = j == len(right) or window[-1] == right[j - 1]
            if fits_left and fits_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if fits_left else min(2 * i, len(left))), (j if fits_right else min(2 * j, len(right)))
        return left + right

    def tree(self, symbols: list[int]) -> list[int]:
        """Encode a run of symbols: directly if short, else by halves."""
        if len(symbols) <= RUN:
            return self.merge(symbols)
        half = len(symbols) // 2
        return self.join(self.tree(symbols[:half]), self.tree(symbols[half:]))

    def pieces(self, word: str) -> Iterator[bytes | int]:
        """Pieces of a text without ASCII white space, as bytes; special tokens as ids."""
        at = 0
        for m in [*self.special.finditer(word), None]:
            plain = word[at : m.start() if m else len(word)]
            if not plain.isascii():
                plain = unicodedata.normalize("NFC", plain)
            for piece in self.pattern.findall(lowered(plain)):
                yield piece.encode()
            if m:
                yield self.specials[m[0]]
                at = m.end()

    def learn(self, pieces: Iterable[bytes]) -> None:
        """Remember the tokens of whole short pieces; the older generation goes when the newer is full."""
        if len(self.runs) >= REMEMBERED:
            self.runs_before, self.runs = self.runs, {}
        new = []
        for piece in pieces:
            if piece not in self.runs:
                got = self.runs_before.get(piece)
                if got is None:
                    new.append(piece)
                else:
                    self.runs[piece] = got
        for k in range(0, len(new), AT_ONCE):
            self.runs.update(zip(new[k : k + AT_ONCE], self.merge_all(new[k : k + AT_ONCE])))

    def run(self, piece: bytes, ends: bool = True) -> Sequence[int]:
        """Tokens of a piece, or of a part of one that goes on."""
        got = self.runs.get(piece) if ends else None
        if got is not None:
            return got
        symbols = list(map(self.inner.__getitem__, piece))
        if ends:
            symbols[-1] = self.last[symbols[-1]]
        return self.tree(symbols)

    def packed(self, tokens: list[int]) -> tuple[bytes, int, str]:
        """Ids as bytes, their number and the decoded text."""
        if tokens and max(tokens) >= self.known:
            tokens = [t for t in tokens if t < self.known]
        ids = array("I", tokens)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes(), len(ids), " ".join(map(self.names.__getitem__, tokens))

    def cut(self, word: str) -> list[bytes | int]:
        """The pieces of a word."""
        if word.isascii() and not self.special.search(word):
            return [p.encode() for p in self.pattern.findall(word.lower())]
        return list(self.pieces(word))

    def word_tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of distinct words, one after the other, and how many each has; unknown ones are left out."""
        cuts = list(map(self.cut, words))
        self.learn({p for cut in cuts for p in cut if not isinstance(p, int) and len(p) <= RUN})
        run, flat, sizes = self.run, array("q"), []
        for cut in cuts:
            before = len(flat)
            for piece in cut:
                if isinstance(piece, int):
                    flat.append(piece)
                else:
                    flat.extend(run(piece))
            sizes.append(len(flat) - before)
        found, count = np.frombuffer(flat, np.int64) if flat else np.zeros(0, np.int64), np.array(sizes, np.int64)
        known = found < self.known
        if not known.all():
            before = np.append(0, np.cumsum(known))
            ends = np.cumsum(count)
            found, count = found[known], before[ends] - before[ends - count]
        return found, count

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of texts, one after the other, and the place of each text's first one and of the end."""
        split = Tokens(texts, BLANKS)
        found, count = self.word_tokens(split.words.to_pylist())
        first = np.cumsum(count) - count
        size = count[split.ids]
        flat = np.repeat(first[split.ids] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return found[flat], np.append(0, np.cumsum(size))[split.firsts]

    def encode(self, texts: pa.Array) -> Iterator[tuple[bytes, int, pa.Buffer]]:
        """Ids as bytes, their number and the decoded text in UTF-8, of each text."""
        tokens, firsts = self.texts(texts)
        lists = pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), self.token_names.take(pa.array(tokens)))
        decoded = pc.binary_join(lists, " ").cast(pa.binary())
        ids = tokens.astype("<u4")
        for a, b, text in zip(firsts, firsts[1:], decoded):
            yield ids[a:b].tobytes(), int(b - a), text.as_buffer()


def lowered(text: str) -> str:
    """Lower case character by character, without regard to neighbours, which only sigma has."""
    return text.lower() if "\u03a3" not in text else "".join(map(str.lower, text))


LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path`` on this machine, read once per worker."""
    if path not in LOADED:
        LOADED[path] = Vocabulary(path)
    return LOADED[path]


def _digests(ids: bytes, decoded: bytes | pa.Buffer) -> tuple[str, str]:
    return hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _encoded(path: str, doc_type: pa.DataType):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in blocks(batches, 1):
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            rows = [(n, *_digests(ids, decoded)) for ids, n, decoded in v.encode(texts)]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode


def _leaves(path: str):
    """Cut long texts: leaves of whole words, and leaves that hold a part of one unsplit piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(k) for k in range(3))):
                out: list[tuple[bytes, bool, bool]] = []  # payload, is it a part of a piece, does it go on
                held: list[str] = []
                size = 0

                def flush() -> None:
                    nonlocal size
                    if held:
                        out.append((" ".join(held).encode(), False, False))
                    held.clear()
                    size = 0

                for m in WORD.finditer(text.as_py()):
                    word = m[0]
                    if len(word) <= PIECE:
                        held.append(word)
                        size += len(word) + 1
                        if size >= LEAF:
                            flush()
                        continue
                    flush()
                    for piece in v.pieces(word):
                        if isinstance(piece, int):
                            out.append((v.names[piece].encode(), False, False))
                        else:
                            out += [(piece[a : a + PIECE], True, a + PIECE < len(piece)) for a in range(0, len(piece), PIECE)]
                flush()
                n = len(out)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array([row.as_py()] * n, pa.int64()),
                        "doc_id": pa.array([doc_id.as_py()] * n, pa.int64()),
                        "leaf": pa.array(range(n), pa.int64()),
                        "payload": pa.array([x[0] for x in out], pa.binary()),
                        "part": pa.array([x[1] for x in out], pa.bool_()),
                        "goes_on": pa.array([x[2] for x in out], pa.bool_()),
                    }
                )

    return cut


def _leaf_tokens(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in blocks(batches, 3):
            whole = pc.if_else(batch.column(4), b"", batch.column(3)).cast(pa.string())
            tokens, firsts = v.texts(whole)
            done = []
            for k, (text, part, goes_on) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)))):
                own = np.array(v.run(text, not goes_on), np.int64) if part else tokens[firsts[k] : firsts[k + 1]]
                done.append(own.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(done, pa.binary()), *batch.columns[4:]], batch.schema.names)

    return encode


def _joined(path: str):
    """Join the leaves of one document: pairs of neighbours, round after round."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for doc_id, leaves in zip(batch.column(0), batch.column(1)):
                ordered = sorted(leaves.as_py(), key=lambda x: x["leaf"])
                parts = [(list(struct.unpack(f"<{len(x['payload']) // 4}I", x["payload"])), x["goes_on"]) for x in ordered]
                while len(parts) > 1:
                    pairs = []
                    for k in range(0, len(parts) - 1, 2):
                        (left, on), (right, after) = parts[k], parts[k + 1]
                        pairs.append((v.join(left, right) if on else left + right, after))
                    parts = pairs + parts[len(pairs) * 2 :]
                ids, n, decoded = v.packed(parts[0][0] if parts else [])
                got = (n, *_digests(ids, decoded.encode()))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([doc_id.as_py()], pa.int64()),
                        **{n: pa.array([x], t) for n, x, t in zip(("n_tokens", "ids_sha256", "decoded_sha256"), got, (pa.int64(), pa.string(), pa.string()))},
                    }
                )

    return join


def encoded(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; one row per input row.

    ``path`` names a tokenizer file that every machine has. Ids are hashed as little-endian unsigned
    32-bit numbers; the decoded text is the vocabulary's decoding of the ids, special tokens kept. Null
    texts count as empty. A null doc_id stays null, repeated rows are each encoded, other columns are
    ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    safe_unions(spark)
    rows = docs.select(C("doc_id").cast("bigint").alias("doc_id"), "text")
    size = F.coalesce(F.char_length("text"), F.lit(0))
    short = rows.filter(size <= leaf).mapInArrow(_encoded(path, pa.int64()), f"doc_id bigint, {SCHEMA}")
    row = fresh(rows, "row")
    long = rows.filter(size > leaf).select(F.monotonically_increasing_id().alias(row), "doc_id", "text")
    kinds = "row bigint, doc_id bigint, leaf bigint, payload binary, part boolean, goes_on boolean"
    leaves = long.mapInArrow(_leaves(path), kinds).repartition(parallelism(spark), "row", "leaf").mapInArrow(_leaf_tokens(path), kinds)
    gathered = leaves.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("leaf", "payload", "goes_on")).alias("leaves")
    )
    joined = gathered.select("doc_id", "leaves").mapInArrow(_joined(path), f"doc_id bigint, {SCHEMA}")
    return short.unionByName(joined)
