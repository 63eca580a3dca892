"""Collocations by prefix-free parsing: texts become overlapping chunks, and phrases are counted in distinct chunks.

A chunk starts where a window of ``LAP`` tokens hashes to zero and runs to the end of the window that
starts the next one, so neighbours overlap by ``LAP`` tokens and equal passages give equal chunks
wherever they stand. Distinct chunks form the dictionary, with their frequency in the parse. A phrase
counts where it starts before a chunk's last ``LAP`` tokens, which are the next chunk's; the last chunk
of a text ends with ``LAP`` breaks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import kept, safe_unions
from tapeloom.llm.marked import Marked, marked, mixed

C = F.col

#: Words of the longest phrase; chunks overlap by one less.
LONGEST = 4
LAP = LONGEST - 1
#: One window in so many starts a chunk.
EVERY = 32
#: Bytes of text handled at once inside a task.
BLOCK = 1 << 21
#: Hash of a break between pieces, and the base of the words' polynomials.
BREAK, BASE = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD6E8FEB86659FD93)

BYTES = np.arange(256, dtype=np.uint8)
BYTES[ord("A") : ord("Z") + 1] += 32
BYTES[ord("\t")] = 32
BYTES[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 255  # never a byte of UTF-8


class Tokens:
    """Words and breaks of some texts: ``ids`` (place in ``words``, or -1 for a break) and the first token of each text.

    ``table`` gives each byte of UTF-8 as it is read: 32 parts words, 255 is a break.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray = BYTES, every_break: bool = False) -> None:
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        data = table[data]
        breaks = data == 255
        inside = ~breaks & (data != 32)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = offsets[:-1][offsets[:-1] < len(data)]
        first[starts] |= inside[starts]  # a text's first word does not go on from the text before
        at = np.flatnonzero(first | breaks)
        is_break = breaks[at]
        if not every_break and len(at):
            again = is_break.copy()
            again[1:] &= is_break[:-1]
            again[0] = False
            at, is_break = at[~again], is_break[~again]
        packed = data[inside]
        place = np.cumsum(inside, dtype=np.int64) - inside
        spots = np.append(place[at[~is_break]], len(packed)).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(spots) - 1, [None, pa.py_buffer(spots.tobytes()), pa.py_buffer(packed.tobytes())])
        coded = words.dictionary_encode()
        self.words: pa.Array = coded.dictionary
        self.ids = np.full(len(at), -1, np.int64)
        self.ids[~is_break] = coded.indices.to_numpy(zero_copy_only=False)
        self.firsts = np.searchsorted(at, offsets)

    def hashes(self) -> np.ndarray:
        """A hash of every word, then that of a break."""
        return np.append(hashed(self.words), BREAK)


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit hashes of texts: polynomials of their bytes, mixed with their lengths."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    sizes = np.diff(offsets)
    if not sizes.sum():
        return mixed(np.zeros(len(words), np.uint64))
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    full = np.flatnonzero(sizes)
    place = np.arange(len(data)) - np.repeat(offsets[full] - offsets[0], sizes[full])
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()), BASE), dtype=np.uint64)
        found = np.zeros(len(words), np.uint64)
        found[full] = np.add.reduceat((data + np.uint64(1)) * powers[place], offsets[full] - offsets[0], dtype=np.uint64)
    return mixed(found, sizes.astype(np.uint64))


def blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows in portions of about ``BLOCK`` bytes of text; a longer text is a portion of its own."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at, done = 0, 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(sizes, done + BLOCK, side="right")))
            yield batch.slice(at, end - at)
            at, done = end, sizes[end - 1]


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, 1):
        tokens = Tokens(batch.column(1))
        count = np.diff(tokens.firsts)
        full = np.flatnonzero(count)
        if not len(full):
            continue
        of = np.repeat(np.arange(len(full)), count[full])
        ids = np.full(len(tokens.ids) + LAP * len(full), -1, np.int64)
        ids[np.arange(len(tokens.ids)) + LAP * of] = tokens.ids
        ends = np.cumsum(count[full] + LAP)  # behind a text's last break
        starts = ends - count[full] - LAP
        h = tokens.hashes()[ids]
        window = np.zeros(len(ids), np.uint64)
        for k in range(LAP):
            window[: len(ids) - k] = mixed(window[: len(ids) - k], h[k:])
        opens = window % np.uint64(EVERY) == 0
        for k in range(LAP):
            opens[ends - 1 - k] = False
        opens[starts] = True
        begin = np.flatnonzero(opens)
        text = np.searchsorted(starts, begin, side="right") - 1
        stop = np.minimum(np.append(begin[1:], len(ids)) + LAP, ends[text])
        size = stop - begin
        flat = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        words = pa.concat_arrays([tokens.words, pa.array(["\n"])])
        spots = pa.array(np.append(0, np.cumsum(size)), pa.int32())
        lists = pa.ListArray.from_arrays(spots, words.take(pa.array(ids[flat] % len(words))))
        langs = batch.column(0).take(pa.array(full[text]))
        yield pa.RecordBatch.from_arrays([langs, pc.binary_join(lists, " ")], ["lang", "chunk"])


def dictionary(docs: DataFrame) -> DataFrame:
    """lang, chunk, times: the distinct chunks of all texts and how often the parse uses each."""
    rows = docs.select(F.coalesce(C("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(C("text").cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(_chunked, "lang string, chunk string")
    return kept(found.groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("times")), "chunks")


def _counter(sizes: tuple[int, ...], sent: Broadcast | None) -> Callable:
    """Counts phrases of ``sizes`` words whose parts are all marked: words of pairs, pairs of longer phrases."""

    def out(langs: pa.Array, phrases: pa.Array, size: int, total: np.ndarray) -> pa.RecordBatch:
        columns = [langs, phrases, pa.array(np.full(len(total), size, np.int32)), pa.array(total.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "size", "a"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Marked(sent) if sent is not None else None
        for batch in blocks(batches, 1):
            tokens = Tokens(batch.column(1), every_break=True)
            if not len(tokens.ids):
                continue
            langs = batch.column(0).dictionary_encode()
            per_chunk = np.diff(tokens.firsts)
            chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[chunk]
            times = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)[chunk]
            starts = (tokens.ids >= 0) & (np.arange(len(tokens.ids)) < (tokens.firsts[1:] - LAP)[chunk])
            at = np.flatnonzero(starts)
            good = None  # of every token: whether the part that starts there is marked
            if known is not None:
                h = tokens.hashes()[tokens.ids]
                part = mixed(hashed(langs.dictionary)[lang], h)
                if min(sizes) > 2:
                    part[:-1] = mixed(part[:-1], h[1:])
                good = known.has(part)
                at = at[good[at]]
            key, words, span = None, len(tokens.words), len(langs.dictionary)
            for n in range(1, max(sizes) + 1):
                if n > 1:
                    ok = tokens.ids[at + n - 1] >= 0
                    # Words of pairs, and pairs of longer phrases, are marked one after the other.
                    if good is not None and (n > 2 or min(sizes) == 2):
                        step = n - 1 if min(sizes) == 2 else n - 2
                        ok &= good[at + step]
                    at, key = at[ok], key[ok]
                key = lang[at] if key is None else key
                if span * words >= 1 << 62:  # keys are numbered anew, so that they never outgrow 64 bits
                    key, span = np.unique(key, return_inverse=True)[1], len(key)
                key, span = key * words + tokens.ids[at + n - 1], span * words
                if n == 1 and n in sizes:  # few keys: counted in place
                    total = np.bincount(key, times[at])
                    seen = np.flatnonzero(total)
                    yield out(langs.dictionary.take(pa.array(seen // words)), tokens.words.take(pa.array(seen % words)), n, total[seen])
                if n not in sizes or n == 1 or not len(key):
                    continue
                _, rows, key = np.unique(key, return_index=True, return_inverse=True)
                span = len(rows)
                parts = [tokens.words.take(pa.array(tokens.ids[at[rows] + k])) for k in range(n)]
                phrase = pc.binary_join_element_wise(*parts, " ")
                yield out(langs.dictionary.take(pa.array(lang[at[rows]])), phrase, n, np.bincount(key, times[at]))

    return count


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same hash of a language and its phrase as ``_counter`` has."""
    for batch in batches:
        if not batch.num_rows:
            continue
        words = pc.split_pattern(batch.column(1), " ")
        size = len(words.values) // len(words)  # all phrases have as many words
        table = hashed(words.flatten()).reshape(-1, size)
        h = hashed(batch.column(0))
        for k in range(size):
            h = mixed(h, table[:, k])
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])


def _mark(phrases: DataFrame) -> Broadcast:
    """Bitmap of phrases of one length."""
    return marked(phrases.select("lang", "phrase").mapInArrow(_hashes, "h bigint"), phrases.count())


def counts(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of the phrases of 1 to ``LONGEST`` words found ``least`` times or more, and (lang, n), all words.

    A phrase can be that frequent only if its parts are: pairs are counted where both words are
    marked in a bitmap of the frequent words, longer phrases where all their pairs are.
    """
    chunks = dictionary(docs)

    def level(sizes: tuple[int, ...], sent: Broadcast | None) -> DataFrame:
        found = chunks.mapInArrow(_counter(sizes, sent), "lang string, phrase string, size int, a bigint")
        return found.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a"))

    words = kept(level((1,), None), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    one = words.filter(C("a") >= least)
    two = kept(level((2,), _mark(one)).filter(C("a") >= least), "pairs")
    more = kept(level(tuple(range(3, LONGEST + 1)), _mark(two)).filter(C("a") >= least), "phrases")
    return one.unionByName(two).unionByName(more), totals


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``first`` phrases of two words or more.

    A phrase's score is the least of floor(2000000 * a / (l + r)) over its cuts in two, with l and r the
    counts of the parts (ties to the shorter first part); phrases of which a longer frequent one covers
    ``covered`` percent are dropped. Null texts count as empty, a null lang as ``und``; repeated rows
    count each; equal scores are ordered by count, then by the phrase's bytes; other columns are
    ignored; an empty table, or one without frequent phrases, gives an empty result.
    """
    safe_unions(docs.sparkSession)
    found, totals = counts(docs, least)
    found = kept(found, "frequent")
    some = found.filter(C("size") > 1).withColumn("words", F.split("phrase", " "))
    cuts = some.select("lang", "phrase", "words", "size", "a", F.explode(F.sequence(F.lit(1), C("size") - 1)).alias("k")).select(
        "lang",
        "phrase",
        "size",
        "a",
        "k",
        F.array_join(F.slice("words", 1, C("k")), " ").alias("head"),
        F.array_join(F.slice("words", C("k") + 1, C("size") - C("k")), " ").alias("tail"),
    )
    heads = found.select("lang", C("phrase").alias("head"), C("a").alias("l"))
    tails = found.select("lang", C("phrase").alias("tail"), C("a").alias("r"))
    # Decimals: the product may pass 64 bits.
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div cast(l + r as decimal(19, 0))")
    scored = (
        cuts.join(heads, ["lang", "head"])
        .join(tails, ["lang", "tail"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    )
    sizes = F.explode(F.sequence(F.lit(2), C("size") - 1)).alias("n")
    inner = some.filter(C("size") > 2).select("lang", "words", "size", "a", sizes)
    inner = inner.select("lang", "words", "a", "n", F.explode(F.sequence(F.lit(1), C("size") - C("n") + 1)).alias("k"))
    inside = inner.groupBy("lang", F.array_join(F.slice("words", C("k"), C("n")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").filter(C("longer").isNull() | (100 * C("longer") < covered * C("a")))
    order = Window.partitionBy("lang").orderBy(C("cut.score").desc(), C("a").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(C("rank") <= first)
    long = [C(f"cut.{x}").cast("bigint").alias(x) for x in ("l", "r")]
    return ranked.join(totals, "lang").select("lang", C("rank").cast("bigint").alias("rank"), "phrase", "a", *long, "n", C("cut.score").alias("score"))


PHRASE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (
  SELECT lang, list_filter(regexp_split_to_array(x, '[\x20\x09]+'), lambda w: w <> '') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
f AS (
  SELECT lang, size, phrase, count(*) AS a
  FROM (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
        FROM p, (VALUES (1), (2), (3), (4)) AS s(size))
  GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
cuts AS (
  SELECT lang, phrase, size, a, ws, unnest(range(1, size)) AS k FROM c),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * cuts.a // (l.a + r.a) AS BIGINT) AS score
  FROM cuts
  JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(ws[1:k], ' ')
  JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(ws[k + 1:cuts.size], ' ')),
least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, a, ws, n, unnest(range(1, size - n + 2)) AS i
  FROM (SELECT lang, a, ws, size, unnest(range(2, size)) AS n FROM c)),
inside AS (
  SELECT lang, array_to_string(ws[i:i + n - 1], ' ') AS phrase, max(a) AS longer FROM parts GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (
  SELECT s.lang, s.phrase, s.a, s.l, s.r, s.score, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM least s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 80 * s.a)
JOIN totals USING (lang)
WHERE rank <= 2000
"""
