"""Sets of hashes as bitmaps of a bounded size: a test may say yes wrongly, never no."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import parallelism

C = F.col

#: Bits of the largest bitmap, 32 MB; beyond some 100 million members it says yes more often, and only costs time.
MOST_BITS = 28
#: Bits in a page of a bitmap.
PAGE = 1 << 16
#: A member sets the bit of its low bits and that of its halves swapped.
TURN = np.uint64(32)
ODD, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd constants that spread bits


def mixed(h: np.ndarray, more: np.ndarray | np.uint64 = np.uint64(0)) -> np.ndarray:
    """64-bit hashes of ``h`` followed by ``more``."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * ODD + more
        h = (h ^ (h >> np.uint64(29))) * SECOND
    return h ^ (h >> np.uint64(32))


class Marked:
    """The bitmap inside a task."""

    def __init__(self, sent: Broadcast) -> None:
        self.bits = np.frombuffer(sent.value, np.uint8)
        self.most = np.uint64(len(self.bits) * 8 - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        return self._bit(h) & self._bit(h >> TURN | h << TURN)

    def _bit(self, h: np.ndarray) -> np.ndarray:
        at = h & self.most
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of bits from slots that arrive sorted."""
    page, bits = -1, np.zeros(PAGE, np.uint8)

    def out() -> pa.RecordBatch:
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([packed], pa.binary())], ["page", "bits"])

    for batch in batches:
        slots = batch.column(0).to_numpy(zero_copy_only=False)
        for k in np.unique(slots // PAGE):
            if k != page:
                if page >= 0:
                    yield out()
                page, bits[:] = int(k), 0
            bits[slots[slots // PAGE == k] % PAGE] = 1
    if page >= 0:
        yield out()


def marked(hashes: DataFrame, members: int) -> Broadcast:
    """A bitmap of the one column of 64-bit ``hashes``, sent to every executor.

    It has 32 bits a member, 2 ** ``MOST_BITS`` at most, and is put together in pages by tasks; the
    driver joins its pages. An empty table marks nothing.
    """
    size = 1 << min(MOST_BITS, max(16, (32 * members).bit_length()))
    h = C(hashes.columns[0])
    both = F.array(h, F.shiftrightunsigned(h, int(TURN)).bitwiseOR(F.shiftleft(h, int(TURN))))
    slots = hashes.select(F.explode(both).alias("h")).select(C("h").bitwiseAND(size - 1).alias("slot")).distinct()
    parts = min(parallelism(hashes.sparkSession), max(1, size // PAGE))
    pages = slots.repartition(parts, F.floor(C("slot") / PAGE)).sortWithinPartitions("slot").mapInArrow(_pages, "page bigint, bits binary")
    whole = bytearray(size // 8)
    for page, bits in pages.collect():
        whole[page * PAGE // 8 : (page + 1) * PAGE // 8] = bits
    return hashes.sparkSession.sparkContext.broadcast(bytes(whole))
