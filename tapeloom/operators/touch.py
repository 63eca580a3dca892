"""First bar of a path that touches a level, found through the extremes of blocks of bars.

Bars are cut into blocks of about the square root of the longest path, and every block keeps its
extremes. A path meets its blocks by equality on (ticker, range of blocks); of the blocks after its
first only the first that can touch is opened, together with the block it starts in. A path of 504
bars reads 23 blocks and some 40 bars, however many bars lie before the touch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import safe_unions

C = F.col


@dataclass(frozen=True)
class Touch:
    """A bar touches with a low or open at or below, or a high or open at or above, the levels that are given.

    A null level is never touched. ``entry_open`` tells whether the open of a path's first bar counts.
    """

    low: Column | None = None
    low_open: Column | None = None
    high: Column | None = None
    high_open: Column | None = None
    entry_open: bool = True

    def by(self, low: Column, open_low: Column, high: Column, open_high: Column, opens: Column | None = None) -> Column:
        tests = []
        if self.low is not None:
            tests.append(low <= self.low)
        if self.high is not None:
            tests.append(high >= self.high)
        for level, test in ((self.low_open, lambda x: open_low <= x), (self.high_open, lambda x: open_high >= x)):
            if level is not None:
                tests.append(test(level) if opens is None or self.entry_open else opens & test(level))
        return reduce(lambda a, b: a | b, tests)


def sizes(horizon: int) -> tuple[int, int]:
    """Bars of a block and blocks of a range for paths of up to ``horizon`` bars."""
    block = max(2, math.isqrt(horizon))
    return block, -(-horizon // block) + 1


def _blocks(bars: DataFrame, horizon: int) -> DataFrame:
    size, span = sizes(horizon)
    each = bars.groupBy("ticker", F.expr(f"i div {size}").alias("block")).agg(
        F.min("low").alias("k_low"),
        F.min("open").alias("k_open_low"),
        F.max("high").alias("k_high"),
        F.max("open").alias("k_open_high"),
    )
    return each.withColumn("range_", F.expr(f"block div {span}"))


def _bars(bars: DataFrame, horizon: int) -> DataFrame:
    size, _ = sizes(horizon)
    return bars.select("ticker", F.expr(f"i div {size}").alias("block"), *[C(c).alias(f"b_{c}") for c in ("i", "open", "high", "low")])


def _ahead(paths: DataFrame, bars: DataFrame, horizon: int, last: str = "last_ + 1") -> DataFrame:
    """Paths against the blocks after their first, up to their last."""
    _, span = sizes(horizon)
    ranges = F.expr(f"sequence((first_ + 1) div {span}, greatest(last_, first_ + 1) div {span})")
    spread = paths.withColumn("range_", F.explode(ranges))
    met = spread.join(_blocks(bars, horizon), ["ticker", "range_"])
    return met.filter((C("block") > C("first_")) & (C("block") < F.expr(last)))


def _placed(paths: DataFrame, horizon: int) -> DataFrame:
    size, _ = sizes(horizon)
    return paths.withColumns({"first_": F.expr(f"from_ div {size}"), "last_": F.expr(f"upto_ div {size}")})


def first_touches(paths: DataFrame, bars: DataFrame, touches: dict[str, Touch], keys: list[str], horizon: int) -> DataFrame:
    """Per path its ``keys`` and the position of the first touching bar of each of ``touches``, null if there is none.

    ``paths`` have unique ``keys`` (the ticker among them), the positions ``from_`` and ``upto_``, both
    included and at most ``horizon`` bars, and the columns that the levels are made of. ``bars`` have
    ticker, i, open, high and low. Paths without any bar give no row.
    """
    paths = _placed(paths, horizon)
    block = [C(c) for c in ("k_low", "k_open_low", "k_high", "k_open_high")]
    found = {name: f"at_{k}_" for k, name in enumerate(touches)}
    opening = _ahead(paths, bars, horizon).groupBy(*keys).agg(
        *[F.min(F.when(t.by(*block), C("block"))).alias(found[name]) for name, t in touches.items()]
    )
    wanted = F.array_distinct(F.array_compact(F.array("first_", *found.values())))
    opened = paths.join(opening, keys, "left").withColumn("block", F.explode(wanted)).drop(*found.values())
    met = opened.join(_bars(bars, horizon), ["ticker", "block"]).filter(C("b_i").between(C("from_"), C("upto_")))
    bar = [C(c) for c in ("b_low", "b_open", "b_high", "b_open")]
    later = C("b_i") > C("from_")
    return met.groupBy(*keys).agg(*[F.min(F.when(t.by(*bar, later), C("b_i"))).alias(name) for name, t in touches.items()])


def extremes(paths: DataFrame, bars: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Per path its ``keys`` with ``top`` and ``bottom``, the highest high and lowest low from ``from_`` to ``upto_``."""
    safe_unions(paths.sparkSession)
    paths = _placed(paths.select(*keys, "from_", "upto_"), horizon)
    whole = _ahead(paths, bars, horizon, "last_").select(*keys, C("k_high").alias("high"), C("k_low").alias("low"))
    edges = paths.withColumn("block", F.explode(F.array_distinct(F.array("first_", "last_")))).join(_bars(bars, horizon), ["ticker", "block"])
    edges = edges.filter(C("b_i").between(C("from_"), C("upto_"))).select(*keys, C("b_high").alias("high"), C("b_low").alias("low"))
    return whole.unionByName(edges).groupBy(*keys).agg(F.max("high").alias("top"), F.min("low").alias("bottom"))


def next_where(event: Column, own: bool = False) -> Column:
    """Position of the nearest later bar of the ticker where ``event`` holds; with ``own``, of this or a later bar."""
    backwards = Window.partitionBy("ticker").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    return F.last(F.when(event, C("i")), ignorenulls=True).over(backwards)
