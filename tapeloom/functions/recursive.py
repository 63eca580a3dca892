"""Exponential smoothing with plain windows.

``e[0] = x[0]; e[i] = a * x[i] + (1 - a) * e[i - 1]`` is a linear recurrence. Rows are cut
into blocks; inside a block the smoothing is a running sum of rescaled inputs, and a block
starts from the end value carried over the blocks before it. A block has 512 rows, or
fewer for an alpha above 1/2, so that the rescaling factor stays below 2**512 and nothing
overflows; the whole computation shares one shuffle on the ticker.

A null input leaves the last value standing. The value after a gap of g rows weighs a against
(1 - a)**g for the old one, so the row's factors differ from the usual ones; the running sum of
the logarithms of what they differ by, zero without gaps, corrects the rescaling.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512


@dataclass(frozen=True)
class Smooth:
    """One smoothed column: the input expression, its alpha, and rows needed before a value shows."""

    x: Column
    alpha: float
    min_rows: int = 1


def span(x: Column, n: int, min_rows: int = 1) -> Smooth:
    return Smooth(x, 2.0 / (n + 1), min_rows)


def wilder(x: Column, n: int = 14, min_rows: int = 1) -> Smooth:
    return Smooth(x, 1.0 / n, min_rows)


def _block(columns: dict[str, Smooth]) -> int:
    steepest = max((s.alpha for s in columns.values() if s.alpha < 1), default=0.5)
    return max(1, min(BLOCK, int(BLOCK * math.log(2) / -math.log1p(-steepest) + 1e-9)))


def smooth(df: DataFrame, columns: dict[str, Smooth]) -> DataFrame:
    """Add smoothed columns. Nulls on leading rows are skipped; later ones repeat the value before them.

    The steps are written as SQL text, which keeps the driver's part of a wide call short.
    """
    if any(not 0 < s.alpha <= 1 for s in columns.values()):
        raise ValueError("alpha must be above 0 and at most 1")
    own = [c for c in df.columns if c not in columns]
    block = _block(columns)
    by_ticker = "partition by ticker order by i rows unbounded preceding"
    before = "partition by ticker order by i rows between unbounded preceding and 1 preceding"
    by_block = "partition by ticker, b_ order by i rows unbounded preceding"
    earlier = "partition by ticker order by b_ range between unbounded preceding and 1 preceding"
    plain = {k: s for k, s in columns.items() if s.alpha < 1}

    # Columns that smooth one input share it and what is known of its gaps.
    names: dict[str, str] = {}
    inputs = {k: names.setdefault(str(s.x), k) for k, s in columns.items()}
    place = {"b_": F.expr(f"i div {block}"), "p_": F.expr(f"i % {block}")}
    df = df.withColumns({f"x_{k}_": columns[k].x for k in set(inputs.values())} | place)
    seen = {f"n_{k}_": F.expr(f"count(x_{k}_) over ({by_ticker})") for k in set(inputs.values())}
    gaps = {f"g_{k}_": F.expr(f"i - last(if(x_{k}_ is null, null, i), true) over ({before})") for k in set(inputs.values())}
    df = df.withColumns(seen | gaps)

    def correction(k: str, s: Smooth) -> Column:
        """Logarithm of what the row's factor differs by from 1 - alpha, summed over the block so far."""
        x, g, keep = f"x_{inputs[k]}_", f"g_{inputs[k]}_", repr(1.0 - s.alpha)
        # After a very long gap nothing is left of the old value; e**-300 of it keeps the factor above zero.
        gap = f"greatest({g} * ln({keep}D), -300D) - ln(pow({keep}D, {g}) + {s.alpha!r}D) - ln({keep}D)"
        own_ = f"case when {g} is null then 0D when {x} is null then -ln({keep}D) when {g} = 1 then 0D else {gap} end"
        return F.expr(f"sum({own_}) over ({by_block})")

    def local(k: str, s: Smooth) -> Column:
        x, g, keep = f"x_{inputs[k]}_", f"g_{inputs[k]}_", repr(1.0 - s.alpha)
        # The first row that holds a value takes it whole.
        weight = f"case when {g} is null then 1D when {g} = 1 then {s.alpha!r}D else {s.alpha!r}D / (pow({keep}D, {g}) + {s.alpha!r}D) end"
        scaled = f"coalesce({weight} * {x}, 0D) * pow({keep}D, -p_) * exp(-c_{k}_)"
        return F.expr(f"sum({scaled}) over ({by_block}) * pow({keep}D, p_) * exp(c_{k}_)")

    def ends(k: str) -> Column:
        return F.expr(f"collect_list(if(p_ = {block - 1}, struct(l_{k}_ as l, exp(c_{k}_) as f), null)) over ({earlier})")

    def value(k: str, s: Smooth) -> Column:
        n = f"n_{inputs[k]}_"
        if s.alpha == 1:
            return F.expr(f"if({n} >= {s.min_rows}, last(x_{inputs[k]}_, true) over ({by_ticker}), null)")
        keep = 1.0 - s.alpha
        carry = f"aggregate(e_{k}_, 0D, (acc, x) -> acc * {keep**block!r}D * x.f + x.l)"
        return F.expr(f"if({n} >= {s.min_rows}, l_{k}_ + {carry} * pow({keep!r}D, p_ + 1) * exp(c_{k}_), null)")

    df = df.withColumns({f"c_{k}_": correction(k, s) for k, s in plain.items()})
    df = df.withColumns({f"l_{k}_": local(k, s) for k, s in plain.items()})
    df = df.withColumns({f"e_{k}_": ends(k) for k in plain})
    return df.select(*own, *[value(k, s).alias(k) for k, s in columns.items()])
