"""Rolling column functions over one ticker's bars, ordered by position ``i``.

Every function gives a Column; put several in one ``select`` and Spark runs them in a
single pass, since they share partitioning and order.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("i")


def last_rows(n: int, skip: int = 0) -> WindowSpec:
    """The ``n`` rows ending ``skip`` rows before the current one."""
    return by_ticker().rowsBetween(-(n - 1) - skip, -skip)


def _full(x: Column, n: int, value: Column, skip: int = 0) -> Column:
    return F.when(F.count(x).over(last_rows(n, skip)) >= n, value)


def sma(x: Column, n: int) -> Column:
    return _full(x, n, F.avg(x).over(last_rows(n)))


def rolling_max(x: Column, n: int, skip: int = 0) -> Column:
    return _full(x, n, F.max(x).over(last_rows(n, skip)), skip)


def rolling_min(x: Column, n: int, skip: int = 0) -> Column:
    return _full(x, n, F.min(x).over(last_rows(n, skip)), skip)


def rolling_median(x: Column, n: int, least: int | None = None) -> Column:
    """Median of the values among the last ``n`` rows, null with fewer than ``least`` (all, if not given).

    The frame is one array of values, sorted as primitives; its middle is read off.
    """
    frame = F.sort_array(F.collect_list(x).over(last_rows(n)))
    size = F.count(x).over(last_rows(n))
    low, high = F.get(frame, ((size - 1) / 2).cast("int")), F.get(frame, (size / 2).cast("int"))
    return F.when(size >= (n if least is None else least), low + (high - low) * 0.5)


def prev(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_ticker())


def change(x: Column, n: int) -> Column:
    """Relative change against the value ``n`` rows back."""
    return x / prev(x, n) - 1


def true_range() -> Column:
    """Greatest of the three ranges; the first row has only high - low."""
    before = prev(F.col("close"))
    return F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - before),
        F.abs(F.col("low") - before),
    )


def gain_loss() -> tuple[Column, Column]:
    """Up and down moves of the close, both >= 0; null on the first row."""
    move = F.col("close") - prev(F.col("close"))
    zero = F.lit(0.0)
    known = move.isNotNull()
    return F.when(known, F.greatest(move, zero)), F.when(known, F.greatest(-move, zero))


def rows_from_end() -> Column:
    """1 on the last bar of a ticker, 2 on the one before, and so on."""
    return F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("i")))


def bars_count() -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy("ticker"))
