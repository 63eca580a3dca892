"""Measures of value series keyed by ticker (or any key) and ordered by position."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tapeloom.functions import rolling as r


def drawdown(x: Column) -> Column:
    """Relative fall from the highest value so far."""
    return x / F.max(x).over(r.by_ticker().rowsBetween(Window.unboundedPreceding, 0)) - 1
