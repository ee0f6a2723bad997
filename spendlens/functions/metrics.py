"""Marketing ratios as Column expressions.

Two unit conventions exist and both are kept: the report queries give plain
ratios (``ctr`` = 0.0144), the scalar metric helpers give percent
(``ctr_pct`` = 1.44).  A zero, NULL or NaN denominator gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlens.functions.numeric import nan_to_null


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num, den) -> Column:
    """num / den as double; NULL for a zero / NULL / NaN operand."""
    n = nan_to_null(_c(num).cast("double"))
    d = nan_to_null(_c(den).cast("double"))
    return F.when(d != 0, F.try_divide(n, d))


def cpa(spend, conversions) -> Column:
    return safe_ratio(spend, conversions)


def roas(revenue, spend) -> Column:
    """Plain revenue / spend; zero spend -> NULL (no cap at this level)."""
    return safe_ratio(revenue, spend)


def ctr(clicks, impressions, percent: bool = True) -> Column:
    r = safe_ratio(clicks, impressions)
    return r * F.lit(100.0) if percent else r


def conversion_rate(conversions, clicks, percent: bool = True) -> Column:
    r = safe_ratio(conversions, clicks)
    return r * F.lit(100.0) if percent else r


def delta_pct(current, previous, percent: bool = True) -> Column:
    """(current - previous) / previous, signed denominator."""
    cur = nan_to_null(_c(current).cast("double"))
    prev = nan_to_null(_c(previous).cast("double"))
    r = F.when(prev != 0, F.try_divide(cur - prev, prev))
    return r * F.lit(100.0) if percent else r
