"""Display labels computed in Spark (DecimalFormat rounds half-even on the
binary value, like Python's format specs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlens.schema import ROAS_LABEL_INFINITE_AT


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fmt(c: Column, pattern: str) -> Column:
    # format_number with a DecimalFormat pattern (no grouping separators)
    return F.format_number(c, 0) if pattern == "#,##0" else \
        F.call_function("format_number", c, F.lit(pattern))


def currency_label(c) -> Column:
    """$1,234 with grouping, no decimals; NULL/NaN -> N/A."""
    c = _c(c)
    return F.when(c.isNull() | F.isnan(c), F.lit("N/A")) \
        .otherwise(F.concat(F.lit("$"), F.format_number(c, 0)))


def money2_label(c) -> Column:
    """$1,234.56."""
    return F.concat(F.lit("$"), F.format_number(_c(c), 2))


def ratio_label(c) -> Column:
    """3.21x (two decimals, no grouping)."""
    return F.concat(_fmt(_c(c), "0.00"), F.lit("x"))


def roas_label(c) -> Column:
    """NULL/NaN or >= 9999 -> the infinity sign, else 3.21x."""
    c = _c(c)
    return F.when(c.isNull() | F.isnan(c) | (c >= F.lit(ROAS_LABEL_INFINITE_AT)),
                  F.lit("∞")).otherwise(ratio_label(c))


def delta_label(c) -> Column:
    """Ratio delta shown x100 with one decimal and an arrow; 0/NULL/NaN -> dash."""
    c = _c(c)
    txt = _fmt(F.abs(c) * F.lit(100.0), "0.0")
    return (F.when(c.isNull() | F.isnan(c) | (c == 0), F.lit("—"))
            .when(c > 0, F.concat(F.lit("▲ "), txt, F.lit("%")))
            .otherwise(F.concat(F.lit("▼ "), txt, F.lit("%"))))


def signed_pct_label(c) -> Column:
    """+39.1 / -5.0 (one decimal, explicit plus sign)."""
    c = _c(c)
    txt = _fmt(c, "0.0")
    return F.when(c >= 0, F.concat(F.lit("+"), txt)).otherwise(txt)


def title_label(c) -> Column:
    """google_ads -> Google Ads."""
    return F.initcap(F.regexp_replace(_c(c), "_", " "))
