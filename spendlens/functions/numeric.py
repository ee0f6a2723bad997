"""Numeric coercion of raw text and money rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlens.schema import NA_TOKENS

# A plain decimal / scientific number with optional sign and surrounding
# blanks, or an infinity.  Guards try_cast, which alone would also accept
# Java-style suffixes such as "12d".
NUMBER_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# FIXED VALUES: spellings of infinity the reader accepts.
INF_TOKENS = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_na_token(c) -> Column:
    """True where the text is one of the reader's missing-value tokens."""
    c = _c(c)
    return c.isNull() | c.isin(NA_TOKENS)


def nan_to_null(c) -> Column:
    """NaN -> NULL so that comparisons and ranks treat it as missing."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def parse_number(c) -> Column:
    """Text -> double; anything unparseable, missing or NaN -> NULL (none of the missing-value
    tokens or spellings of NaN is a number or infinity to the guards)."""
    c = _c(c).cast("string")
    return F.when(c.rlike(NUMBER_RE) | F.lower(F.trim(c)).isin(INF_TOKENS), c.try_cast("double"))


def coerce_numeric(c) -> Column:
    """Text -> double; anything unparseable, missing or NaN -> 0.0."""
    return F.coalesce(parse_number(c), F.lit(0.0))


def to_count(c) -> Column:
    """double -> bigint truncating toward zero; infinities / overflow -> NULL
    (the row then fails the non-negative count rule)."""
    return _c(c).try_cast("bigint")


def round_money(c) -> Column:
    """Round to cents half-to-even on the binary value (``rint``), which is
    what NumPy's round does; ``round``/``bround`` would round 0.575 up."""
    return F.rint(_c(c) * F.lit(100.0)) / F.lit(100.0)


def to_cents(c) -> Column:
    """Money (2-decimal double) -> exact integer cents.  Sums of cents are
    exact and order-independent, unlike float sums across shuffles."""
    return F.rint(_c(c) * F.lit(100.0)).cast("bigint")


def round_to(c, digits: int) -> Column:
    """Half-even rounding to ``digits`` decimals on the binary value."""
    scale = float(10 ** digits)
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)
