"""Flexible date parsing and week buckets without a per-value parser.

Each accepted layout is one guarded arm: a regular expression decides whether
the pattern may be tried, ``try_to_timestamp`` parses it, and the first arm
that yields a value wins.  Failures and impossible dates give NULL.  Guards are tried
only on texts that hold their layout's separator.

``quick_dates`` cuts and casts texts whose parts stand at fixed places, and leaves
the rest to the arms.

Two-digit years use a fixed window (69-99 -> 19xx, 00-68 -> 20xx) instead of
one that moves with the clock, so a re-run gives the same dates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: ordered (guard, Spark pattern, strptime pattern) arms.
# Month-first before day-first for slashed dates, so 08/09/2024 is 9 August
# and 13/08/2024 is 13 August.  Arms ending in a 2-digit year are listed
# with their 4-digit pattern; the year is widened before parsing.
_MO = r"(0?[1-9]|1[0-2])"          # month 1-12
_DY = r"(0?[1-9]|[12]\d|3[01])"    # day 1-31
_MN = r"[A-Za-z]{3}"

DATE_ARMS: list[tuple[str, str, str]] = [
    (rf"^\d{{4}}-{_MO}-{_DY}$", "yyyy-M-d", "%Y-%m-%d"),
    (rf"^\d{{4}}-{_MO}-{_DY} \d{{1,2}}:\d{{2}}:\d{{2}}$", "yyyy-M-d H:mm:ss", "%Y-%m-%d %H:%M:%S"),
    (rf"^\d{{4}}-{_MO}-{_DY} \d{{1,2}}:\d{{2}}$", "yyyy-M-d H:mm", "%Y-%m-%d %H:%M"),
    (rf"^\d{{4}}/{_MO}/{_DY}$", "yyyy/M/d", "%Y/%m/%d"),
    (rf"^{_DY}-{_MN}-\d{{4}}$", "d-MMM-yyyy", "%d-%b-%Y"),
    (rf"^{_MO}/{_DY}/\d{{4}}$", "M/d/yyyy", "%m/%d/%Y"),
    (rf"^{_DY}/{_MO}/\d{{4}}$", "d/M/yyyy", "%d/%m/%Y"),
    (rf"^[A-Za-z]{{4,9}} {_DY}, \d{{4}}$", "MMMM d, yyyy", "%B %d, %Y"),
    (rf"^{_MN} {_DY}, \d{{4}}$", "MMM d, yyyy", "%b %d, %Y"),
    (rf"^{_DY} {_MN} \d{{4}}$", "d MMM yyyy", "%d %b %Y"),
    (rf"^{_MN} {_DY} \d{{4}}$", "MMM d yyyy", "%b %d %Y"),
    (rf"^{_DY} [A-Za-z]{{4,9}} \d{{4}}$", "d MMMM yyyy", "%d %B %Y"),
    (rf"^{_MO}\.{_DY}\.\d{{4}}$", "M.d.yyyy", "%m.%d.%Y"),
    (rf"^{_DY}\.{_MO}\.\d{{4}}$", "d.M.yyyy", "%d.%m.%Y"),
    (rf"^\d{{4}}\.{_MO}\.{_DY}$", "yyyy.M.d", "%Y.%m.%d"),
    (rf"^{_MO}-{_DY}-\d{{4}}$", "M-d-yyyy", "%m-%d-%Y"),
    (rf"^{_DY}-{_MO}-\d{{4}}$", "d-M-yyyy", "%d-%m-%Y"),
    (rf"^{_MO}/{_DY}/\d{{4}} \d{{1,2}}:\d{{2}}$", "M/d/yyyy H:mm", "%m/%d/%Y %H:%M"),
    (rf"^{_MO}/{_DY}/\d{{4}} (0?[1-9]|1[0-2]):\d{{2}}:\d{{2}} [AP]M$", "M/d/yyyy h:mm:ss a", "%m/%d/%Y %I:%M:%S %p"),
    (rf"^\d{{4}}-{_MO}-{_DY} (0?[1-9]|1[0-2]):\d{{2}} [AP]M$", "yyyy-M-d h:mm a", "%Y-%m-%d %I:%M %p"),
    (rf"^{_DY}-{_MN}-\d{{4}} \d{{1,2}}:\d{{2}}$", "d-MMM-yyyy H:mm", "%d-%b-%Y %H:%M"),
    (r"^\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$", "yyyyMMdd", "%Y%m%d"),
]
# FIXED VALUES: layouts with a trailing 2-digit year, widened to 4 digits.
SHORT_YEAR_ARMS: list[tuple[str, str, str]] = [
    (rf"^{_DY}-{_MN}-\d{{2}}$", "d-MMM-yyyy", "%d-%b-%Y"),
    (rf"^{_MO}/{_DY}/\d{{2}}$", "M/d/yyyy", "%m/%d/%Y"),
    (rf"^{_DY}/{_MO}/\d{{2}}$", "d/M/yyyy", "%d/%m/%Y"),
]
SHORT_YEAR_PIVOT = 69


def clean_date_text(c: Column) -> Column:
    """Trim and turn an ISO 'T' separator into a blank."""
    t = F.trim(c.cast("string"))
    return F.when(F.contains(t, F.lit("T")), F.regexp_replace(t, r"^(\d{4}-\d{1,2}-\d{1,2})T", "$1 ")).otherwise(t)


def _guard(s: Column, rx: str, fmt: str) -> Column:
    """Whether a layout may be tried: a cheap look for its separator comes before the expression."""
    sep = next((x for x in "/-. " if x in fmt), "")
    return F.contains(s, F.lit(sep)) & s.rlike(rx) if sep else s.rlike(rx)


def widen_year(s: Column) -> Column:
    """'23-Aug-95' -> '23-Aug-1995' (69-99 -> 19xx, 00-68 -> 20xx)."""
    yy = F.substring(s, -2, 2)
    century = F.when(yy.cast("int") >= SHORT_YEAR_PIVOT, F.lit("19")).otherwise(F.lit("20"))
    return F.concat(F.regexp_replace(s, r"\d{2}$", ""), century, yy)


def parse_dates(c, cleaned: bool = False) -> Column:
    """Text -> timestamp_ntz (wall clock, no zone); NULL when no arm parses.

    The text is referenced by every arm; pass a column that is already
    ``clean_date_text`` output (``cleaned=True``), computed in an earlier
    projection, so it is evaluated once per row, not once per arm.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = c if cleaned else clean_date_text(c)
    arms = [F.when(_guard(s, rx, fmt), F.try_to_timestamp(s, F.lit(fmt)))
            for rx, fmt, _ in DATE_ARMS]
    arms += [F.when(_guard(s, rx, fmt), F.try_to_timestamp(widen_year(s), F.lit(fmt)))
             for rx, fmt, _ in SHORT_YEAR_ARMS]
    return F.coalesce(*arms).cast("timestamp_ntz")


# FIXED VALUES: short month names, each before its number.
_MONTHS = "JAN01FEB02MAR03APR04MAY05JUN06JUL07AUG08SEP09OCT10NOV11DEC12"
_TWO_DIGITS = [f"{k:02}" for k in range(1, 32)]


def quick_dates(s: Column) -> Column:
    """``parse_dates`` of cleaned text, at a fraction of the cost for two-digit days and months.

    Length and separators tell the layout; a branch's texts match no arms but those of its
    layout, so a NULL there is final.  In turn: year first; month before day unless the first
    part is no month; day, short month name, year of four or two digits; yyyyMMdd.  Only texts whose
    month and day are in range are cast: ``try_cast`` throws and catches an exception for each text it refuses.
    """
    def part(at: int, n: int) -> Column:
        return F.substring(s, at, n)

    def digit(at: int) -> Column:
        return part(at, 1).between("0", "9")

    def separated(a: int, b: int) -> Column:
        return (part(a, 1) == part(b, 1)) & part(a, 1).isin("/", "-", ".")

    def day(year: Column, month: Column, at: int, known: Column) -> Column:
        return F.when(known & part(at, 2).isin(_TWO_DIGITS), F.concat_ws("-", year, month, part(at, 2)).try_cast("date")).cast("timestamp_ntz")

    def numbered(year: int, month: int, at: int) -> Column:
        return day(part(year, 4), part(month, 2), at, part(month, 2).isin(_TWO_DIGITS[:12]))

    def named(year: Column) -> Column:  # text after no aligned name begins with no digit or ends in a letter
        month = F.substring(F.lit(_MONTHS), F.instr(F.lit(_MONTHS), F.upper(part(4, 3))) + F.lit(3), F.lit(2))
        return day(year, month, 1, month < ":")

    n, yy = F.octet_length(s), part(8, 2)
    dashed = (part(3, 1) == "-") & (part(7, 1) == "-")
    late = F.concat(F.when(yy >= str(SHORT_YEAR_PIVOT), F.lit("19")).otherwise(F.lit("20")), yy)
    return (
        F.when((n == 10) & separated(5, 8), numbered(1, 6, 9))
        .when((n == 10) & separated(3, 6), F.when(part(1, 2) <= "12", numbered(7, 1, 4)).otherwise(numbered(7, 4, 1)))
        .when((n == 11) & dashed, named(part(8, 4)))
        .when((n == 9) & dashed, named(late))
        .when((n == 8) & digit(2) & digit(3) & digit(5) & digit(6), numbered(1, 5, 7))
        .otherwise(parse_dates(s, cleaned=True)))


def week_start(c) -> Column:
    """Monday 00:00 of the week holding ``c`` as timestamp_ntz.  Computed on
    the calendar date, so it does not depend on the session time zone."""
    c = F.col(c) if isinstance(c, str) else c
    d = F.to_date(c)
    return F.date_sub(d, F.pmod(F.dayofweek(d) + F.lit(5), F.lit(7))) \
        .cast("timestamp_ntz")
