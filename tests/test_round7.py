"""Dates with parts at fixed places are cut and cast, with the values of the guarded arms."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from spendlens.functions.dates import clean_date_text, parse_dates, quick_dates


def test_quick_dates_equal_the_arms(spark):
    years, parts = ["2024", "0000", "95", "68", "1e3"], ["00", "01", "2", "09", "12", "13", "29", "30", "31", "32", "9T", "x1"]
    texts = [sep.join(t) for sep in ("-", "/", ".", "") for a, b in itertools.product(parts, parts)
             for y in years[:3] for t in ((y, a, b), (a, b, y))]
    texts += [f"{d}-{m}-{y}" for d in parts for m in ("Jan", "feb", "SEP", "Sept", "N01", "xyz", "ſep") for y in years]
    texts += ["2024-02-29", "2023-02-29", "2024-08-9\n", "2024-08-9T", "\t2024-8-09", "08/09-2024", "2024-08-09 10:11", "Aug 9, 2024",
              "+024-01-01", "2024-08-09T10:11:12", "INVALID", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(clean_date_text(F.col("t")).alias("s"))
    quick, arms = quick_dates(F.col("s")).cast("string"), parse_dates(F.col("s"), cleaned=True).cast("string")
    out = rows.select("s", quick.alias("quick"), arms.alias("arms")).collect()
    assert [r for r in out if r.quick != r.arms] == []
    assert sum(r.arms is not None for r in out) > 300
    assert [f.dataType.simpleString() for f in rows.select(quick_dates(F.col("s"))).schema] == ["timestamp_ntz"]


def test_names_before_numbers():
    from spendlens.functions import dates
    assert [dates._MONTHS[k:k + 5] for k in range(0, 60, 5)] == [
        f"{m}{k:02}" for k, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)]
