import datetime as dt

from pyspark.sql import functions as F

from spendlens.functions import (coerce_numeric, currency_label, delta_label,
                                 parse_dates, roas_label, round_money, to_count)
from spendlens.functions import metrics as M


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("r")).first().r


def test_coerce_numeric_tokens(spark):
    cases = {"": 0.0, "n/a": 0.0, "nan": 0.0, "1,234": 0.0, "$5": 0.0, "12d": 0.0,
             " 12 ": 12.0, "1e3": 1000.0, "-3": -3.0, "10.7": 10.7, "NULL": 0.0, None: 0.0}
    for raw, want in cases.items():
        assert one(spark, coerce_numeric, raw) == want, raw
    assert one(spark, coerce_numeric, "inf") == float("inf")


def test_counts_truncate_and_infinity_is_null(spark):
    assert one(spark, lambda c: to_count(coerce_numeric(c)), "10.7") == 10
    assert one(spark, lambda c: to_count(coerce_numeric(c)), "-10.7") == -10
    assert one(spark, lambda c: to_count(coerce_numeric(c)), "inf") is None


def test_round_money_half_even_on_binary(spark):
    # 0.575 is 0.57499999... in binary: numpy-style rounding gives 0.57
    assert one(spark, round_money, 0.575, "double") == 0.57
    assert one(spark, round_money, 0.125, "double") == 0.12
    # 2.675 * 100 is exactly 267.5 in binary: half-even on the product -> 2.68,
    # the same as numpy.round(2.675, 2)
    import numpy as np
    assert one(spark, round_money, 2.675, "double") == float(np.round(2.675, 2)) == 2.68


def test_parse_dates_layouts(spark):
    d = lambda y, m, day: dt.datetime(y, m, day)
    cases = {
        "2024-08-23": d(2024, 8, 23), "2024/08/23": d(2024, 8, 23), "23-Aug-2024": d(2024, 8, 23),
        "23-Aug-24": d(2024, 8, 23), "23-Aug-95": d(1995, 8, 23), "08/09/2024": d(2024, 8, 9),
        "13/08/2024": d(2024, 8, 13), "20240823": d(2024, 8, 23), "August 23, 2024": d(2024, 8, 23),
        "2024-08-23T10:30:00": dt.datetime(2024, 8, 23, 10, 30),
        "0000-00-00": None, "32/13/2024": None, "INVALID": None, "2024-02-30": None, None: None,
    }
    for raw, want in cases.items():
        assert one(spark, parse_dates, raw) == want, raw


def test_metrics_percent_and_null_denominators(spark):
    df = spark.createDataFrame([(10.0, 0, 5, 0, 200.0, 100.0)],
                               "s double, c long, cl long, im long, cur double, prev double")
    r = df.select(M.cpa("s", "c").alias("cpa"), M.ctr("cl", "im").alias("ctr"),
                  M.roas("cur", "s").alias("roas"), M.delta_pct("cur", "prev").alias("d")).first()
    assert r.cpa is None and r.ctr is None
    assert r.roas == 20.0 and r.d == 100.0


def test_labels(spark):
    assert one(spark, currency_label, 1234.5, "double") == "$1,234"
    assert one(spark, currency_label, None, "double") == "N/A"
    assert one(spark, roas_label, None, "double") == "∞"
    assert one(spark, roas_label, 9999.99, "double") == "∞"
    assert one(spark, roas_label, 3.14159, "double") == "3.14x"
    assert one(spark, delta_label, 0.0, "double") == "—"
    assert one(spark, delta_label, 0.1234, "double") == "▲ 12.3%"
    assert one(spark, delta_label, -0.05, "double") == "▼ 5.0%"
