"""Date layouts against stated values, odd file names, ranks without exchange reuse, strict reads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendlens.functions.dates import parse_dates
from spendlens.operators import scoring
from spendlens.sources.exports import read_exports
from spendlens.streaming.ingest import IngestPaths, read_ingested

DAY, TEN = dt.datetime(2024, 8, 23), dt.datetime(2024, 8, 23, 10)
LAYOUTS = {"23 Aug 2024": DAY, "Aug 23 2024": DAY, "23 August 2024": DAY, "23.08.2024": DAY, "2024.08.23": DAY, "08-23-2024": DAY,
           "23-08-2024": DAY, "8/23/2024 10:00": TEN, "8/23/2024 12:00:00 AM": DAY, "2024-08-23 10:00 AM": TEN, "23-Aug-2024 10:00": TEN,
           "2024-08-23T10:00:00": TEN, "08/09/2024": dt.datetime(2024, 8, 9), "13/08/2024": dt.datetime(2024, 8, 13), "32.08.2024": None, "": None}


def test_date_layouts(spark):
    rows = spark.createDataFrame([(k,) for k in LAYOUTS], "t string").select("t", parse_dates("t").alias("d")).collect()
    assert {r.t: r.d for r in rows} == LAYOUTS


def test_rank_does_not_rest_on_exchange_reuse(spark):
    old = spark.conf.get("spark.sql.exchange.reuse", "true")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(40000).select("id", ((F.col("id") * 7919) % 9973).cast("double").alias("v"))
        got = scoring.pct_rank_avg(df, "v", "p", parts=8).select("id", "p").toPandas().set_index("id")["p"].sort_index()
        want = df.toPandas().set_index("id")["v"].sort_index().rank(pct=True)
        assert (got - want).abs().max() < 1e-12
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)


def test_file_names_are_no_patterns(spark, tmp_path):
    import os
    own = open(os.path.join(os.path.dirname(__file__), "fixtures/exports/google_ads_dirty.csv")).read()
    for name in ("a[1].csv", "b{1}.csv", "c 1.csv"):
        (tmp_path / name).write_text(own)
    one = read_exports(spark, [str(tmp_path)])
    n = one.facts.groupBy("_source").count().collect()
    assert len(n) == 3 and len({r["count"] for r in n}) == 1


def test_only_a_missing_table_reads_as_empty(spark, tmp_path):
    paths = IngestPaths(str(tmp_path), str(tmp_path / "none"), "", "")
    assert read_ingested(spark, paths).count() == 0
    with pytest.raises(Exception):
        read_ingested(spark, IngestPaths("", "nosuchscheme://x/y", "", "")).count()
