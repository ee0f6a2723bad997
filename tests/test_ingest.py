import os

import pytest
from pyspark.sql import functions as F

from spendlens.operators import detect, quality, tables
from spendlens.operators.normalize import MissingColumnsError, normalize
from spendlens.session import local_path, shared_dir
from spendlens.sources.exports import read_exports
from spendlens.streaming.ingest import IngestPaths, incremental_ingest, read_ingested


def headers(spark, rows):
    return spark.createDataFrame(rows, "file string, names array<string>")


def test_detection_variants(spark):
    g = ["Day", "Campaign", "Cost", "Clicks", "Impressions", "Conversions", "Conv. value"]
    rows = [("exact", g), ("extra", g + ["Notes"]), ("upper", [n.upper() for n in g]),
            ("five", g[:2] + g[3:6]), ("four", ["Day", "Campaign", "Clicks", "Impressions"]),
            ("seo", ["Date", "Page/Campaign", "Organic Cost", "Organic Clicks",
                     "Organic Impressions", "Goal Completions", "Assisted Revenue"]),
            ("none", ["a", "b"])]
    got = {r.file: r.platform for r in detect.detect_platform(headers(spark, rows)).collect()}
    assert got == {"exact": "google_ads", "extra": "google_ads", "upper": "google_ads",
                   "five": "google_ads", "four": None, "seo": "seo", "none": None}


def test_tie_goes_to_first_platform(spark):
    # 'campaign', 'cost', 'clicks', 'conversions' + 'impressions' are shared by
    # google_ads and email: equal confidence, google_ads listed first
    names = ["Campaign", "Cost", "Clicks", "Conversions", "Impressions", "Opens", "Day"]
    got = detect.detect_platform(headers(spark, [("f", names)])).first()
    assert got.platform == "google_ads"


def test_strict_headers_reject_other_case(spark):
    raw = spark.createDataFrame([("2024-01-01",)], "DAY string")
    with pytest.raises(MissingColumnsError):
        normalize(raw, "google_ads")


def test_row_rules_and_rejects(spark):
    df = spark.createDataFrame(
        [(None, "seo", "c", 1.0, 1, 1, 1, 1.0, "f", 0),
         (None, "tv", "c", -1.0, -2, None, 1, 1.0, "f", 1)],
        "date timestamp_ntz, channel string, campaign_name string, spend double, clicks long, "
        "impressions long, conversions long, revenue double, _source string, _row long")
    df = df.withColumn("date", F.when(F.col("_row") == 0, F.lit("2024-01-01").cast("timestamp_ntz"))
                       .otherwise(F.col("date")))
    assert quality.valid_rows(df).count() == 1
    msg = quality.rejected_rows(df).first().message
    assert msg.startswith("Row 1: Some values did not meet validation criteria (Value error, Date is missing; ")
    assert msg.endswith("). This row has been excluded from the final dataset.")
    assert quality.schema_errors(df.drop("spend", "date")) == ["Missing required columns: date, spend"]
    assert quality.schema_errors(df) == []


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


EMAIL = ('﻿Send Date,Campaign,Cost,Clicks,Opens,Conversions,Revenue\n'
         '23-Aug-2024,"Promo, A",1.50,10,100,1.0,20.00\n'
         'INVALID,"Promo, B",n/a,,50,,5.5\n')
SEO = ("Date,Page/Campaign,Organic Cost,Organic Clicks,Organic Impressions,Goal Completions,Assisted Revenue\n"
       "2024/08/23,/a,0,5,50,1.0,100\n")


def test_read_exports_groups_by_header_and_quarantines(spark):
    d = local_path(shared_dir(spark, "t-exports"))
    _write(f"{d}/email.csv", EMAIL)
    _write(f"{d}/seo.csv", SEO)
    _write(f"{d}/junk.csv", "x,y\n1,2\n")
    scan = read_exports(spark, f"{d}/*.csv")
    rows = sorted(scan.facts.collect(), key=lambda r: (r.channel, r._row))
    assert [(r.channel, r._row, r.campaign_name, r.clicks) for r in rows] == [
        ("email", 0, "Promo, A", 10), ("email", 1, "Promo, B", 0), ("seo", 0, "/a", 5)]
    assert rows[1].date is None and rows[1].spend == 0.0 and rows[1].revenue == 5.5
    rej = scan.rejects.collect()
    assert len(rej) == 1 and rej[0].file.endswith("junk.csv") and rej[0].stage == "detect"


def test_incremental_ingest_processes_each_file_once(spark):
    base = local_path(shared_dir(spark, "t-ingest"))
    paths = IngestPaths(f"{base}/landing", f"{base}/facts", f"{base}/rejects", f"{base}/ckpt")
    _write(f"{base}/landing/a/email.csv", EMAIL)
    incremental_ingest(spark, paths)
    assert read_ingested(spark, paths).count() == 2
    incremental_ingest(spark, paths)  # nothing new
    assert read_ingested(spark, paths).count() == 2
    _write(f"{base}/landing/b/seo.csv", SEO)
    _write(f"{base}/landing/c/email.csv", EMAIL)  # same name elsewhere: skipped
    incremental_ingest(spark, paths)
    got = read_ingested(spark, paths)
    assert got.count() == 3
    assert sorted(r.channel for r in got.select("channel").distinct().collect()) == ["email", "seo"]


def test_replace_channels_keeps_others_and_empty_is_noop(spark):
    from spendlens.schema import FACT_SCHEMA
    path = shared_dir(spark, "t-table")
    row = lambda ch, s: ("2024-01-01", ch, "c", s, 1, 1, 1, 1.0)
    mk = lambda rows: spark.createDataFrame(rows, "date string, channel string, campaign_name string, spend double, clicks long, impressions long, conversions long, revenue double").withColumn("date", F.col("date").cast("timestamp_ntz"))  # noqa: E501,E731
    tables.split_by_channel(mk([row("seo", 1.0), row("email", 2.0)]), path)
    tables.replace_channels(mk([row("seo", 5.0), row("seo", 6.0)]), path)
    tables.replace_channels(spark.createDataFrame([], FACT_SCHEMA), path)
    got = sorted((r.channel, r.spend) for r in tables.read_facts(spark, path).collect())
    assert got == [("email", 2.0), ("seo", 5.0), ("seo", 6.0)]


def test_replayed_micro_batch_is_idempotent(spark):
    """A micro-batch re-run after a failure (same batch id) rewrites its own
    partition instead of appending the rows a second time."""
    from spendlens.streaming.ingest import _process
    base = local_path(shared_dir(spark, "t-replay"))
    paths = IngestPaths(f"{base}/landing", f"{base}/facts", f"{base}/rejects", f"{base}/ckpt")
    _write(f"{base}/landing/email.csv", EMAIL)
    _write(f"{base}/landing/junk.csv", "x,y\n1,2\n")
    batch = spark.createDataFrame([(f"file://{base}/landing/email.csv",),
                                   (f"file://{base}/landing/junk.csv",)], "path string")
    run = _process(spark, paths, True)
    run(batch, 7)
    run(batch, 7)  # replay of the same batch
    assert read_ingested(spark, paths).count() == 2
    assert spark.read.parquet(paths.rejects).count() == 1
    later = spark.createDataFrame([(f"file://{base}/landing/email.csv",)], "path string")
    run(later, 8)  # a later batch appends next to it
    assert read_ingested(spark, paths).count() == 4
