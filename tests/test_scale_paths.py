"""Paths that only matter when files are split across tasks or tables are
partitioned: checked on purpose with tiny split sizes."""

import os

from pyspark.sql import functions as F

from spendlens.operators import tables
from spendlens.session import local_path, shared_dir
from spendlens.sources.exports import read_exports
from spendlens.sources.testdata import facts
from tests.conftest import SF001


def test_row_ordinals_exact_across_many_splits(spark):
    d = local_path(shared_dir(spark, "t-splits"))
    os.makedirs(d)
    n = 3000
    with open(f"{d}/big.csv", "w") as f:
        f.write("Date,Page/Campaign,Organic Cost,Organic Clicks,Organic Impressions,"
                "Goal Completions,Assisted Revenue\n")
        for i in range(n):
            f.write(f"2024/08/{1 + i % 28},/p{i},0,{i},{i * 10},1.0,{i}.00\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        scan = read_exports(spark, f"{d}/big.csv")
        rows = scan.facts.select("_row", "clicks").collect()
        splits = spark.read.text(f"{d}/big.csv").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == n
    assert all(r._row == r.clicks for r in rows)  # data row i carries clicks = i
    assert splits > 1  # the file really was read as several splits


def test_channel_filter_prunes_partitions(spark):
    path = shared_dir(spark, "t-pruning")
    tables.split_by_channel(facts(spark, SF001), path)
    df = tables.read_facts(spark, path).where(F.col("channel") == "machinery")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(channel" in plan and "machinery" in plan
    assert df.select("channel").distinct().collect()[0].channel == "machinery"


def test_header_probe_equals_text_scan(spark):
    from spendlens.sources.exports import file_headers
    fix = "file://" + os.path.join(os.path.dirname(__file__), "fixtures", "exports")
    probe = sorted((r.file, r.header) for r in file_headers(spark, [fix]).collect())
    scan = sorted((r.file, r.header) for r in file_headers(spark, [fix], method="scan").collect())
    assert probe == scan and len(probe) == 10
