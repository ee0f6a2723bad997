"""Quoted line breaks in files that many tasks read, against Python's CSV reader."""

import csv
import io
import os
import random

import pytest

from spendlens.session import local_path, shared_dir
from spendlens.sources.exports import read_exports
from spendlens.sources.records import lines, quote_parity, range_starts
from spendlens.streaming.ingest import IngestPaths, incremental_ingest, read_ingested

HEADER = ["Date", "Page/Campaign", "Organic Cost", "Organic Clicks", "Organic Impressions", "Goal Completions", "Assisted Revenue"]


def make(seed, rows, eol="\n", long_every=0):
    g = random.Random(seed)
    out = io.StringIO()
    w = csv.writer(out, lineterminator=eol)
    w.writerow(HEADER)
    names = ["plain", 'say "hi"', "two\nlines", 'a,"b"\n\n"c"', "", "tail\r\nend", '"', '\n"\n', "é ü\n中"]
    for k in range(rows):
        name = g.choice(names)
        if long_every and k % long_every == 5:
            name = "\n".join(f"line {j} of a long note" for j in range(400))  # longer than a range
        w.writerow(["2024/08/%02d" % (1 + k % 28), name, k / 4, k, k * 10, k % 3, k * 2.5])
        if g.random() < 0.05:
            out.write(eol)  # a blank line
    return out.getvalue()


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def expected(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return [(k, r[1] or "nan", int(r[3])) for k, r in enumerate(rows[1:])]


@pytest.fixture()
def small_ranges(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def test_quoted_line_breaks_over_many_ranges(spark, small_ranges):
    d = local_path(shared_dir(spark, "t-quoted"))
    texts = {"a b.csv": make(1, 400), "crlf.csv": make(2, 300, "\r\n"), "long.csv": make(3, 200, long_every=40), "none.csv": "\n".join(x for x in make(4, 1).splitlines()[:1]) + "\n2024/08/01,/x,1,2,3,1,5\n"}
    for name, text in texts.items():
        put(f"{d}/{name}", text)
    scan = read_exports(spark, d)
    got = {}
    for r in scan.facts.collect():
        got.setdefault(r["_source"].rsplit("/", 1)[1].replace("%20", " "), []).append((r["_row"], r["campaign_name"], r["clicks"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: expected(t) for k, t in texts.items()}
    assert [f.rsplit("/", 1)[1] for f in scan.quoted] == ["a b.csv", "crlf.csv", "long.csv"]
    assert scan.rejects.count() == 0
    # one file is read by many tasks, some of which start within quotes
    parity = quote_parity(lines(spark, [f"{d}/long.csv"]))
    assert parity.count() > 5 and range_starts(parity).count() > 1
    # read by records or not, files without quoted line breaks give the same rows
    plain = read_exports(spark, f"{d}/none.csv", multi_line=False).facts.collect()
    assert plain == read_exports(spark, f"{d}/none.csv", multi_line=True).facts.collect()


def test_over_long_rows_among_quoted_ones_reject_the_file(spark, small_ranges):
    d = local_path(shared_dir(spark, "t-overlong"))
    put(f"{d}/long.csv", make(5, 200) + '2024/08/01,"x\ny",1,2,3,1,5,6,7\n')
    put(f"{d}/good.csv", make(6, 50))
    scan = read_exports(spark, d)
    assert [(r.stage, r.reason) for r in scan.rejects.collect()] == [("parse", "Expected 7 fields, saw 9")]
    assert {r["_source"].rsplit("/", 1)[1] for r in scan.facts.select("_source").distinct().collect()} == {"good.csv"}


def test_one_csv_scan_per_header_group(spark):
    d = local_path(shared_dir(spark, "t-onescan"))
    put(f"{d}/a.csv", ",".join(HEADER) + "\n2024/08/01,/x,1,2,3,1,5\n")
    scan = read_exports(spark, d)
    plan = scan.facts.unionByName(scan.facts.limit(0)).crossJoin(scan.rejects.limit(1))._jdf.queryExecution().optimizedPlan().toString()
    assert " csv" not in plan.lower().replace(".csv", "") and "parquet" in plan.lower()
    raw = spark.read.parquet(f"{scan.raw_dir}/group-0")
    assert raw.count() == 1
    scan.drop_raw()
    assert not os.path.exists(local_path(scan.raw_dir))


def test_stream_takes_quoted_line_breaks(spark):
    base = local_path(shared_dir(spark, "t-stream-quoted"))
    paths = IngestPaths(f"{base}/landing", f"{base}/facts", f"{base}/rejects", f"{base}/ckpt")
    text = make(9, 60)
    put(f"{base}/landing/x.csv", text)
    incremental_ingest(spark, paths)
    got = sorted((r["_row"], r["campaign_name"], r["clicks"]) for r in read_ingested(spark, paths).collect())
    assert got == expected(text)


def test_header_names_that_differ_in_case_alone(spark):
    d = local_path(shared_dir(spark, "t-case"))
    head = ["organic clicks", *HEADER, "DATE", "Notes", "Notes"]
    put(f"{d}/x.csv", ",".join(head) + "\n" + "9,2024/08/01,/x,1,2,3,1,5,z,n,m\n")
    scan = read_exports(spark, d)
    assert [(r["campaign_name"], r["clicks"], str(r["date"])[:10]) for r in scan.facts.collect()] == [("/x", 2, "2024-08-01")]
    assert scan.rejects.count() == 0
