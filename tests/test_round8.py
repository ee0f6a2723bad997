"""Exports, raw tables and shuffles leave the disk once nothing reads them."""

import glob
import os
from datetime import datetime

import pytest

from spendlens.plans import ingest_catalog
from spendlens.schema import PLATFORMS
from spendlens.session import checkpoint_root, held, local_path, shared_dir, written
from spendlens.sources.testdata import RAW_CAMPAIGN_PREFIX, order_lines
from spendlens.streaming import ingest
from spendlens.streaming.ingest import IngestPaths, _portions, incremental_ingest, read_ingested


@pytest.fixture()
def orders_dir(spark):
    """Five lines of three orders, one order's customer unknown, one campaign missing."""
    d = local_path(shared_dir(spark, "t-disk"))
    day = datetime(1995, 1, 2)
    lines = [(0, 1, 3.0), (1, 5, 26.0), (1, 6, 13.0), (2, 1, 4.0), (2, 2, 4.0)]
    tables = {
        "lineitem": ([(o, n, q, 1000.0 + q, 0.1, "N", day) for o, n, q in lines],
                     "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                     "l_returnflag string, l_shipdate timestamp_ntz"),
        "orders": ([(0, 7, "1-URGENT"), (1, 7, "2-HIGH"), (2, 8, None), (3, 9, "5-LOW")],
                   "o_orderkey long, o_custkey long, o_orderpriority string"),
        "customer": ([(7, "BUILDING"), (8, "HOUSEHOLD")], "c_custkey long, c_mktsegment string")}
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def below(spark, name):
    return set(glob.glob(f"{local_path(checkpoint_root(spark))}/{name}-*"))


def test_quoted_exports_go_platform_by_platform(spark, orders_dir, monkeypatch):
    before = {n: below(spark, n) for n in ("order-lines", "quoted", "raw")}
    seen = []

    def reading(spark, paths, read=ingest_catalog.read_exports):
        (quoted,) = below(spark, "quoted") - before["quoted"]
        seen.append(sorted(os.listdir(quoted)))
        return read(spark, paths)
    monkeypatch.setattr(ingest_catalog, "read_exports", reading)
    found = ingest_catalog._quoted_breaks(spark, orders_dir)
    assert seen == [[p] for p in PLATFORMS]  # no two platforms' texts at a time
    for quoted in below(spark, "quoted") - before["quoted"]:
        assert not os.listdir(quoted)
    assert below(spark, "order-lines") == before["order-lines"]
    raw = [f for r in below(spark, "raw") - before["raw"] for f in glob.glob(f"{r}/group-*/*.parquet")]
    assert raw and all(f.endswith(".zstd.parquet") for f in raw)
    rows = found.collect()  # read after the exports are gone
    # a line of quantity 26 has no campaign; a NULL priority neither
    expected = sorted((p, name, 3 + k, 10 * imp) for p in PLATFORMS for name, k, imp in (
        (f'{RAW_CAMPAIGN_PREFIX[p]}1-URGENT\nnote "\n", end', 0, 6), ("nan", 23, 156), (f'{RAW_CAMPAIGN_PREFIX[p]}2-HIGH\nnote "\n", end', -3, 91),
        ("nan", 1, 8), ("nan", 1, 12)))
    assert sorted((r.channel, r.campaign_name, r.clicks, r.impressions) for r in rows) == expected


def test_held_tables_go_and_their_shuffles(spark, orders_dir):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for d in disk.localDirs() for f in glob.glob(f"{d}/*/shuffle_*")}
    before = shuffles()
    with held(order_lines(spark, orders_dir), "held") as rows:
        assert rows.count() == 5
        left = [f for f in shuffles() - before if f.endswith(".data")]
    assert not below(spark, "held")
    with pytest.raises(ValueError, match="within"), held(spark.range(3), "held"):
        raise ValueError("within")
    assert not below(spark, "held")
    assert written(spark.range(3), "held").count() == 3
    assert spark.conf.get(key) == kept
    assert len(left) <= 1  # that of the count


SEO = "Date,Page/Campaign,Organic Cost,Organic Clicks,Organic Impressions,Goal Completions,Assisted Revenue\n"
EMAIL = "Send Date,Campaign,Cost,Clicks,Opens,Conversions,Revenue\n"


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_portions_hold_whole_files_in_order():
    files = [("c", 4), ("a", 6), ("b", 5), ("e", 30), ("d", 1)]
    assert _portions(files, 11) == [["a", "b"], ["c", "d"], ["e"]]
    assert _portions(files, 100) == [["a", "b", "c", "d", "e"]]
    assert _portions(files, 1) == [["a"], ["b"], ["c"], ["d"], ["e"]]


def test_a_micro_batch_is_read_in_portions(spark, monkeypatch):
    base = local_path(shared_dir(spark, "t-portions"))
    paths = IngestPaths(f"{base}/landing", f"{base}/facts", f"{base}/rejects", f"{base}/ckpt")
    put(f"{base}/landing/1/seo.csv", SEO + "2024/08/01,/a,1,2,3,1,5\n2024/08/02,\"/b\nnote\",1,3,3,1,5\n")
    put(f"{base}/landing/2/seo_more.csv", SEO + "2024/08/03,/c,1,4,3,1,5\n")
    put(f"{base}/landing/2/email.csv", EMAIL + "01-Aug-2024,x,1,5,3,1,5\n")
    put(f"{base}/landing/3/long.csv", EMAIL + "01-Aug-2024,x,1,5,3,1,5,9,9\n")
    put(f"{base}/landing/3/junk.csv", "x,y\n1,2\n")
    put(f"{base}/landing/4/seo.csv", SEO + "2024/08/04,/twin,1,6,3,1,5\n")  # one listing: both of a name are taken
    before, most, visible = below(spark, "raw"), [], []

    def reading(spark, files, strict, read=ingest.read_exports):
        visible.append(read_ingested(spark, paths).count() if os.path.isdir(paths.facts) else 0)
        scan = read(spark, files, strict)
        most.append(len(below(spark, "raw") - before))
        return scan
    monkeypatch.setattr(ingest, "read_exports", reading)
    incremental_ingest(spark, paths, portion_bytes=1)
    assert len(most) == 6 and max(most) == 1  # raw tables of one portion at a time
    assert visible == [0] * 6  # nothing is seen of a batch that is not whole
    facts = [("email", "x", 5, 0, 0), ("seo", "/a", 2, 0, 0), ("seo", "/b\nnote", 3, 1, 0), ("seo", "/c", 4, 0, 0), ("seo", "/twin", 6, 0, 0)]
    rows = lambda: sorted((r.channel, r.campaign_name, r.clicks, r["_row"], r.ingest_batch) for r in read_ingested(spark, paths).collect())
    assert rows() == facts
    rejects = {(r.file.rsplit("/", 1)[1], r.stage, r.ingest_batch) for r in spark.read.parquet(paths.rejects).collect()}
    assert rejects == {("junk.csv", "detect", 0), ("long.csv", "parse", 0)}
    incremental_ingest(spark, paths, portion_bytes=1)  # nothing new
    assert len(most) == 6 and rows() == facts
    # what a broken run left of a batch is not added to its replay
    listed = spark.createDataFrame([(f"file://{base}/landing/2/email.csv", 1)], "path string, length long")
    put(f"{paths.facts}/_batch-1/channel=email/part-0.parquet", "torn")
    for _ in range(2):
        ingest._process(spark, paths, True)(listed, 1)
    assert rows() == sorted([*facts, ("email", "x", 5, 0, 1)])
    files = glob.glob(f"{paths.facts}/ingest_batch=*/channel=*/*.parquet")
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_a_batch_of_refused_files_has_no_facts(spark):
    base = local_path(shared_dir(spark, "t-refused"))
    paths = IngestPaths(f"{base}/landing", f"{base}/facts", f"{base}/rejects", f"{base}/ckpt")
    put(f"{base}/landing/junk.csv", "x,y\n1,2\n")
    incremental_ingest(spark, paths)
    assert read_ingested(spark, paths).count() == 0
    assert [(r.stage, r.ingest_batch) for r in spark.read.parquet(paths.rejects).collect()] == [("detect", 0)]
    put(f"{base}/landing/email.csv", EMAIL + "01-Aug-2024,x,1,5,3,1,5\n")
    incremental_ingest(spark, paths)
    assert [(r.channel, r.ingest_batch) for r in read_ingested(spark, paths).collect()] == [("email", 1)]


def test_the_ingests_source_goes_once_the_exports_are_written(spark, orders_dir):
    before = below(spark, "order-lines"), below(spark, "raw")
    assert ingest_catalog._incremental(spark, orders_dir).count() == 20  # every line in every layout
    assert (below(spark, "order-lines"), below(spark, "raw")) == before
