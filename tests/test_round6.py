"""Exports of one campaign read that campaign's rows of the joined source only."""

import glob
from datetime import datetime

from spendlens.session import checkpoint_root, local_path, shared_dir
from spendlens.sources.records import quote_parity
from spendlens.sources.testdata import write_exports


def test_exports_read_a_source_kept_apart_by_campaign(spark):
    d = local_path(shared_dir(spark, "t-source"))
    prios = ["1-URGENT", "4-NOT SPECIFIED", None, "1-URGENT"]
    tables = {
        "lineitem": [(k, 1, 3.0, 10.0, 0.1, "N", datetime(1995, 1, 2)) for k in (0, 1, 2, 3, 3)],
        "orders": [(k, 7, p) for k, p in enumerate(prios)],
        "customer": [(7, "BUILDING")]}
    ddl = {"lineitem": "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                       "l_returnflag string, l_shipdate timestamp_ntz",
           "orders": "o_orderkey long, o_custkey long, o_orderpriority string", "customer": "c_custkey long, c_mktsegment string"}
    for name, rows in tables.items():
        spark.createDataFrame(rows, ddl[name]).write.parquet(f"{d}/{name}.parquet")
    root = local_path(checkpoint_root(spark))
    before = set(glob.glob(f"{root}/order-lines-*"))
    out = write_exports(spark, d, f"{d}/out")
    (base,) = set(glob.glob(f"{root}/order-lines-*")) - before
    kept = {p.rsplit("=", 1)[1] for p in glob.glob(f"{base}/o_orderpriority=*")}
    assert kept == {"1-URGENT", "4-NOT SPECIFIED", "__HIVE_DEFAULT_PARTITION__"}
    counts = {p.rsplit("/", 1)[1]: spark.read.option("header", True).csv(p).count() for p in out if p.rsplit("/", 1)[1].startswith("seo")}
    assert counts == {"seo_1-URGENT": 3, "seo_2-HIGH": 0, "seo_3-MEDIUM": 0, "seo_4-NOT_SPECIFIED": 1, "seo_5-LOW": 0}


def test_quotes_are_counted_on_lines_that_hold_any(spark):
    text = spark.createDataFrame([("a,b", "f", 0), ('"a,"', "f", 0), ('x "y', "f", 0), ('"""', "f", 9), ("", "g", 0)],
                                 "value string, _source string, _blk long")
    found = quote_parity(text)
    assert {(r["_source"], r["_blk"]): r["odd"] for r in found.collect()} == {("f", 0): 1, ("f", 9): 1, ("g", 0): 0}
    assert "contains" in found._jdf.queryExecution().optimizedPlan().toString().lower()
