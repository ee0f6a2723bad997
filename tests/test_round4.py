"""Ingest steps that were slow at size: what they read, shuffle and repeat."""

import os

from spendlens.functions.dates import parse_dates
from spendlens.functions.numeric import parse_number
from spendlens.operators.detect import detect_platform
from spendlens.schema import EXPECTED_HEADERS, NA_TOKENS, PLATFORM_COLUMNS
from spendlens.session import local_path, shared_dir
from spendlens.sources.exports import names_apart  # noqa: F401  (the reader's module loads)
from spendlens.sources.records import HEAD, TAIL, WHOLE, _Range
from spendlens.sources.testdata import raw_rows
from spendlens.streaming.ingest import IngestPaths, incremental_ingest, read_ingested
from spendlens.streaming.ledger import LedgerPaths, ingest_pending, read_loaded
from tests.conftest import SF001

HEADER = ",".join(PLATFORM_COLUMNS["seo"].values())


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def no_shuffle_of_facts(monkeypatch, spark):
    kind, own = type(spark.range(1)), type(spark.range(1)).hint

    def hint(df, name, *args):
        assert name != "rebalance", "the facts are shuffled before they are written"
        return own(df, name, *args)
    monkeypatch.setattr(kind, "hint", hint)


def test_ledger_writes_and_reads_facts_without_a_shuffle(spark, monkeypatch):
    d = local_path(shared_dir(spark, "t4-ledger"))
    for name in ("a b+c%20.csv", "plain.csv"):
        put(f"{d}/landing/{name}", f"{HEADER}\n2024/08/01,/x,1,2,3,1,5\n2024/08/02,/y,1,4,3,1,5\n")
    paths = LedgerPaths(f"{d}/landing", f"{d}/facts", f"{d}/ledger")
    no_shuffle_of_facts(monkeypatch, spark)
    assert ingest_pending(spark, paths) == 2 and ingest_pending(spark, paths) == 0
    loaded = read_loaded(spark, paths)
    assert "broadcast" in plan(loaded)
    assert sorted(r["clicks"] for r in loaded.collect()) == [2, 2, 4, 4]


def test_stream_writes_facts_without_a_shuffle(spark, monkeypatch):
    d = local_path(shared_dir(spark, "t4-stream"))
    put(f"{d}/landing/x.csv", f"{HEADER}\n2024/08/01,/x,1,2,3,1,5\n")
    no_shuffle_of_facts(monkeypatch, spark)
    paths = IngestPaths(f"{d}/landing", f"{d}/facts", f"{d}/rejects", f"{d}/ckpt")
    incremental_ingest(spark, paths)
    assert [r["clicks"] for r in read_ingested(spark, paths).collect()] == [2]


def test_platform_layouts_read_one_written_table(spark):
    from spendlens.plans.ingest_catalog import _raws
    raws = _raws(spark, SF001)
    for p, raw in raws.items():
        assert "parquet" in plan(raw) and "Join" not in plan(raw) and "RDD" not in plan(raw)
        assert raw.exceptAll(raw_rows(spark, SF001, p)).count() == 0


def test_names_are_normalised_once_a_file(spark):
    rows = [(p, list(PLATFORM_COLUMNS[p].values())) for p in EXPECTED_HEADERS]
    rows += [("seo", ["x"]), ("none", ["a", "Day"]), ("empty", []), ("null", None), ("tie", ["Campaign", "Cost", "Clicks", "Conversions", "Day", "Opens"])]
    got = detect_platform(spark.createDataFrame(rows, "file string, names array<string>"))
    assert plan(got).count("lower(") == 1
    got = {r["file"]: (r["platform"], r["confidence"]) for r in got.collect()}
    assert got == {**{p: (p, 1.0) for p in EXPECTED_HEADERS}, "none": (None, 1 / 7), "empty": (None, 0.0), "null": (None, None),
                   "tie": ("google_ads", 5 / 7)}


def test_lines_become_records_an_array_at_a_time():
    import pyarrow as pa
    r = _Range("f", 5, True)
    r.lines(pa.array(['rest"', "a,b\r", "", " \x1c ", 'c,"d', "", 'e"\r']))
    r.lines(pa.array(["中", " ", 'open "']))
    r.lines(pa.array(["more"]))
    r.end()
    got = [tuple(x.values()) for b in r.rows for x in b.to_pylist()]
    assert got == [("f", 5, -1, HEAD, 'rest"'), ("f", 5, 0, WHOLE, "a,b"), ("f", 5, 1, WHOLE, 'c,"d\n\ne"'), ("f", 5, 2, WHOLE, "中"),
                   ("f", 5, 3, TAIL, 'open "\nmore')]


def test_texts_meet_few_guards(spark):
    df = spark.createDataFrame([("13/08/2024",), ("2024.8.9",), ("Aug 9, 2024",), ("20240809",), ("INVALID",), ("nan",)], "s string")
    got = df.select(parse_dates("s").alias("d"), parse_number("s").alias("n"))
    assert "Contains(" in plan(got) and not any(t in plan(got) for t in NA_TOKENS if len(t) > 4)
    assert [str(r["d"])[:10] for r in got.collect()] == ["2024-08-13", "2024-08-09", "2024-08-09", "2024-08-09", "None", "None"]


def test_quoted_files_of_two_layouts_keep_their_ranges(spark):
    from spendlens.sources.exports import read_exports
    d = local_path(shared_dir(spark, "t4-ranges"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
            if spark.conf.get(k, None)}
    for p in ("seo", "email"):
        date = "2024/08/01" if p == "seo" else "01-Aug-2024"
        rows = "".join(f'{date},"x\nnote ""\n"", {k}",1,{k},3,1,5\n' for k in range(3000 if p == "seo" else 900))
        put(f"{d}/{p}.csv", ",".join(PLATFORM_COLUMNS[p].values()) + "\n" + rows)
    try:  # ranges follow from the bytes that are read together
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "7")
        got = read_exports(spark, d).facts.groupBy("channel").count().collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert {r["channel"]: r["count"] for r in got} == {"seo": 3000, "email": 900}
