"""Profiles, coercion counts, one-pass validation, the ledger, exactly-once appends, weekly rollups."""

import os
import shutil

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from spendlens.operators import profile, quality, reports, rollups, tables
from spendlens.operators.normalize import normalize, normalize_all
from spendlens.plans.ingest_catalog import _raws
from spendlens.schema import FACT_COLUMNS
from spendlens.session import local_path, shared_dir
from spendlens.sources.testdata import facts, raw_rows
from spendlens.streaming.ledger import LedgerPaths, ingest_pending, pending, read_ledger, read_loaded
from tests.conftest import SF001
from tests.test_records import HEADER, put

RAW = "`Date` string, `Page/Campaign` string, `Organic Cost` string, `Organic Clicks` string, `Organic Impressions` string, `Goal Completions` string, `Assisted Revenue` string, _source string, _row long"


def raw(spark, rows):
    return spark.createDataFrame([(*r, "f", k) for k, r in enumerate(rows)], RAW)


GOOD = ("2024/08/01", "/a", "1.5", "3", "10", "1", "2.0")


def test_type_profile_and_errors(spark):
    rows = [GOOD, ("20240802", "/b", None, " 7 ", "1e2", "", "inf"), ("x", "5", "9", "99999999999999999999", "n/a", "2", "-3")]
    got = {r["unified"]: r for r in profile.inferred_types(profile.type_profile(raw(spark, rows), "seo")).collect()}
    kinds = {u: r["inferred"] for u, r in got.items()}
    assert kinds == {"date": "text", "campaign_name": "text", "spend": "float", "clicks": "float", "impressions": "float",
                     "conversions": "float", "revenue": "float"}
    assert (got["date"]["dates"], got["date"]["integers"], got["spend"]["missing"], got["clicks"]["integers"]) == (2, 1, 1, 2)
    errors = {r["column"]: r["error"] for r in profile.type_errors(profile.type_profile(raw(spark, rows), "seo")).collect()}
    assert errors == {"Date": "Column 'date' is not a valid datetime type.", "Organic Clicks": "Column 'clicks' is not a valid integer type.",
                      "Organic Impressions": "Column 'impressions' is not a valid integer type.",
                      "Goal Completions": "Column 'conversions' is not a valid integer type."}
    assert profile.type_errors(profile.type_profile(raw(spark, [GOOD, GOOD]), "seo")).count() == 0
    # profiles of parts add up to the whole's
    parts = profile.type_profile(raw(spark, rows[:1]), "seo").unionByName(profile.type_profile(raw(spark, rows[1:]), "seo"))
    assert sorted(map(tuple, profile.merge_profiles(parts).collect())) == sorted(map(tuple, profile.type_profile(raw(spark, rows), "seo").collect()))
    assert profile.type_profile(raw(spark, []), "seo").count() == 0


def test_coercion_marks_and_counts(spark):
    rows = [GOOD, ("INVALID", None, "$5", "", "10", "nan", "abc"), (None, "x", "1", "2", "-inf", "0.575", "1,0")]
    marked = normalize(raw(spark, rows), "seo", flags=True)
    plain = normalize(raw(spark, rows), "seo")
    assert [tuple(r) for r in marked.drop("_coerced").collect()] == [tuple(r) for r in plain.collect()]
    got = {(r["column"], r["values"]): r["message"] for r in profile.coercion_counts(marked).collect()}
    assert set(got) == {("Date", 2), ("Organic Cost", 1), ("Organic Clicks", 1), ("Goal Completions", 1), ("Assisted Revenue", 2)}
    assert got["Assisted Revenue", 2] == "Column 'Assisted Revenue' contained 2 missing/blank/non-numeric values. These have been filled with 0."
    assert got["Date", 2].startswith("Column 'Date' contained 2 unparseable or invalid date values.")
    seen = Observation("coerced")
    profile.observe_coercions(marked, seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 3, "date": 2, "spend": 1, "clicks": 1, "impressions": 0, "conversions": 1, "revenue": 2}


def test_coercion_counts_parse_once(spark):
    plan = profile.coercion_counts(normalize(raw_rows(spark, SF001, "seo"), "seo", flags=True))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem") <= plan.count("Relation") and plan.count("Relation") == 3  # lineitem, orders, customer: once each


def test_validation_in_one_pass(spark):
    df = normalize_all(_raws(spark, SF001))
    result = quality.run_validation(df)
    ok, bad = quality.valid_rows(df), quality.rejected_rows(df)
    assert (result.rows, result.rejected_rows) == (df.count(), bad.count()) and not result.is_valid()
    assert result.valid.exceptAll(ok).count() == 0 and result.valid.count() == ok.count()
    assert result.rejected.exceptAll(bad).count() == 0
    for side in (result.valid, result.rejected):  # both sides read what the pass wrote, each its own folder
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and "rlike" not in plan.lower() and "Join" not in plan
    again = quality.run_validation(result.valid)
    assert again.is_valid() and again.rejected.count() == 0
    missing = quality.run_validation(df.drop("date"))
    assert missing.schema_errors == ["Missing required columns: date"] and not missing.is_valid()


SEO_HEAD = ",".join(HEADER) + "\n"


def seo(n, start=0):
    return SEO_HEAD + "".join(f"2024/08/{1 + k:02d},/p{start + k},1,{start + k},2,1,5\n" for k in range(n))


def test_ledger_tries_failed_files_again(spark):
    base = local_path(shared_dir(spark, "t-ledger"))
    paths = LedgerPaths(f"{base}/landing", f"{base}/facts", f"{base}/ledger")
    put(f"{base}/landing/a/one.csv", seo(3))
    put(f"{base}/landing/bad file+1.csv", SEO_HEAD.upper() + "2024/08/01,/x,1,7,2,1,5\n")
    put(f"{base}/landing/long.csv", seo(1) + "2024/08/01,/x,1,7,2,1,5,9\n")
    put(f"{base}/landing/b/one.csv", seo(9))  # a name that another folder holds: one file
    clicks = lambda: sorted(r["clicks"] for r in read_loaded(spark, paths).select("clicks").collect())
    assert read_loaded(spark, paths).count() == 0 and ingest_pending(spark, paths) == 3
    assert clicks() == [0, 1, 2]
    out = {r["name"]: (r["attempt"], r["outcome"], r["stage"]) for r in read_ledger(spark, paths).collect()}
    assert out == {"one.csv": (1, "loaded", None), "bad file+1.csv": (1, "failed", "schema"), "long.csv": (1, "failed", "parse")}
    before = {d: sorted(os.listdir(f"{base}/facts/name=one.csv/{d}/channel")) if os.path.isdir(f"{base}/facts/name=one.csv/{d}/channel") else
              sorted(os.listdir(f"{base}/facts/name=one.csv/{d}")) for d in os.listdir(f"{base}/facts/name=one.csv")}
    # nothing has changed: with retry="changed" nothing is taken, by default the failed ones are
    assert ingest_pending(spark, paths, retry="changed") == 0
    assert {r["name"] for r in pending(spark, paths).collect()} == {"bad file+1.csv", "long.csv"}
    put(f"{base}/landing/bad file+1.csv", SEO_HEAD + "2024/08/01,/x,1,70,2,1,5\n2024/08/01,/x,1,71,2,1,5\n")  # corrected
    assert ingest_pending(spark, paths, retry="changed") == 1
    assert clicks() == [0, 1, 2, 70, 71]
    assert ingest_pending(spark, paths) == 1  # long.csv fails once more
    assert clicks() == [0, 1, 2, 70, 71]
    after = {d: sorted(os.listdir(f"{base}/facts/name=one.csv/{d}")) for d in os.listdir(f"{base}/facts/name=one.csv")}
    assert after == before  # others are untouched
    # a loaded file is read anew only if named
    put(f"{base}/landing/a/one.csv", seo(2, 10))
    assert ingest_pending(spark, paths, retry="changed") == 0
    assert ingest_pending(spark, paths, retry="changed", replay=["one.csv"]) == 1
    assert clicks() == [10, 11, 70, 71]
    with pytest.raises(ValueError):
        pending(spark, paths, retry="never")


def test_a_run_that_broke_off_before_its_ledger_rows_is_repeated(spark):
    base = local_path(shared_dir(spark, "t-ledger-broken"))
    paths = LedgerPaths(f"{base}/landing", f"{base}/facts", f"{base}/ledger")
    put(f"{base}/landing/one.csv", seo(4))
    ingest_pending(spark, paths)
    shutil.rmtree(f"{base}/ledger")  # as if the run had ended after the facts were written
    assert read_loaded(spark, paths).count() == 0
    assert ingest_pending(spark, paths) == 1
    assert read_loaded(spark, paths).count() == 4


def test_append_once(spark):
    path = local_path(shared_dir(spark, "t-append"))
    rows = facts(spark, SF001)
    first, second = rows.where("clicks < 25"), rows.where("clicks >= 25")
    tables.append_facts(first, path, batch_id="a")

    def broken(batches):
        for k, b in enumerate(batches):
            yield b
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):  # the write dies half-way: nothing of it is seen
        tables.append_facts(second.mapInPandas(broken, second.schema), path, batch_id="b")
    assert tables.read_facts(spark, path).count() == first.count()
    for batch, name in ((second, "b"), (second, "b"), (first, "a")):
        tables.append_facts(batch, path, batch_id=name)
    got = tables.read_facts(spark, path)
    assert got.columns == FACT_COLUMNS
    assert got.count() == rows.count() and got.exceptAll(rows).count() == 0


def stamps(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}


def test_weekly_rollup_touches_only_the_batch_weeks(spark):
    base = local_path(shared_dir(spark, "t-weekly"))
    rows = facts(spark, SF001).where("date >= timestamp_ntz'1995-01-01' and date < timestamp_ntz'1995-03-01'").cache()
    late = F.expr("campaign_name = '5-LOW' and date >= timestamp_ntz'1995-02-06' and date < timestamp_ntz'1995-02-20'")
    undated = rows.limit(1).withColumn("date", F.lit(None).cast("timestamp_ntz"))
    rollups.add_week_facts(rows.where(~late).unionByName(undated), f"{base}/f", "1")
    rollups.refresh_weekly(spark, f"{base}/f", f"{base}/t", "1", ["channel"])
    before = stamps(f"{base}/t")
    for _ in range(2):  # a repeated batch changes nothing more
        rollups.add_week_facts(rows.where(late), f"{base}/f", "late")
        assert rollups.refresh_weekly(spark, f"{base}/f", f"{base}/t", "late", ["channel"]) == ["1995-02-06", "1995-02-13"]
    after = stamps(f"{base}/t")
    kept = {p for p in before if "1995-02-06" not in p and "1995-02-13" not in p}
    assert kept and {p: after.get(p) for p in kept} == {p: before[p] for p in kept}
    got, want = rollups.read_weekly(spark, f"{base}/t", ["channel"]), reports.weekly_totals(rows, dims=["channel"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert rollups.refresh_weekly(spark, f"{base}/f", f"{base}/t", "none", ["channel"]) == []
    plan = rollups.read_week_facts(spark, f"{base}/f").where(F.col("week").isin(["1995-02-06"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [week" in plan.replace("isnotnull(", "") or "PartitionFilters: [" in plan
    rows.unpersist()


def test_sketch_quantiles_bound_the_exact_ones(spark):
    import random

    from spendlens.operators import outliers
    g = random.Random(4)
    rows = [(k % 3, int(g.lognormvariate(8, 3)) * (-1 if g.random() < 0.2 else 1)) for k in range(4000)] + [(3, 0), (4, 5), (4, 5), (5, None), (6, 2**62), (6, -2**62), (6, 255), (6, 256)]
    df = spark.createDataFrame(rows, "k int, v long")
    whole = outliers.sketch(df, "v", ["k"])
    parts = outliers.sketch(df.where("v % 2 = 0"), "v", ["k"]).unionByName(outliers.sketch(df.where("v % 2 <> 0"), "v", ["k"]))
    assert sorted(map(tuple, outliers.merge_sketches(parts, ["k"]).collect())) == sorted(map(tuple, whole.collect()))
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = {r["k"]: r for r in outliers.quantile(whole, ["k"], q).collect()}
        assert set(got) == {0, 1, 2, 3, 4, 6}
        for k, r in got.items():
            own = sorted(v for x, v in rows if x == k and v is not None)
            exact = own[max(-(-int(len(own) * q * 1000) // 1000), 1) - 1]
            assert r["low"] <= exact <= r["high"] and abs(r["middle"] - exact) <= max(abs(exact) / 256, 0.5), (q, k, exact, r)


def test_outliers_are_found_and_none_without_spread(spark):
    from spendlens.operators import outliers
    rows = [("2024-01-02", "seo", float(100 + k % 7)) for k in range(200)] + [("2024-01-03", "seo", 900.0), ("2024-01-10", "seo", 900.0), (None, "seo", 1e9)]
    rows += [("2024-01-02", "email", 5.0)] * 50 + [("2024-01-02", "email", 500.0)]
    df = spark.createDataFrame(rows, "date string, channel string, spend double").withColumn("date", F.col("date").cast("timestamp_ntz"))
    got = outliers.outliers(df).collect()
    assert [(r["channel"], r["spend"]) for r in got] == [("seo", 900.0)] and got[0]["score"] > 3.5
    assert outliers.outliers(df.limit(0)).count() == 0
