"""Verdicts of rows: each text is parsed once a row."""

from spendlens.operators import profile, quality
from spendlens.operators.normalize import normalize
from spendlens.schema import PLATFORM_COLUMNS


def _raw(spark):
    cols = list(PLATFORM_COLUMNS["google_ads"].values())
    rows = [("2024-01-05", "a", "1.5", "3", "10", "1.0", "2", "f", 0), ("x", None, "", "-3", "inf", "n/a", "1e3", "f", 1)]
    return spark.createDataFrame(rows, [*cols, "_source", "_row"])


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_verdicts_parse_dates_once_and_build_messages_for_failing_rows_only(spark):
    facts = normalize(_raw(spark), "google_ads")
    once = _plan(facts).count("gettimestamp")
    assert once > 0
    assert _plan(quality.facts_clean(facts)).count("gettimestamp") == once
    assert "Input should be" not in _plan(quality.valid_rows(facts))
    assert [r["_row"] for r in quality.valid_rows(facts).collect()] == [0]
    assert [r["row"] for r in quality.rejected_rows(facts).collect()] == [1]
    assert [r["_row"] for r in quality.facts_clean(facts).collect()] == [0]


def test_profile_counts(spark):
    raw = _raw(spark)
    found = {r.unified: r for r in profile.type_profile(raw.unionByName(raw), "google_ads").collect()}
    assert [found["clicks"][k] for k in profile.COUNTS] == [4, 0, 4, 4, 0]
    assert [found["spend"][k] for k in profile.COUNTS] == [4, 2, 0, 2, 0]
    assert [found["date"][k] for k in profile.COUNTS] == [4, 0, 0, 0, 2]
