"""One test per kept quirk / fallback of SURVEY §2.14 not covered elsewhere."""

import datetime as dt


from spendlens.operators import budget, reports, scoring
from spendlens.operators.normalize import normalize
from spendlens.schema import FACT_SCHEMA


def facts_of(spark, rows):
    return spark.createDataFrame(
        [(dt.datetime(2024, 8, 19 + i % 7), *r) for i, r in enumerate(rows)], FACT_SCHEMA)


def test_q5_missing_campaign_becomes_nan_text(spark):
    raw = spark.createDataFrame([("2024-08-19", None, "1", "1", "1", "1", "1"),
                                 ("2024-08-19", "NA", "1", "1", "1", "1", "1")],
                                "Day string, Campaign string, Cost string, Clicks string, "
                                "Impressions string, Conversions string, `Conv. value` string")
    got = [r.campaign_name for r in normalize(raw, "google_ads").collect()]
    assert got == ["nan", "nan"]


def test_q8_zero_spend_negative_revenue_gives_null_roas(spark):
    f = facts_of(spark, [("seo", "c", 0.0, 1, 1, 0, -5.0), ("email", "c", 0.0, 1, 1, 0, 0.0),
                         ("ppc", "c", 0.0, 1, 1, 0, 7.0), ("tv", "c", 2.0, 1, 1, 0, 4.0)])
    rows = reports.roas_by_channel(f).collect()
    assert [(r.channel, r.roas, r.is_infinite_roas) for r in rows] == [
        ("ppc", 9999.99, True), ("tv", 2.0, False), ("email", None, False), ("seo", None, False)]


def test_a1_order_cpa_ascending_nulls_last(spark):
    f = facts_of(spark, [("a", "c", 10.0, 1, 1, 0, 1.0), ("b", "c", 10.0, 1, 1, 5, 1.0),
                         ("c", "c", 10.0, 1, 1, 1, 1.0)])
    assert [r.channel for r in reports.cpa_by_channel(f).collect()] == ["b", "c", "a"]


def test_q9_q10_infinite_labels_and_flag(spark):
    f = facts_of(spark, [("seo", "c", 0.0, 10, 100, 1, 50.0)])
    s = reports.channel_summary(f, with_infinite_flag=True).first()
    assert s.roas == 9999.99 and s.is_infinite_roas is True
    cards = {r.label: r.value_label for r in
             reports.kpi_cards(reports.channel_summary(f), reports.week_over_week(f)).collect()}
    assert cards["Blended ROAS"] == "∞"          # blended ROAS is NULL for zero spend
    assert cards["Blended CPA"] == "$0"


def test_summary_ratios_are_plain_not_percent(spark):
    f = facts_of(spark, [("a", "c", 10.0, 5, 100, 1, 30.0)])
    s = reports.channel_summary(f).first()
    assert (s.ctr, s.conversion_rate, s.cpa, s.roas) == (0.05, 0.2, 10.0, 3.0)


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], FACT_SCHEMA)
    summary = reports.channel_summary(empty)
    assert summary.count() == 0
    assert reports.kpi_cards(summary, reports.week_over_week(empty)).count() == 0
    assert scoring.efficiency_score(summary).count() == 0
    res = budget.run_optimization(summary)
    assert res.comparison.count() == 0
    assert [r.insight for r in res.insights.collect()] == [
        "No data available for optimization insights."]


def test_week_over_week_uses_previous_existing_week_and_zero_guard(spark):
    rows = [("a", "c", 0.0, 1, 1, 0, 1.0)]
    f = spark.createDataFrame(
        [(dt.datetime(2024, 8, 19), *rows[0]), (dt.datetime(2024, 9, 2), "a", "c", 4.0, 1, 1, 2, 3.0),
         (dt.datetime(2024, 9, 9), "a", "c", 2.0, 1, 1, 1, 6.0)], FACT_SCHEMA)
    w = reports.week_over_week(f).collect()
    assert [r.week_start.day for r in w] == [19, 2, 9]       # the empty week is not filled
    assert w[1].spend_wow_pct is None                       # previous spend 0 -> NULL
    assert w[1].revenue_wow_pct == 2.0 and w[2].spend_wow_pct == -0.5


def test_underperformer_threshold_parameter(spark):
    df = spark.createDataFrame([("a", 17.9), ("b", 18.0)], "channel string, roas double")
    got = {r.channel: r.underperforming for r in scoring.flag_underperformers(df, 18.0).collect()}
    assert got == {"a": True, "b": False}


def test_allocation_floor_parameter_at_campaign_grain(spark):
    scored = spark.createDataFrame([(f"c{i}", float(i)) for i in range(1, 31)],
                                   "channel string, efficiency_score double")
    shares = [r.suggested_pct for r in budget.suggest_allocation(scored, floor=0.0).collect()]
    assert abs(sum(shares) - 1.0) < 1e-12 and min(shares) == 1 / 465
    flat = [r.suggested_pct for r in budget.suggest_allocation(scored).collect()]
    assert max(flat) - min(flat) < 0.02  # n * 5 % > 1: the default floor flattens shares
