"""End to end over small hand-written exports (tests/fixtures/exports):
detection, header quarantine, long-row file rejection, dirty values, row
rules, then the channel summary and budget plan on what was accepted."""

import os

import pytest

from spendlens.plans.dashboard import analytics_context, budget_plan, ingest_files

FIX = os.path.join(os.path.dirname(__file__), "fixtures", "exports")


@pytest.fixture(scope="module")
def ingested(spark):
    return ingest_files(spark, [f"file://{FIX}"], validate="full")


def test_file_quarantine(ingested):
    rej = {os.path.basename(r.file): (r.stage, r.reason) for r in ingested.rejected_files.collect()}
    assert rej == {
        "google_ads_long.csv": ("parse", "Expected 7 fields, saw 8"),
        "email_upper.csv": ("schema", "Missing required columns: Campaign, Clicks, Conversions, "
                                      "Cost, Opens, Revenue, Send Date"),
        "seo_five.csv": ("schema", "Missing required columns: Assisted Revenue, Organic Cost"),
        "facebook_four.csv": ("detect", "platform not recognised from the header"),
    }


def test_rows_and_rejected_rows(ingested):
    assert ingested.facts.count() == 12
    msgs = sorted(r.message for r in ingested.rejected_rows.collect())
    assert msgs == [
        "Row 3: Some values did not meet validation criteria (Input should be greater than or "
        "equal to 0). This row has been excluded from the final dataset.",
        "Row 4: Some values did not meet validation criteria (Value error, Date is missing; "
        "Input should be a finite number). This row has been excluded from the final dataset.",
    ]
    fb = {r.date.day: r for r in ingested.facts.where("channel = 'facebook'").collect()}
    assert set(fb) == {23, 13}  # 13/08/2024 read day-first because 13 > 12
    em = {r.date.year for r in ingested.facts.where("channel = 'email'").collect()}
    assert em == {2024}         # 26-Aug-24 -> 2024


def test_summary_and_budget(ingested):
    ctx = analytics_context(ingested.facts)
    s = {r.channel: r for r in ctx.summary.collect()}
    assert (s["google_ads"].total_spend, s["google_ads"].total_clicks, s["google_ads"].total_impressions,
            s["google_ads"].total_conversions, s["google_ads"].total_revenue) == (34.57, 340, 4000, 8, 1180.0)
    assert (s["email"].total_spend, s["email"].total_revenue, s["email"].total_clicks) == (3.0, 210.0, 40)
    assert s["seo"].roas == 9999.99 and s["seo"].total_spend == 0.0
    assert (s["facebook"].total_spend, s["facebook"].total_conversions) == (20.0, 1)
    cards = {r.label: r.value_label for r in ctx.kpi_cards.collect()}
    assert cards == {"Total Spend": "$58", "Total Revenue": "$1,850",
                     "Blended ROAS": "32.13x", "Blended CPA": "$3"}
    plan = budget_plan(ctx.summary)
    shares = [r.suggested_pct for r in plan.result.comparison.collect()]
    assert sum(shares) == pytest.approx(1.0) and min(shares) >= 0.05 - 1e-12
