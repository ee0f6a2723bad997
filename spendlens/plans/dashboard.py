"""End-to-end compositions of the three user flows.

* ``ingest_files``      CSV exports -> detected, normalised, validated facts
* ``analytics_context`` facts -> summary, flow, week-over-week (and cards)
* ``budget_plan``       summary -> scores -> allocation -> comparison -> text

Everything returned is a lazy DataFrame; nothing is collected here.  The
summary is small (one row per channel or campaign) and is the only result
reused by several downstream plans, so it is materialised once
(``materialize`` = reliable checkpoint in the shared checkpoint folder).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spendlens.operators import budget, datasets, quality, reports
from spendlens.session import materialize
from spendlens.sources.exports import ExportScan, read_exports


@dataclass
class IngestResult:
    facts: DataFrame           # valid unified rows (lineage kept)
    rejected_rows: DataFrame   # (source, row, message)
    rejected_files: DataFrame  # (file, stage, reason)
    file_summary: DataFrame    # per file: platform, rows, date span
    scan: ExportScan


def ingest_files(spark: SparkSession, paths, validate: str = "schema",
                 strict_headers: bool = True) -> IngestResult:
    """Entry point A.  ``validate="schema"`` keeps every normalised row
    (the reference app's behaviour); ``"full"`` also applies the row rules
    and moves failing rows to ``rejected_rows``."""
    scan = read_exports(spark, paths, strict_headers)
    facts = scan.facts
    if validate == "full":
        result = quality.run_validation(facts)  # one pass writes both sides
        facts, rejected = result.valid, result.rejected
    else:
        rejected = spark.createDataFrame([], "source string, row bigint, message string")
    return IngestResult(facts, rejected, scan.rejects, quality.file_summary(facts), scan)


@dataclass
class AnalyticsContext:
    summary: DataFrame
    flow: DataFrame
    wow: DataFrame
    kpi_cards: DataFrame
    weekly_ratios: DataFrame


def analytics_context(facts: DataFrame, dims: Sequence[str] = ("channel",)) -> AnalyticsContext:
    """Entry point B: rows without a date are dropped first."""
    clean = quality.facts_clean(facts)
    # one pass over the facts; everything below reads the small table
    periods = materialize(reports.period_totals(clean, dims))
    summary = materialize(reports.summary_columns(reports.totals_from_periods(periods, dims), dims))
    wow = reports.week_over_week(None, weekly=reports.weekly_from_periods(periods))
    return AnalyticsContext(
        summary=summary,
        flow=reports.spend_revenue_flow(clean, dims[0]),
        wow=wow,
        kpi_cards=reports.kpi_cards(summary, wow),
        weekly_ratios=reports.weekly_ratios(wow))


@dataclass
class BudgetPlan:
    result: budget.OptimizationResult
    comparison_chart: DataFrame


def budget_plan(summary: DataFrame, dims: Sequence[str] = ("channel",),
                floor: float = budget.MIN_ALLOCATION) -> BudgetPlan:
    """Entry point C."""
    res = budget.run_optimization(summary, dims, floor)
    return BudgetPlan(res, datasets.comparison_pct(res.comparison, dims[0]))
