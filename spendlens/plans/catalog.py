"""Named queries over the driver tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each entry reads whole tables (through the adapters in
``spendlens.sources.testdata``) and is paired, where SQL can state it, with a
DuckDB oracle in ``spendlens.plans.oracle``.  Shares and dollar amounts that
come out of a float sum whose order Spark does not fix are rounded (shares to
9 decimals, dollars to cents) on both sides; everything else is compared as
computed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spendlens.functions.numeric import round_to
from spendlens.operators import budget, datasets, outliers, reports, scoring
from spendlens.session import materialize
from spendlens.sources.testdata import facts

Query = Callable[[SparkSession, str], DataFrame]
CAMPAIGN = ("channel", "campaign_name")


def _summary(spark, sf, dims=("channel",)):
    return reports.channel_summary(facts(spark, sf), dims)


def _comparison_out(cmp: DataFrame, dims) -> DataFrame:
    return cmp.select(
        *dims, "spend", "roas", "efficiency_score",
        round_to("current_pct", 9).alias("current_pct"), "current_spend",
        round_to("suggested_pct", 9).alias("suggested_pct"),
        round_to("suggested_spend", 2).alias("suggested_spend"),
        round_to("delta_pct", 9).alias("delta_pct"),
        round_to("delta_spend", 2).alias("delta_spend"))


def _run_opt(dims):
    def q(spark, sf):
        res = budget.run_optimization(_summary(spark, sf, dims), dims)
        return _comparison_out(res.comparison, dims)
    return q


def _current_vs_suggested(spark, sf):
    """O2 with an explicit allocation table (left-join path)."""
    scored = scoring.efficiency_score(_summary(spark, sf), sort=False) \
        .withColumnRenamed("total_spend", "spend")
    alloc = budget.suggest_allocation(scored)
    return _comparison_out(budget.current_vs_suggested(scored, alloc), ("channel",))


def _suggest_allocation(spark, sf):
    scored = scoring.efficiency_score(_summary(spark, sf), sort=False)
    a = budget.suggest_allocation(scored)
    return a.select("channel", round_to("suggested_pct", 9).alias("suggested_pct"))


def _comparison(spark, sf):
    return budget.run_optimization(_summary(spark, sf)).comparison


def _metric_ranking(spark, sf):
    s = materialize(_summary(spark, sf))  # a row per channel, read four times
    parts = [datasets.metric_ranking(s, m) for m in ("roas", "cpa", "spend", "revenue")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _budget_share(spark, sf):
    b = datasets.budget_share(materialize(_summary(spark, sf)))
    return b.withColumn("share", round_to("share", 9))


def _wow(spark, sf):
    return reports.week_over_week(facts(spark, sf))


def _kpi_cards(spark, sf):
    summary, wow = reports.dashboard_reports(facts(spark, sf))
    return reports.kpi_cards(summary, wow)


def analytics_queries() -> dict[str, Query]:
    return {
        "channel_summary": lambda s, d: _summary(s, d),
        "campaign_summary": lambda s, d: _summary(s, d, CAMPAIGN),
        "cpa_by_channel": lambda s, d: reports.cpa_by_channel(facts(s, d)),
        "roas_by_channel": lambda s, d: reports.roas_by_channel(facts(s, d)),
        "weekly_totals": lambda s, d: reports.weekly_totals(facts(s, d)),
        "week_over_week": _wow,
        "week_over_week_by_channel": lambda s, d: reports.week_over_week(facts(s, d), dims=["channel"]),
        "week_over_week_one": lambda s, d: reports.week_over_week(facts(s, d), channel="machinery"),
        "spend_revenue_flow": lambda s, d: reports.spend_revenue_flow(facts(s, d)),
        "blended_kpis": lambda s, d: reports.blended_kpis(_summary(s, d)),
        "weekly_ratios": lambda s, d: reports.weekly_ratios(_wow(s, d)),
        "latest_deltas": lambda s, d: reports.latest_deltas(_wow(s, d)),
        "kpi_cards": _kpi_cards,
        "pct_rank_avg": lambda s, d: scoring.pct_rank_avg(
            _summary(s, d, CAMPAIGN), "roas", "pct_rank").select(
                "channel", "campaign_name", "roas", "pct_rank"),
        "flag_underperformers": lambda s, d: scoring.flag_underperformers(
            _summary(s, d, CAMPAIGN), 18.0),
        "efficiency_score": lambda s, d: scoring.efficiency_score(_summary(s, d)),
        "efficiency_score_by_campaign": lambda s, d: scoring.efficiency_score(
            _summary(s, d, CAMPAIGN), CAMPAIGN),
        "suggest_allocation": _suggest_allocation,
        "current_vs_suggested": _current_vs_suggested,
        "run_optimization": _run_opt(("channel",)),
        "run_optimization_by_campaign": _run_opt(CAMPAIGN),
        "optimization_insights": lambda s, d: budget.run_optimization(_summary(s, d)).insights,
        "metric_ranking": _metric_ranking,
        "budget_share": _budget_share,
        "comparison_pct": lambda s, d: datasets.comparison_pct(_comparison(s, d)),
        "spend_deviations": lambda s, d: outliers.deviations(facts(s, d)),
        "spend_outliers": lambda s, d: outliers.outliers(facts(s, d)).select(
            "channel", "week_start", "campaign_name", "spend", "median", "mad"),
        "flow_nodes": lambda s, d: datasets.flow_nodes(reports.spend_revenue_flow(facts(s, d))),
        "flow_links": lambda s, d: datasets.flow_links(reports.spend_revenue_flow(facts(s, d))),
    }


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(analytics_queries())
    from spendlens.plans.ingest_catalog import ingest_queries
    out.update(ingest_queries())
    return out


def oracle_sql() -> dict[str, str]:
    from spendlens.plans.oracle import analytics_sql
    out: dict[str, str] = {}
    out.update(analytics_sql())
    from spendlens.plans.ingest_oracle import ingest_sql
    out.update(ingest_sql())
    return {k: v for k, v in out.items() if k in queries()}


__all__ = ["queries", "oracle_sql"]
