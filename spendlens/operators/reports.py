"""Aggregate reports over the fact table (channel / campaign grain).

Every report is one grouped aggregate (partial + final hash aggregate, so a
hot channel holding a third of the rows is combined map-side before the
shuffle).  Money is summed as exact integer cents: float sums change with
shuffle order, cents do not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.labels import currency_label, delta_label, roas_label
from spendlens.functions.numeric import to_cents
from spendlens.functions.dates import week_start as _week_start
from spendlens.schema import FLOW_SINK, FLOW_SOURCE, KPI_LABELS, ROAS_CAP

Dims = Sequence[str]
DEFAULT_DIMS: tuple[str, ...] = ("channel",)


def _cents_to_money(c: Column) -> Column:
    return c.cast("double") / F.lit(100.0)


def _ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when den is 0 (ANSI-safe)."""
    return F.when(den != 0, F.try_divide(num.cast("double"), den.cast("double")))


def capped_roas(spend: Column, revenue: Column) -> Column:
    """Zero spend with positive revenue -> cap; zero spend otherwise -> NULL."""
    return (F.when((spend == 0) & (revenue > 0), F.lit(ROAS_CAP))
             .when(spend == 0, F.lit(None).cast("double"))
             .otherwise(F.try_divide(revenue, spend)))


def totals(facts: DataFrame, dims: Dims = DEFAULT_DIMS) -> DataFrame:
    """dims + exact money totals (double) + count totals (bigint)."""
    return facts.groupBy(*dims).agg(
        _cents_to_money(F.sum(to_cents("spend"))).alias("total_spend"),
        _cents_to_money(F.sum(to_cents("revenue"))).alias("total_revenue"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("impressions").alias("total_impressions"),
        F.sum("conversions").alias("total_conversions"),
    )


def period_totals(facts: DataFrame, dims: Dims = DEFAULT_DIMS) -> DataFrame:
    """Pre-aggregate to (dims, week_start) with exact cent sums.

    Its size is groups x weeks, independent of the fact row count; both the
    per-group summary and the weekly series roll up from it, so a dashboard
    scans and shuffles the facts once instead of once per report.
    """
    return facts.groupBy(*dims, _week_start("date").alias("week_start")).agg(
        F.sum(to_cents("spend")).alias("spend_c"),
        F.sum(to_cents("revenue")).alias("revenue_c"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("impressions").alias("total_impressions"),
        F.sum("conversions").alias("total_conversions"))


def totals_from_periods(periods: DataFrame, dims: Dims = DEFAULT_DIMS) -> DataFrame:
    """Roll ``period_totals`` up to dims (same values as ``totals``)."""
    return periods.groupBy(*dims).agg(
        _cents_to_money(F.sum("spend_c")).alias("total_spend"),
        _cents_to_money(F.sum("revenue_c")).alias("total_revenue"),
        F.sum("total_clicks").alias("total_clicks"),
        F.sum("total_impressions").alias("total_impressions"),
        F.sum("total_conversions").alias("total_conversions"))


def weekly_from_periods(periods: DataFrame, channel: str | None = None,
                        dims: Dims = ()) -> DataFrame:
    """Roll ``period_totals`` (channel grain) up to weeks (as weekly_totals)."""
    if channel is not None:
        periods = periods.where(F.col("channel") == F.lit(channel))
    return periods.groupBy(*dims, "week_start").agg(
        _cents_to_money(F.sum("spend_c")).alias("total_spend"),
        _cents_to_money(F.sum("revenue_c")).alias("total_revenue"),
        F.sum("total_conversions").alias("total_conversions"))


def summary_columns(t: DataFrame, dims: Dims, with_infinite_flag: bool = False) -> DataFrame:
    """Derived ratios of a totals table (A3 output columns)."""
    s, r = F.col("total_spend"), F.col("total_revenue")
    cols = [*dims, "total_spend", "total_revenue", "total_clicks",
            "total_impressions", "total_conversions",
            _ratio(s, F.col("total_conversions")).alias("cpa"),
            capped_roas(s, r).alias("roas"),
            _ratio(F.col("total_clicks"), F.col("total_impressions")).alias("ctr"),
            _ratio(F.col("total_conversions"), F.col("total_clicks")).alias("conversion_rate")]
    if with_infinite_flag:
        cols.append(((s == 0) & (r > 0)).alias("is_infinite_roas"))
    return t.select(*cols)


def channel_summary(facts: DataFrame, dims: Dims = DEFAULT_DIMS,
                    with_infinite_flag: bool = False) -> DataFrame:
    """A3: five totals plus cpa, capped roas, ctr, conversion_rate (ratios)."""
    return summary_columns(totals(facts, dims), dims, with_infinite_flag)


def cpa_by_channel(facts: DataFrame, dims: Dims = DEFAULT_DIMS) -> DataFrame:
    """A1: spend, conversions and CPA; best (lowest) CPA first, NULLs last."""
    t = facts.groupBy(*dims).agg(
        _cents_to_money(F.sum(to_cents("spend"))).alias("total_spend"),
        F.sum("conversions").alias("total_conversions"))
    return (t.withColumn("cpa", _ratio(F.col("total_spend"), F.col("total_conversions")))
             .orderBy(F.col("cpa").asc_nulls_last(), *dims))


def roas_by_channel(facts: DataFrame, dims: Dims = DEFAULT_DIMS) -> DataFrame:
    """A2: ROAS with the zero-spend cap and its flag; highest first."""
    t = facts.groupBy(*dims).agg(
        _cents_to_money(F.sum(to_cents("spend"))).alias("total_spend"),
        _cents_to_money(F.sum(to_cents("revenue"))).alias("total_revenue"))
    s, r = F.col("total_spend"), F.col("total_revenue")
    return (t.select(*dims, "total_spend", "total_revenue",
                     capped_roas(s, r).alias("roas"),
                     ((s == 0) & (r > 0)).alias("is_infinite_roas"))
             .orderBy(F.col("roas").desc_nulls_last(), *dims))


def weekly_totals(facts: DataFrame, channel: str | None = None,
                  dims: Dims = ()) -> DataFrame:
    """A4: Monday-based weekly spend, revenue, conversions.

    ``channel`` is the optional single-channel filter (W2); it is applied
    before the aggregate and reaches the parquet scan as a pushed filter.
    """
    if channel is not None:
        facts = facts.where(F.col("channel") == F.lit(channel))
    return facts.groupBy(*dims, _week_start("date").alias("week_start")).agg(
        _cents_to_money(F.sum(to_cents("spend"))).alias("total_spend"),
        _cents_to_money(F.sum(to_cents("revenue"))).alias("total_revenue"),
        F.sum("conversions").alias("total_conversions"))


def week_over_week(facts: DataFrame | None, channel: str | None = None,
                   dims: Dims = (), weekly: DataFrame | None = None) -> DataFrame:
    """Weekly totals with change vs the previous existing week.

    With ``dims`` the lag runs per group (partitioned window); without, the
    window is global, but it runs on the weekly aggregate whose size is the
    number of weeks in the date span, not the number of fact rows.
    """
    wk = weekly if weekly is not None else weekly_totals(facts, channel, dims)
    w = Window.partitionBy(*dims).orderBy("week_start") if dims else \
        Window.orderBy("week_start")
    out = [*dims, "week_start", "total_spend", "total_revenue", "total_conversions"]
    for m, name in (("total_spend", "spend_wow_pct"),
                    ("total_revenue", "revenue_wow_pct"),
                    ("total_conversions", "conversions_wow_pct")):
        prev = F.lag(m).over(w)
        out.append(F.when(prev != 0, F.try_divide(
            (F.col(m) - prev).cast("double"), prev.cast("double"))).alias(name))
    return wk.select(*out).orderBy(*dims, "week_start")


def spend_revenue_flow(facts: DataFrame, dim: str = "channel") -> DataFrame:
    """A5: flow edges budget -> channel (spend) and channel -> revenue.

    One aggregate and a ``stack`` instead of two scans of the facts.
    """
    t = facts.groupBy(dim).agg(
        _cents_to_money(F.sum(to_cents("spend"))).alias("s"),
        _cents_to_money(F.sum(to_cents("revenue"))).alias("r"))
    return t.select(F.inline(F.array(
        F.struct(F.lit(FLOW_SOURCE).alias("source"), F.col(dim).alias("target"),
                 F.col("s").alias("value")),
        F.struct(F.col(dim).alias("source"), F.lit(FLOW_SINK).alias("target"),
                 F.col("r").alias("value")))))


def blended_kpis(summary: DataFrame) -> DataFrame:
    """Portfolio totals over a summary; ratios NULL unless denominator > 0.

    Totals are re-summed as cents, so the result equals a direct sum over
    the facts whatever the grouping of the summary.
    """
    t = summary.agg(
        _cents_to_money(F.sum(to_cents("total_spend"))).alias("total_spend"),
        _cents_to_money(F.sum(to_cents("total_revenue"))).alias("total_revenue"),
        F.sum("total_conversions").alias("total_conversions"),
        F.count(F.lit(1)).alias("n_groups"))
    s, r, c = F.col("total_spend"), F.col("total_revenue"), F.col("total_conversions")
    return t.select(
        "total_spend", "total_revenue", "total_conversions",
        F.when(s > 0, F.try_divide(r, s)).alias("blended_roas"),
        F.when(c > 0, F.try_divide(s, c.cast("double"))).alias("blended_cpa"),
        "n_groups")


def weekly_ratios(wow: DataFrame) -> DataFrame:
    """Sparkline series; a zero denominator gives 0, not NULL."""
    return wow.select(
        "week_start", "total_spend", "total_revenue",
        F.coalesce(_ratio(F.col("total_revenue"), F.col("total_spend")), F.lit(0.0)).alias("roas"),
        F.coalesce(_ratio(F.col("total_spend"), F.col("total_conversions")), F.lit(0.0)).alias("cpa"),
    ).orderBy("week_start")


def latest_deltas(wow: DataFrame) -> DataFrame:
    """Changes of the latest week; ROAS delta := revenue delta and CPA
    delta := spend delta (the approximation the cards use)."""
    last = wow.agg(F.max_by(F.struct("week_start", "spend_wow_pct", "revenue_wow_pct"),
                            "week_start").alias("l"))
    return last.select(
        F.col("l.week_start").alias("week_start"),
        F.col("l.spend_wow_pct").alias("spend_delta"),
        F.col("l.revenue_wow_pct").alias("revenue_delta"),
        F.col("l.revenue_wow_pct").alias("roas_delta"),
        F.col("l.spend_wow_pct").alias("cpa_delta"))


def dashboard_reports(facts: DataFrame, dims: Dims = DEFAULT_DIMS,
                      checkpoint: bool = True):
    """Summary and week-over-week from one pass over the facts:
    ``period_totals`` (groups x weeks rows) is checkpointed once and both
    reports roll up from it."""
    periods = period_totals(facts, dims)
    if checkpoint:
        from spendlens.session import materialize
        periods = materialize(periods)
    summary = summary_columns(totals_from_periods(periods, dims), dims)
    wow = week_over_week(None, weekly=weekly_from_periods(periods))
    return summary, wow


def kpi_cards(summary: DataFrame, wow: DataFrame) -> DataFrame:
    """Four cards (ord, label, value_label, delta_label).

    Both inputs collapse to one row each; the deltas row is attached as a
    scalar subquery.  No cards for an empty summary.
    """
    b = blended_kpis(summary)
    d = latest_deltas(wow)
    # the latest-week row is attached as a scalar subquery (one row by
    # construction), not joined
    last = d.select(F.struct(*d.columns).alias("d")).scalar()
    j = b.select("*", *[last.getField(c).alias(c) for c in d.columns]) \
        .where(F.col("n_groups") > 0)
    cards = [
        (1, KPI_LABELS[0], currency_label("total_spend"), "spend_delta"),
        (2, KPI_LABELS[1], currency_label("total_revenue"), "revenue_delta"),
        (3, KPI_LABELS[2], roas_label("blended_roas"), "roas_delta"),
        (4, KPI_LABELS[3], currency_label("blended_cpa"), "cpa_delta"),
    ]
    return j.select(F.inline(F.array(*[
        F.struct(F.lit(o).alias("ord"), F.lit(lbl).alias("label"),
                 v.alias("value_label"), delta_label(dc).alias("delta_label"))
        for o, lbl, v, dc in cards])))
