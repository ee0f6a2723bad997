"""Budget reallocation: suggested shares, current-vs-suggested, narrative.

Portfolio-wide quantities (row count, score sum, spend total) are one-row
aggregates attached to the rows as scalar subqueries (``DataFrame.scalar``):
evaluated once, no join, whatever the number of channels or campaigns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.labels import signed_pct_label, title_label
from spendlens.functions.numeric import to_cents
from spendlens.operators.reports import channel_summary
from spendlens.operators.scoring import efficiency_score
from spendlens.schema import (MIN_ALLOCATION, STRONG_MEAN_SCORE, TEXT_GAINER,
                              TEXT_LOSER, TEXT_NO_DATA, TEXT_STRONG, TEXT_WEAK,
                              WEAK_MEAN_SCORE)
from spendlens.session import materialize

Dims = Sequence[str]


def suggest_allocation(scored: DataFrame, dims: Dims = ("channel",),
                       floor: float = MIN_ALLOCATION,
                       keep_columns: bool = False) -> DataFrame:
    """O1: share of budget per row from ``efficiency_score``.

    One row -> 1.0.  All scores 0 or all missing -> 1/n.  Otherwise
    score / sum (1/n if the sum is not > 0 or any score is missing), floored
    at ``floor`` and renormalised to sum to 1.  With many rows the floor can
    dominate (n * floor > 1); it is a parameter for that reason.
    """
    if "efficiency_score" not in scored.columns:
        raise ValueError("input must contain an 'efficiency_score' column; "
                         "run efficiency_score first")
    sc = F.col("efficiency_score").cast("double")
    missing = sc.isNull() | F.isnan(sc)
    stats = scored.agg(F.struct(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(sc == 0, 1).otherwise(0)).alias("nz"),
        F.sum(F.when(missing, 1).otherwise(0)).alias("nm"),
        F.sum(F.when(~missing, sc)).alias("tot")).alias("st")).scalar()
    j = scored.select("*", *[stats.getField(k).alias(f"__{k}") for k in ("n", "nz", "nm", "tot")])
    n = F.col("__n").cast("double")
    single = F.col("__n") == 1
    uniform = (F.col("__nz") == F.col("__n")) | (F.col("__nm") == F.col("__n"))
    raw = F.when((F.col("__nm") > 0) | ~(F.col("__tot") > 0), F.lit(1.0) / n) \
        .otherwise(sc / F.col("__tot"))
    j = j.withColumn("__cap", F.greatest(raw, F.lit(float(floor))))
    cap_tot = j.agg(F.sum("__cap").alias("__ctot")).scalar()
    j = j.withColumn("__ctot", cap_tot)
    share = (F.when(single, F.lit(1.0))
              .when(uniform, F.lit(1.0) / n)
              .otherwise(F.col("__cap") / F.col("__ctot")))
    keep = [c for c in scored.columns] if keep_columns else list(dims)
    return j.select(*keep, share.alias("suggested_pct"))


def current_vs_suggested(scored: DataFrame, allocations: DataFrame | None = None,
                         dims: Dims = ("channel",)) -> DataFrame:
    """O2: current vs suggested share and dollars per row.

    ``scored`` needs dims, ``spend``, ``roas``, ``efficiency_score``; the
    shares come from ``allocations`` (left join on dims, missing -> 0) or,
    when omitted, from a ``suggested_pct`` column already on ``scored``.
    Suggested dollars use the current total spend.
    """
    base = scored
    if allocations is not None:
        base = scored.drop("suggested_pct") if "suggested_pct" in scored.columns else scored
        base = base.join(allocations.select(*dims, "suggested_pct"), list(dims), "left")
    tot = scored.agg((F.sum(to_cents("spend")).cast("double") / F.lit(100.0)).alias("t")).scalar()
    j = base.withColumn("__total", tot)
    total = F.col("__total")
    cur_pct = F.when(total > 0, F.col("spend") / total).otherwise(F.lit(0.0))
    sug = F.coalesce(F.col("suggested_pct"), F.lit(0.0))
    out = j.select(
        *dims, "spend", "roas", "efficiency_score",
        cur_pct.alias("current_pct"),
        F.col("spend").alias("current_spend"),
        sug.alias("suggested_pct"),
        (sug * total).alias("suggested_spend"))
    out = out.withColumn("delta_pct", F.col("suggested_pct") - F.col("current_pct")) \
             .withColumn("delta_spend", F.col("suggested_spend") - F.col("current_spend"))
    return out.orderBy(F.col("suggested_pct").desc(), *dims)


def _display_name(dims: Dims) -> Column:
    first = title_label(dims[0])
    if len(dims) == 1:
        return first
    return F.concat_ws(" / ", first, *[F.col(d).cast("string") for d in dims[1:]])


def _template(text: str) -> str:
    return (text.replace("%", "%%").replace("{name}", "%s")
                .replace("{amount}", "%s").replace("{pct}", "%s"))


def optimization_insights(comparison: DataFrame, dims: Dims = ("channel",)) -> DataFrame:
    """O3: narrative lines (ord, insight).

    Biggest gainer (delta_spend > 0) and loser (< 0) are picked with
    min_by on a key that reproduces "first row in suggested-desc order"
    among ties; a portfolio line follows when the mean score is > 70 or
    < 40.  Empty input gives a single fixed line.
    """
    name = _display_name(dims)
    row = F.struct(name.alias("name"), F.col("delta_spend").alias("d"),
                   F.col("delta_pct").alias("p"))
    tie = [F.col(d) for d in dims]
    a = comparison.agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(row, F.struct(-F.col("delta_spend"), -F.col("suggested_pct"), *tie)).alias("g"),
        F.min_by(row, F.struct(F.col("delta_spend"), -F.col("suggested_pct"), *tie)).alias("l"),
        F.avg("efficiency_score").alias("m"))
    gain = F.format_string(_template(TEXT_GAINER), F.col("g.name"),
                           F.format_number(F.col("g.d"), 0),
                           signed_pct_label(F.col("g.p") * F.lit(100.0)))
    loss = F.format_string(_template(TEXT_LOSER), F.col("l.name"),
                           F.format_number(F.abs(F.col("l.d")), 0))
    lines = [
        (0, F.when(F.col("n") == 0, F.lit(TEXT_NO_DATA))),
        (1, F.when((F.col("n") > 0) & (F.col("g.d") > 0), gain)),
        (2, F.when((F.col("n") > 0) & (F.col("l.d") < 0), loss)),
        (3, F.when(F.col("n") > 0, F.when(F.col("m") > STRONG_MEAN_SCORE, F.lit(TEXT_STRONG))
                                   .when(F.col("m") < WEAK_MEAN_SCORE, F.lit(TEXT_WEAK)))),
    ]
    out = a.select(F.inline(F.array(*[
        F.struct(F.lit(o).alias("ord"), t.alias("insight")) for o, t in lines])))
    return out.where(F.col("insight").isNotNull())


@dataclass
class OptimizationResult:
    allocations: DataFrame
    comparison: DataFrame
    insights: DataFrame


def run_optimization(summary: DataFrame, dims: Dims = ("channel",),
                     floor: float = MIN_ALLOCATION,
                     total_budget: float | None = None) -> OptimizationResult:
    """Summary -> score -> shares -> comparison -> narrative, one plan.

    ``total_budget`` is accepted for interface parity and, as in the
    behaviour reproduced, not used: dollars follow current total spend.
    """
    # read by three scalar subqueries and the result: written once, a row per group
    scored = materialize(efficiency_score(summary, dims, sort=False))
    if "total_spend" in scored.columns and "spend" not in scored.columns:
        scored = scored.withColumnRenamed("total_spend", "spend")
    with_share = suggest_allocation(scored, dims, floor, keep_columns=True)
    comparison = current_vs_suggested(with_share, None, dims)
    return OptimizationResult(
        allocations=with_share.select(*dims, "suggested_pct"),
        comparison=comparison,
        insights=optimization_insights(comparison, dims))


def optimize_facts(facts: DataFrame, dims: Dims = ("channel",),
                   floor: float = MIN_ALLOCATION) -> OptimizationResult:
    """Convenience: channel_summary + run_optimization at any grain."""
    return run_optimization(channel_summary(facts, dims), dims, floor)
