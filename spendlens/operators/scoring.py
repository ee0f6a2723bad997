"""Percentile ranks, efficiency score and underperformer flags.

The percentile rank is the average-ties rank divided by the row count, with
NULL/NaN placed at the *high* end (so a missing ROAS ranks best, a kept
quirk).  It is computed without a global window over the rows:

1. distinct values with their multiplicity (one aggregate);
2. values range-partitioned; a running count inside each range and the
   per-range totals (one row per range, a bounded broadcast) give the number
   of rows strictly below each value;
3. the ranks join back to the rows on the value.

All ranked columns share one long table (column, value), so two ranks cost one
ranged write.  The ranges are written once (``materialize``), so that the counts and the offsets
come from the same ranges whatever the planner reuses.  The same form serves all sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.numeric import nan_to_null
from spendlens.session import materialize
from spendlens.schema import SCORE_WEIGHT_CVR, SCORE_WEIGHT_ROAS, UNDERPERFORM_ROAS

Dims = Sequence[str]


def _range_parts(spark_df: DataFrame) -> int:
    conf = spark_df.sparkSession.conf
    return int(conf.get("spark.sql.shuffle.partitions", "200"))


def _order(c: Column, nulls: str) -> Column:
    if nulls not in ("best", "worst"):
        raise ValueError("nulls must be 'best' or 'worst'")
    return c.asc_nulls_last() if nulls == "best" else c.asc_nulls_first()


#: Distinct values up to which a column's ranks are broadcast to the rows; beyond, both sides are shuffled.
BROADCAST_VALUES = 100_000


@dataclass
class RankTable:
    """The ranks of several columns' values: a written table, and what is known of its ranges."""
    values: DataFrame            # (__m, __v, __r): column number, distinct value, percentile rank
    distinct: dict[int, int]     # distinct values of each column
    missing: dict[int, float]    # the rank of a column's missing values, if it has any


def rank_table(values: DataFrame, cols: Sequence[str], parts: int | None = None,
               nulls: str = "best") -> RankTable:
    """The percentile rank of each distinct value of each column.  All columns go through one
    ranged, written table; one row per column and range comes to the driver to shift the counts."""
    long = values.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("__m"), nan_to_null(F.col(c).cast("double")).alias("__v"))
        for k, c in enumerate(cols)])))
    counts = long.groupBy("__m", "__v").agg(F.count(F.lit(1)).alias("__k"))
    order = _order(F.col("__v"), nulls)
    p = parts or _range_parts(values)
    ranged = counts.repartitionByRange(p, "__m", order).withColumn("__p", F.spark_partition_id())
    # rows strictly below each value inside its range
    local = Window.partitionBy("__m", "__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # written: ranges sampled anew for a second use could be cut elsewhere
    ranged = materialize(ranged.withColumn("__lb", F.coalesce(F.sum("__k").over(local), F.lit(0))))
    # metadata: at most one row per column and range
    per_range = ranged.groupBy("__m", "__p").agg(
        F.sum("__k").alias("k"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("__v").isNull(), F.struct("__lb", "__k"))).alias("null")).collect()
    rows, distinct, missing = [], {}, {}
    for m in range(len(cols)):
        own = sorted((r for r in per_range if r["__m"] == m), key=lambda r: r["__p"])
        total, before = sum(r["k"] for r in own), 0
        distinct[m] = sum(r["n"] for r in own)
        for r in own:
            rows.append((m, r["__p"], before, total))
            if r["null"] is not None:
                missing[m] = (float(before + r["null"]["__lb"]) + (float(r["null"]["__k"]) + 1.0) / 2.0) / float(total)
            before += r["k"]
    offsets = values.sparkSession.createDataFrame(rows, "__m int, __p int, __off long, __n long")
    j = ranged.join(F.broadcast(offsets), ["__m", "__p"])
    below = (F.col("__off") + F.col("__lb")).cast("double")
    avg_rank = below + (F.col("__k").cast("double") + F.lit(1.0)) / F.lit(2.0)
    return RankTable(j.select("__m", "__v", (avg_rank / F.col("__n").cast("double")).alias("__r")), distinct, missing)


def with_ranks(df: DataFrame, cols: dict[str, str], parts: int | None = None,
               nulls: str = "best") -> DataFrame:
    """``df`` plus the percentile rank of each column: ``cols`` is result name -> column.

    Rows join back on the value; the rank of missing values, a key that many
    rows may share, is one number and needs no join.
    """
    ranks = rank_table(df, list(cols.values()), parts, nulls)
    out = df
    for k, (name, c) in enumerate(cols.items()):
        known = ranks.values.where((F.col("__m") == k) & F.col("__v").isNotNull()) \
            .select(F.col("__v").alias(f"__v{k}"), F.col("__r").alias(f"__r{k}"))
        if ranks.distinct[k] <= BROADCAST_VALUES:
            known = F.broadcast(known)
        j = out.join(known, nan_to_null(F.col(c).cast("double")) == F.col(f"__v{k}"), "left")
        out = j.withColumn(name, F.coalesce(F.col(f"__r{k}"), F.lit(ranks.missing.get(k)).cast("double"))).drop(f"__v{k}", f"__r{k}")
    return out


def pct_rank_avg(df: DataFrame, col: str, out: str, parts: int | None = None,
                 nulls: str = "best") -> DataFrame:
    """``df`` plus ``out`` = average-ties percentile rank of ``col``.

    ``nulls="best"`` ranks NULL/NaN above every value (the behaviour being
    reproduced); ``nulls="worst"`` ranks them below every value.
    """
    return with_ranks(df, {out: col}, parts, nulls)


def flag_underperformers(df: DataFrame,
                         roas_threshold: float = UNDERPERFORM_ROAS) -> DataFrame:
    """M6: ``underperforming`` = roas < threshold; NULL/NaN -> False."""
    if "roas" not in df.columns:
        return df.withColumn("underperforming", F.lit(False))
    r = nan_to_null(F.col("roas"))
    return df.withColumn("underperforming",
                         F.coalesce(r < F.lit(float(roas_threshold)), F.lit(False)))


def score_expr(r_roas: Column, r_cvr: Column) -> Column:
    """round2((0.7*rank_roas + 0.3*rank_cvr) * 100), half-even on binary."""
    blended = (r_roas * F.lit(SCORE_WEIGHT_ROAS) + r_cvr * F.lit(SCORE_WEIGHT_CVR)) * F.lit(100.0)
    return F.rint(blended * F.lit(100.0)) / F.lit(100.0)


def efficiency_score(summary: DataFrame, dims: Dims = ("channel",),
                     parts: int | None = None, sort: bool = True,
                     checkpoint: bool = True, nulls: str = "best") -> DataFrame:
    """M7: 0-100 score from ROAS and conversion-rate percentile ranks.

    Missing ``roas`` / ``conversion_rate`` columns give a constant 0.0 score
    and no sort, as does empty input (trivially, no rows).
    """
    if "roas" not in summary.columns or "conversion_rate" not in summary.columns:
        return summary.withColumn("efficiency_score", F.lit(0.0))
    cols = summary.columns
    if checkpoint:
        # the summary is read twice below (the rank table and the row join);
        # materialise it once instead of re-running its scans
        summary = materialize(summary)
    ranked = with_ranks(summary, {"__r_roas": "roas", "__r_cvr": "conversion_rate"}, parts, nulls)
    out = ranked.select(*cols, score_expr(F.col("__r_roas"), F.col("__r_cvr"))
                        .alias("efficiency_score"))
    if sort:
        out = out.orderBy(F.col("efficiency_score").desc(), *dims)
    return out
