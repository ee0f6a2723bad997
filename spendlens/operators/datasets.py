"""Chart-ready result tables (the data behind bars, donut, comparison and
flow diagram; drawing itself is out of scope)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.labels import (currency_label, money2_label,
                                        ratio_label, title_label)
from spendlens.functions.numeric import to_cents
from spendlens.schema import FLOW_SINK, FLOW_SOURCE, METRIC_DISPLAY


def metric_value(summary: DataFrame, metric: str) -> Column:
    """The summary column that holds a charted metric, under its own or its summary name."""
    present = [n for n in METRIC_DISPLAY.get(metric, ([],))[0] if n in summary.columns]
    if not present:
        raise ValueError(f"cannot chart {metric!r} from a summary of {', '.join(summary.columns)}")
    return F.col(present[0])


def metric_ranking(summary: DataFrame, metric: str = "roas",
                   dim: str = "channel") -> DataFrame:
    """One bar per row, NULL metric dropped, highest first, with label."""
    v = metric_value(summary, metric)
    _, title, kind = METRIC_DISPLAY[metric]
    label = {"ratio": ratio_label(v), "money2": money2_label(v),
             "money0": F.concat(F.lit("$"), F.format_number(v, 0))}[kind]
    return (summary.where(v.isNotNull() & ~F.isnan(v))
            .select(F.lit(metric).alias("metric"), F.lit(title).alias("title"),
                    F.col(dim).alias(dim), title_label(dim).alias("display_name"),
                    v.alias("value"), label.alias("value_label"))
            .orderBy(F.col("value").desc(), dim))


def budget_share(summary: DataFrame, dim: str = "channel") -> DataFrame:
    """Spend per row, share of the total and the grand total (donut)."""
    spend = metric_value(summary, "spend")
    tot = summary.agg((F.sum(to_cents(spend)).cast("double") / F.lit(100.0)).alias("t")).scalar()
    j = summary.withColumn("total_spend_all", tot)
    return j.select(
        dim, title_label(dim).alias("display_name"), spend.alias("spend"),
        F.when(F.col("total_spend_all") != 0,
               spend / F.col("total_spend_all")).alias("share"),
        "total_spend_all",
        currency_label("total_spend_all").alias("total_label"))


def comparison_pct(comparison: DataFrame, dim: str = "channel") -> DataFrame:
    """Shares x100 rounded to one decimal, smallest suggested first."""
    cur = F.rint(F.col("current_pct") * F.lit(100.0) * F.lit(10.0)) / F.lit(10.0)
    sug = F.rint(F.col("suggested_pct") * F.lit(100.0) * F.lit(10.0)) / F.lit(10.0)
    one = lambda c: F.concat(F.call_function("format_number", c, F.lit("0.0")), F.lit("%"))
    return (comparison.select(
                dim, title_label(dim).alias("display_name"),
                "suggested_pct", cur.alias("current_pct_display"),
                sug.alias("suggested_pct_display"),
                one(cur).alias("current_label"), one(sug).alias("suggested_label"))
            .orderBy(F.col("suggested_pct").asc(), dim)
            .drop("suggested_pct"))


def flow_nodes(flow: DataFrame) -> DataFrame:
    """C4: node index: budget source, channels sorted by name, revenue sink.

    The window orders node names, whose count is the number of channels
    plus two (not the number of fact rows).
    """
    names = flow.select(F.col("source").alias("label")).union(
        flow.select(F.col("target").alias("label"))).distinct()
    cls = (F.when(F.col("label") == FLOW_SOURCE, 0)
            .when(F.col("label") == FLOW_SINK, 2).otherwise(1))
    w = Window.orderBy(cls, "label")
    return names.select("label", (F.row_number().over(w) - 1).alias("node_index"))


def flow_links(flow: DataFrame) -> DataFrame:
    """Edges with integer source / target node indexes."""
    nodes = flow_nodes(flow)
    s = nodes.select(F.col("label").alias("source"), F.col("node_index").alias("source_index"))
    t = nodes.select(F.col("label").alias("target"), F.col("node_index").alias("target_index"))
    return flow.join(s, "source").join(t, "target") \
        .select("source", "target", "source_index", "target_index", "value")
