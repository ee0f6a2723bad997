"""Connected components of an undirected edge list, by smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from every id that occurs in ``edges`` (a, b).

    Each round every vertex takes the least label of its neighbours, then its label's label;
    rounds are written tables, until nothing changes.  All steps are keyed joins and minima.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels["id"] == near["a"], "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("new"))
        up = labels.select(F.col("id").alias("new"), F.col("component").alias("up"))
        after = written(hooked.join(up, "new", "left").select("id", F.least("new", F.coalesce("up", "new")).alias("component"), (F.coalesce("up", "new") < F.col("component")).alias("moved")), "labels")
        labels, changed = after.select("id", "component"), after.filter("moved").limit(1).count()
        if not changed:
            return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (id, component) after ``edges`` (a, b) came in: only the components that they touch are solved anew.

    An id that ``labels`` lacks is a component of its own."""
    def named(rows: DataFrame, c: str) -> DataFrame:
        of = labels.select(F.col("id").alias(c), F.col("component").alias("of"))
        return rows.join(of, c, "left").withColumn(c, F.coalesce("of", c)).drop("of")

    up = components(named(named(edges.select("a", "b"), "a"), "b"))
    new = up.select(F.col("id").alias("component"), F.col("component").alias("new"))
    known = labels.join(new, "component", "left").select("id", F.coalesce("new", "component").alias("component"))
    return written(known.unionByName(up.join(labels, "id", "left_anti").select("id", "component")), "labels")
