"""Positions in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` plus ``place`` (1, 2, 3 ... in ``order``) and ``total`` (all rows).

    Rows are range-partitioned, numbered within their range and written; the counts of the ranges
    (one row a range, so a bounded broadcast) shift them.  Rows that are equal in ``order`` are told
    apart by where they were read, so that many equal rows spread over several ranges; which of them
    comes first is left open.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    ranged = tied.repartitionByRange(parts, *order, F.col("__tie")).sortWithinPartitions(*order, F.col("__tie")).drop("__tie")
    kept = written(ranged.withColumn("__at", F.monotonically_increasing_id()), name)
    at = kept.withColumn("__range", F.shiftright("__at", 33)).withColumn("__own", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = at.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"), F.sum("__n").over(Window.partitionBy()).alias("total"))
    return at.join(F.broadcast(shifts), "__range").withColumn("place", F.col("__own") + F.col("__shift") + 1).drop("__at", "__range", "__own", "__shift")
