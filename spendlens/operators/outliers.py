"""Outliers by channel and week: median absolute deviation over a mergeable sketch.

Money is counted in integer cents, and a value falls into a bucket of its leading eight bits:
exact up to 255 cents, then 128 buckets an octave.  A sketch is the table of (group,
bucket, count): partial counts add up map-side, sketches of parts add up to the whole's, and a
group has at most some 7,300 buckets whatever its rows (64-bit values).  The bucket of a
quantile is the bucket of the exact one, so low <= exact <= high, and the middle of
the bucket is within 1/256 of the exact value.

A row is an outlier if its distance from its group's median is over ``threshold`` times the
scaled median distance (1.4826 makes it a standard deviation for normal values).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.dates import week_start
from spendlens.functions.numeric import to_cents

Dims = Sequence[str]
BITS = 8
SCALE, THRESHOLD = 1.4826, 3.5


def bucket_of(v: Column) -> Column:
    """The bucket of an integer: monotone, negative for negative values."""
    size = F.abs(v)
    shift = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    return F.when(v < 0, -1).otherwise(1) * (shift * (1 << (BITS - 1)) + F.call_function("shiftright", size, shift))


def bucket_bounds(b: Column) -> tuple[Column, Column, Column]:
    """(low, high, middle) of a bucket's values."""
    half = 1 << (BITS - 1)
    size = F.abs(b)
    shift = F.greatest(F.floor(size / half) - 1, F.lit(0)).cast("int")
    near = F.call_function("shiftleft", (size - shift * half).cast("bigint"), shift)
    more = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift) - 1
    far, middle = near + more, near + F.call_function("shiftright", more, F.lit(1))
    up = b >= 0
    return F.when(up, near).otherwise(-far), F.when(up, far).otherwise(-near), F.when(up, middle).otherwise(-middle)


def sketch(rows: DataFrame, value: str, dims: Dims) -> DataFrame:
    """(dims, bucket, n) of an integer column; NULL values are left out."""
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*dims, bucket_of(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, dims: Dims) -> DataFrame:
    return sketches.groupBy(*dims, "bucket").agg(F.sum("n").alias("n"))


def quantile(sketched: DataFrame, dims: Dims, q: float = 0.5) -> DataFrame:
    """(dims, rows, low, high, middle): the bucket of the smallest value that a share ``q`` of a group's
    rows does not exceed.  The window runs on buckets, not rows."""
    w = Window.partitionBy(*dims)
    upto = w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = sketched.select(*dims, "bucket", F.sum("n").over(upto).alias("__upto"), F.sum("n").over(w).alias("rows"))
    at = seen.where(F.col("__upto") >= F.greatest(F.ceil(F.col("rows") * q), F.lit(1))).groupBy(*dims, "rows").agg(F.min("bucket").alias("bucket"))
    low, high, middle = bucket_bounds(F.col("bucket"))
    return at.select(*dims, "rows", low.alias("low"), high.alias("high"), middle.alias("middle"))


def deviations(facts: DataFrame, metric: str = "spend", dims: Dims = ("channel",)) -> DataFrame:
    """(dims, week_start, rows, median_low, median_high, median, mad_low, mad_high, mad) in cents, per group and week.

    Rows without a date are left out.  Two sketches: of the values, and of their distances from the
    median's middle."""
    groups = [*dims, "week_start"]
    rows = _dated(facts, metric)
    mid = quantile(sketch(rows, "__v", groups), groups)
    mid = mid.select(*groups, "rows", F.col("low").alias("median_low"), F.col("high").alias("median_high"), F.col("middle").alias("median"))
    apart = rows.join(mid.select(*groups, "median"), groups).withColumn("__d", F.abs(F.col("__v") - F.col("median")))
    mad = quantile(sketch(apart, "__d", groups), groups)
    mad = mad.select(*groups, F.col("low").alias("mad_low"), F.col("high").alias("mad_high"), F.col("middle").alias("mad"))
    return mid.join(mad, groups)


def _dated(facts: DataFrame, metric: str) -> DataFrame:
    return facts.where(F.col("date").isNotNull()).withColumn("week_start", week_start("date")).withColumn("__v", to_cents(metric))


def outliers(facts: DataFrame, metric: str = "spend", dims: Dims = ("channel",), threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``facts`` that stand out in their group's week, with ``median`` and ``mad`` in cents and ``score``,
    the distance in scaled deviations.  A group whose median distance is 0 has none."""
    groups = [*dims, "week_start"]
    stats = deviations(facts, metric, dims).select(*groups, "median", "mad").where("mad > 0")
    j = _dated(facts, metric).join(stats, groups)
    score = F.abs(F.col("__v") - F.col("median")) / (F.col("mad") * F.lit(SCALE))
    return j.withColumn("score", score).where(F.col("score") > threshold).drop("__v")
