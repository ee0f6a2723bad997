"""Weekly totals kept up to date as exports arrive (A4, W1 incrementally).

Facts live in folders by week and batch, totals in folders by week.  When a batch
comes in, only the weeks that it touches are read (partition pruning), totalled
and replaced (dynamic overwrite); the folders of all other weeks stay as they
are.  Late exports are a batch like any other.  Both steps can be repeated: a
batch rewrites its own folders, a week's totals follow from its facts alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.dates import week_start
from spendlens.operators.reports import weekly_totals
from spendlens.schema import FACT_COLUMNS, FACT_SCHEMA

Dims = Sequence[str]
_TOTALS = "week_start timestamp_ntz, total_spend double, total_revenue double, total_conversions bigint, week string"


def _week(c: str) -> Column:
    return F.date_format(week_start(c), "yyyy-MM-dd")


def add_week_facts(batch: DataFrame, path: str, batch_id: str) -> None:
    """Write a batch's dated rows below its own (week, batch) folders; a rerun replaces them."""
    (batch.where(F.col("date").isNotNull()).select(*FACT_COLUMNS, _week("date").alias("week"), F.lit(batch_id).alias("batch"))
     .hint("rebalance", "week")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("week", "batch").parquet(path))


def read_week_facts(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*FACT_SCHEMA.fields, T.StructField("week", T.StringType()), T.StructField("batch", T.StringType())])
    return spark.read.schema(schema).parquet(path)


def touched_weeks(spark: SparkSession, path: str, batch_id: str) -> list[str]:
    """The weeks that a batch holds rows of: at most one entry a calendar week."""
    rows = read_week_facts(spark, path).where(F.col("batch") == batch_id).select("week").distinct().collect()
    return sorted(r["week"] for r in rows)


def refresh_weekly(spark: SparkSession, facts_path: str, totals_path: str, batch_id: str, dims: Dims = ()) -> list[str]:
    """Recompute and replace the totals of the weeks that ``batch_id`` touches; returns those weeks."""
    weeks = touched_weeks(spark, facts_path, batch_id)
    if weeks:
        rows = read_week_facts(spark, facts_path).where(F.col("week").isin(weeks))
        totals = weekly_totals(rows, dims=dims).withColumn("week", _week("week_start"))
        (totals.repartition("week").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("week").parquet(totals_path))
    return weeks


def read_weekly(spark: SparkSession, totals_path: str, dims: Dims = ()) -> DataFrame:
    """The kept totals, as ``reports.weekly_totals`` gives them."""
    schema = ", ".join([*(f"{d} string" for d in dims), _TOTALS])
    return spark.read.schema(schema).parquet(totals_path).drop("week")
