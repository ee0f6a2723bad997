"""The unified fact table as files.

The table is Parquet partitioned by ``channel``: a query filtering a channel
reads only that folder, and a re-upload replaces only the channels it
contains (dynamic partition overwrite).  Paths should live in shared
storage (e.g. below ``spark.checkpoint.dir``'s filesystem), never on a
machine-local disk.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.schema import FACT_COLUMNS, FACT_SCHEMA


def _by_channel(df: DataFrame) -> DataFrame:
    """Lay rows out for a ``partitionBy("channel")`` write.

    Without it every task writes one file per channel it holds (tasks x
    channels small files); a plain repartition by channel would put a hot
    channel into one task.  The REBALANCE hint lets AQE size output
    partitions per channel and split the skewed ones.
    """
    return df.select(*FACT_COLUMNS).hint("rebalance", "channel")


def append_facts(batch: DataFrame, path: str, batch_id: str | None = None) -> None:
    """Append a normalised batch to the table.

    With ``batch_id`` the table is laid out by (batch, channel) and the append is
    exactly-once: the batch's own folders are replaced when the write commits, so
    a run that was killed, or is repeated after it finished, leaves each row once.
    One id stands for the same rows each time.  Without it a repeated append adds
    the rows again; a table takes either form from its first batch on.
    """
    rows = _by_channel(batch)
    if batch_id is None:
        rows.write.mode("append").partitionBy("channel").parquet(path)
        return
    (rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch", "channel").parquet(path))


def split_by_channel(facts: DataFrame, path: str) -> None:
    """Write the facts as one folder per channel (no driver loop)."""
    _by_channel(facts).write.mode("overwrite").partitionBy("channel").parquet(path)


def replace_channels(batch: DataFrame, path: str) -> None:
    """Create-or-replace the channels present in ``batch``; other
    channels stay untouched and an empty batch changes nothing."""
    (_by_channel(batch).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy("channel").parquet(path))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Read the table back with the unified column order and types."""
    df = spark.read.schema(FACT_SCHEMA).parquet(path)
    return df.select(*FACT_COLUMNS)


def unified_view(spark: SparkSession, parts: Iterable[DataFrame] | str,
                 name: str = "unified_channel_data") -> DataFrame | None:
    """Union of the given channel DataFrames (or the table at a path)
    registered as a temp view; with nothing given the view is dropped."""
    if isinstance(parts, str):
        df = read_facts(spark, parts)
    else:
        parts = list(parts)
        if not parts:
            spark.catalog.dropTempView(name)
            return None
        df = parts[0].select(*FACT_COLUMNS)
        for p in parts[1:]:
            df = df.unionByName(p.select(*FACT_COLUMNS))
    df.createOrReplaceTempView(name)
    return spark.table(name)


def export_facts(facts: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Export the unified set as Parquet or CSV (with header)."""
    w = facts.select(*FACT_COLUMNS).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported export format {fmt!r}")


def read_export(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return spark.read.schema(FACT_SCHEMA).option("header", True).csv(path)
    return read_facts(spark, path)


def raw_facts(facts: DataFrame) -> DataFrame:
    """The whole normalised set, rows without a date included."""
    return facts.select(*FACT_COLUMNS, *[c for c in ("_source", "_row") if c in facts.columns])
