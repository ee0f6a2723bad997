"""Ingest by a ledger of files, attempts and outcomes: failed files are tried again.

Every run lists the landing folder and takes the files that no attempt has loaded yet:
new ones, and those that failed before (all of them, or with ``retry="changed"`` only
those whose size or time differ from the failed attempt's).  A run writes each
file's facts below a folder of its own (file, attempt) and then one ledger row a file.
Readers see the latest loaded attempt of each file, so rows of a run that broke
off before its ledger rows are never seen, and the next run writes them again in the same
place.  ``replay`` names loaded files that are to be read anew, as after a correction.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.schema import FACT_COLUMNS
from spendlens.session import path_exists
from spendlens.sources.exports import BROADCAST_RANGES, _fact_lineage_schema, read_exports

LEDGER = ("name string, file string, length bigint, modified timestamp, attempt int, "
          "outcome string, stage string, reason string, run int")
LOADED, FAILED = "loaded", "failed"


@dataclass
class LedgerPaths:
    landing: str   # folder the exports arrive in
    facts: str     # unified rows by (name, attempt)
    ledger: str    # one row per file and attempt


def _name(uri: Column) -> Column:
    """A file's name from a URI, escapes resolved ('+' is no escape)."""
    name = _listed_name(uri)
    return F.when(F.contains(name, F.lit("%")), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))).otherwise(name)


def _listed_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _few(per_file: DataFrame, files: int) -> DataFrame:
    """A table of one row a file, broadcast to the rows as long as the files are few."""
    return F.broadcast(per_file) if files <= BROADCAST_RANGES else per_file


def _read(spark: SparkSession, schema, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_ledger(spark: SparkSession, paths: LedgerPaths) -> DataFrame:
    return _read(spark, LEDGER, paths.ledger)


def latest(ledger: DataFrame) -> DataFrame:
    """The last attempt of every file."""
    w = Window.partitionBy("name").orderBy(F.col("attempt").desc())
    return ledger.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def listing(spark: SparkSession, landing: str) -> DataFrame:
    """(name, file, length, modified): the exports that lie there, by name; of one name in several folders the first path."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true")
             .load(landing).select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified")))
    named = files.withColumn("name", _listed_name(F.col("file")))
    return named.groupBy("name").agg(F.min_by(F.struct("file", "length", "modified"), "file").alias("f")).select("name", "f.*")


def pending(spark: SparkSession, paths: LedgerPaths, retry: str = "always", replay: Sequence[str] = ()) -> DataFrame:
    """(name, file, length, modified, attempt) of the files that the next run takes."""
    if retry not in ("always", "changed"):
        raise ValueError("retry must be 'always' or 'changed'")
    last = latest(read_ledger(spark, paths)).select(
        "name", "outcome", F.col("attempt").alias("before"), F.col("length").alias("was_length"), F.col("modified").alias("was_modified"))
    rows = listing(spark, paths.landing).join(last, "name", "left")
    again = F.col("outcome") == FAILED
    if retry == "changed":
        again = again & ((F.col("length") != F.col("was_length")) | (F.col("modified") != F.col("was_modified")))
    wanted = F.col("outcome").isNull() | again
    if replay:
        wanted = wanted | F.col("name").isin(list(replay))
    return rows.where(wanted).select("name", "file", "length", "modified", (F.coalesce("before", F.lit(0)) + 1).alias("attempt"))


def ingest_pending(spark: SparkSession, paths: LedgerPaths, strict_headers: bool = True,
                   retry: str = "always", replay: Sequence[str] = ()) -> int:
    """One run: read the pending files, write their facts, then their ledger rows; returns how many."""
    todo = pending(spark, paths, retry, replay).collect()  # metadata: one row per pending file
    if not todo:
        return 0
    run = (read_ledger(spark, paths).agg(F.max("run")).first()[0] or 0) + 1
    schema = T._parse_datatype_string("name string, file string, length bigint, modified timestamp, attempt int")
    files = spark.createDataFrame(todo, schema)
    scan = read_exports(spark, [r["file"] for r in todo], strict_headers)
    facts = scan.facts.withColumn("name", _name(F.col("_source"))).join(_few(files.select("name", "attempt"), len(todo)), "name")
    facts = facts.select(*FACT_COLUMNS, "_source", "_row", "name", "attempt")
    if len(todo) > BROADCAST_RANGES:  # else a task of the scan holds whole ranges of few files
        facts = facts.hint("rebalance", "name")
    (facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("name", "attempt").parquet(paths.facts))
    # of one file's faults the first by stage and text
    bad = scan.rejects.groupBy(F.coalesce(_name(F.col("file")), _listed_name(F.col("file"))).alias("name")).agg(
        F.min(F.struct("stage", "reason")).alias("bad"))
    rows = files.join(bad, "name", "left").select(
        "name", "file", "length", "modified", "attempt", F.when(F.col("bad").isNull(), LOADED).otherwise(FAILED).alias("outcome"),
        F.col("bad.stage").alias("stage"), F.col("bad.reason").alias("reason"), F.lit(run).alias("run"))
    (rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run").parquet(paths.ledger))
    scan.drop_raw()
    return len(todo)


def read_loaded(spark: SparkSession, paths: LedgerPaths) -> DataFrame:
    """The facts of every file's latest loaded attempt."""
    schema = T.StructType(_fact_lineage_schema().fields + [T.StructField("name", T.StringType()), T.StructField("attempt", T.IntegerType())])
    loaded = latest(read_ledger(spark, paths).where(F.col("outcome") == LOADED)).select("name", "attempt")
    loaded = _few(loaded, loaded.count())
    return _read(spark, schema, paths.facts).join(loaded, ["name", "attempt"], "left_semi").drop("name", "attempt")
