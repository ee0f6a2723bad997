"""Reading, folds and written intermediate tables shared by the operators."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.session import remove_dir, shared_dir

#: Rows of one Arrow batch handed to Python; texts can be long.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Runtime settings of these operators: small Arrow batches bound a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of the tables that this driver's operators have written, by application.
_WRITTEN: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared checkpoint folder and read it again: cuts the
    lineage with files that every executor sees.  ``release`` deletes them."""
    path = shared_dir(df.sparkSession, name)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that operators have written between their steps, and tell how many; results that still
    read them must have been saved before."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove_dir(spark, path)
    return len(paths)


class Shared:
    """A broadcast value.  It travels with its classes (see the package), which a plain broadcast leaves
    to the worker's own copy of the library; a worker unpacks it once for all its tasks."""

    def __init__(self, spark: SparkSession, value):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if not hasattr(self.sent, "unpacked"):  # a worker keeps the broadcast between tasks
            self.sent.unpacked = pickle.loads(self.sent.value)
        return self.sent.unpacked

    def unpersist(self) -> None:
        self.sent.unpersist()


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts`` (NULL for a NULL id)."""
    return F.crc32(doc_id.cast("string")) % parts


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone: other columns and clashing names drop out.  A column of the right type
    stays as it is, without an alias, so that equal plans are seen as equal and shuffled once."""
    own = lambda c, kind: F.col(c) if dict(docs.dtypes)[c] == kind else F.col(c).cast(kind).alias(c)
    return docs.select(own("doc_id", "bigint"), own("text", "string"))


def grouped_bytes(batches: Iterator, limit: int = 1 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts as UTF-8 bytes) in groups of about ``limit`` bytes, from Arrow
    batches of (doc_id, text); a longer text is a group of its own, NULL is empty."""
    import pyarrow as pa

    ids, found, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if found and size + len(t or b"") > limit:
                yield ids, found
                ids, found, size = [], [], 0
            ids.append(i)
            found.append(t or b"")
            size += len(t or b"") + 1
    if found:
        yield ids, found
