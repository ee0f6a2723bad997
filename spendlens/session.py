"""Session construction and shared scratch locations."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job in this package assumes.  Session time zone is pinned so
# week buckets and timestamp parsing never depend on the host's zone.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast decisions are taken by AQE on measured shuffle sizes only:
    # static estimates (no CBO) can make a large fact scan look small.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # Fall back from whole-stage codegen when a generated method would be
    # too large for the JVM to JIT-compile (8000 bytes); such methods would
    # otherwise run in the bytecode interpreter (wide parse projections).
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "spendlens",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    On a cluster leave ``master`` unset and size ``shuffle_partitions`` to the
    data (roughly input bytes / 128 MB); locally it defaults to the core count.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    # runtime-settable keys also applied to a reused session
    for k in ("spark.sql.session.timeZone", "spark.sql.autoBroadcastJoinThreshold",
              "spark.sql.adaptive.autoBroadcastJoinThreshold",
              "spark.sql.codegen.hugeMethodLimit"):
        spark.conf.set(k, conf[k])
    return spark


def apply_sql_defaults(spark: SparkSession) -> SparkSession:
    """Set the runtime ``spark.sql.*`` defaults on an existing session (for
    sessions built elsewhere, e.g. by a scheduler or notebook)."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session; only when nothing is configured on a local master
    (tests) a private temp folder is set.  On a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not d:
            d = tempfile.mkdtemp(prefix="spendlens-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the checkpoint root for files a job writes
    and later reads back (exports, stream checkpoints, materialised tables)."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def replace_dir(spark: SparkSession, path: str, by: str) -> None:
    """Put the folder ``by`` in the place of ``path``, on the file system that holds both."""
    jvm = spark.sparkContext._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(by), jvm.org.apache.hadoop.fs.Path(path)
    fs = dst.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(dst, True)
    if not fs.rename(src, dst):
        raise RuntimeError(f"could not move {by} to {path}")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def local_path(uri: str) -> str:
    """Strip a ``file:`` scheme for Python-side file helpers used in tests."""
    if uri.startswith("file:"):
        uri = uri[5:]
        while uri.startswith("//"):
            uri = uri[1:]
    return os.path.abspath(uri)


def written(df, name: str, by: list[str] | None = None):
    """Write a table as Parquet in a fresh folder below the checkpoint root and read it again; ``by``
    names columns by whose values it is kept apart, for plans that each read some of them.

    For large intermediate results that several plans read: unlike a checkpoint, which keeps
    serialised rows, it is compressed and each plan reads only its columns and rows.
    """
    return _written_at(df, shared_dir(df.sparkSession, name), by)


@contextmanager
def held(df, name: str, by: list[str] | None = None):
    """``written``, for a table that nothing reads after the block: it is deleted at its end."""
    path = shared_dir(df.sparkSession, name)
    try:
        yield _written_at(df, path, by)
    finally:
        remove_dir(df.sparkSession, path)


# the shuffle files of a statement go when it ends, not when the driver collects its garbage
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written_at(df, path: str, by: list[str] | None):
    spark = df.sparkSession
    before = spark.conf.get(_SHUFFLES_GO, "false")
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.partitionBy(*(by or [])).parquet(path)
    finally:
        spark.conf.set(_SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df):
    """Reliable checkpoint (files under the shared checkpoint root).

    Used for small intermediate results read several times in one plan
    (e.g. a summary that is ranked twice and re-aggregated): it cuts the
    lineage back to the scans and survives executor loss, unlike a local
    checkpoint.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
