"""Session settings and lineage control."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits the oversized side of a join by map output, which is what spreads
    # one hot URL or one hot category over many tasks.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Accept an extra shuffle rather than one task with a third of the rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# Settable only while a session is built.
STATIC_SETTINGS = {
    # Call-site capture costs several round trips per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Checkpoints of finished loops leave the shared folder with their tables.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app_name: str = "sitefold", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **STATIC_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A temporary one takes its place on a local master only:
    elsewhere executors would each write to a disk of their own."""
    context = spark.sparkContext
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
    )
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_SCOPES: list[list[str]] = []


@contextmanager
def landing_scope(spark: SparkSession) -> Iterator[None]:
    """What is landed inside goes when the scope ends, so nothing that outlives it may read from there."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            drop_folder(spark, path)


def work_folder(spark: SparkSession) -> str:
    """A new folder of the shared storage; it goes with the scope that it is made in."""
    path = f"{shared_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def landed(df: DataFrame) -> DataFrame:
    """The table written to Parquet in the shared folder and read again: computed once, read by column."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def landed_once(df: DataFrame) -> Iterator[DataFrame]:
    """The landed table for as long as it is in use; its files go afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        drop_folder(spark, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage and all that is in it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise on shared storage, so that a lost executor never replays a loop."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
