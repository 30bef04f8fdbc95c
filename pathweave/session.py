"""Session defaults and intermediate tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that hold for any cluster size; partition counts are left to AQE.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_local_roots: dict[str, str] = {}


def with_defaults(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder the cluster shares (``spark.checkpoint.dir``).

    Without that setting the folder of ``setCheckpointDir`` is taken, and without
    either a temporary one, if the session runs on this machine alone; a cluster
    must name a folder that all its machines see.
    """
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, without a slash at the end."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(
                "set spark.checkpoint.dir to a folder that driver and executors share"
            )
        app = context.applicationId
        if app not in _local_roots:
            # one machine: any folder of its own will do
            _local_roots[app] = tempfile.mkdtemp(prefix="pathweave-")
        root = _local_roots[app]
    return root.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files: they go with the job that made
    them, as nothing reads them again, and not only when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read back.

    Cuts the lineage, survives lost executors, and gives the planner the true
    size, so that a following join broadcasts it only if it is small enough and
    otherwise shuffles, without guessing. It goes when the application ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    # nothing reads it after the application
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged_table(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``stored_table`` for the time of a block; then its files go."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(place)
    try:
        with shuffles_dropped(spark):
            df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        files.delete(place, True)
