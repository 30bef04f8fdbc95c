"""Raw logs as they arrive: the batch parser on a file stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.sources.raw_logs import LOG_GLOB, is_complete, log_files, parse_lines

# Bytes of log files in a micro-batch; a larger file is a batch of its own.
BATCH_BYTES = 1 << 30


def stream_raw_logs(
    spark: SparkSession,
    root: str,
    glob: str = LOG_GLOB,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: int = BATCH_BYTES,
) -> DataFrame:
    """Points of every log that appears below ``root``, in the POINTS schema.

    A log is read when it is complete (moved into place), as one row, so this
    suits logs of ordinary size; box predicates and grid cells apply as in batch. A
    micro-batch is bounded by the bytes of its files, so many small logs are few
    batches, or by their number if one is given.
    """
    if max_files_per_trigger is None:
        reader = spark.readStream.option("maxBytesPerTrigger", max_bytes_per_trigger)
    else:
        reader = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    files = log_files(reader, root, glob, wholetext=True)
    lines = files.select(
        F.col("_metadata.file_path").alias("path"),
        F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line_no", "line"),
    )
    return parse_lines(lines).where(is_complete()).drop("path", "line_no", "line")


@contextmanager
def listing_in_few_tasks(spark: SparkSession) -> Iterator[None]:
    """While a stream over many small files runs: every micro-batch lists its files again,
    by default in a task each. The setting is that of the session which made the stream."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)
