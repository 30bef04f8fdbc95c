"""Query results as CSV or JSON, grouped by run."""

from __future__ import annotations

import os
import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_result(
    result: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists"
) -> None:
    """One result as CSV with header or as JSON lines; WKB geometry is left out."""
    flat = result.drop("geometry")
    if fmt == "csv":
        flat.write.mode(mode).option("header", True).csv(path)
    elif fmt == "json":
        flat.write.mode(mode).json(path)
    else:
        raise ValueError(f"unknown result format: {fmt!r}")


def table_folder(result: DataFrame) -> str:
    """The sub-folder for results with these columns. Files of one folder are one
    table, so results of other columns must not share it."""
    return "-".join(c for c in result.columns if c != "geometry")


def next_run_id(spark: SparkSession, root: str) -> int:
    """One more than the largest ``run_id=`` folder in any table below ``root``; 1 if
    there is none."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/run_id=*")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(pattern) or []
    numbers = [re.fullmatch(r"run_id=(\d+)", x.getPath().getName()) for x in found]
    return max((int(m[1]) for m in numbers if m), default=0) + 1


def claim_run_id(spark: SparkSession, root: str) -> int:
    """The next free run number, taken for the caller alone.

    A number belongs to whoever creates its file below ``_claims``, which only one of
    several can; the others go on to the next one. A run that fails leaves its number
    unused.
    """
    number = next_run_id(spark, root)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_claims")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    while not _created(spark, fs, f"{folder.toString()}/{number}"):
        number += 1
    return number


def _created(spark: SparkSession, fs, path: str) -> bool:
    """Whether this call made the file; False if it was there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getUri().getScheme() == "file":
        # Hadoop's local file system first looks and then creates
        try:
            os.close(os.open(place.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        fs.create(place, False).close()
    except Py4JJavaError as error:
        if fs.exists(place):
            return False
        raise error
    return True


def method_slug(name: str) -> str:
    """A display name as a folder name: letters and digits, joined by ``_``."""
    return "_".join(re.findall(r"[a-z0-9]+", name.lower()))


def read_runs(spark: SparkSession, root: str, like: DataFrame) -> DataFrame:
    """All stored CSV results with the columns of ``like``, with run_id and method."""
    kept = like.drop("geometry").schema
    schema = kept.add("run_id", T.IntegerType()).add("method", T.StringType())
    return (
        spark.read.schema(schema)
        .option("header", True)
        .csv(f"{root.rstrip('/')}/{table_folder(like)}")
    )


def append_run(
    results: dict[str, DataFrame], root: str, run_id: int | None = None, fmt: str = "csv"
) -> int:
    """Store the named results of one run under
    ``<columns>/run_id=<n>/method=<name>``: a table for each set of columns. Without
    ``run_id`` a number is claimed that no other run gets."""
    if not results:
        raise ValueError("no results to store")
    spark = next(iter(results.values())).sparkSession
    if run_id is None:
        run_id = claim_run_id(spark, root)
    for name, result in results.items():
        path = f"{root.rstrip('/')}/{table_folder(result)}"
        write = (
            result.drop("geometry")
            .withColumns({"run_id": F.lit(run_id), "method": F.lit(method_slug(name))})
            .write.mode("append")
            .partitionBy("run_id", "method")
        )
        if fmt == "csv":
            write.option("header", True).csv(path)
        elif fmt == "json":
            write.json(path)
        else:
            raise ValueError(f"unknown result format: {fmt!r}")
    return run_id
