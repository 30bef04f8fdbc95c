"""Rows and bytes of stored layouts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathweave.functions.scalars import percent_above

PROFILE_SCHEMA = (
    "name string, rows bigint, n_files bigint, size_bytes bigint,"
    " percent_above_smallest double, size_rank int"
)


def file_profile(layout: DataFrame) -> DataFrame:
    """``path, rows, size_bytes`` per file of a file-based DataFrame."""
    return (
        layout.select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size_bytes"),
        )
        .groupBy("path", "size_bytes")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("path", "rows", "size_bytes")
    )


def layout_profile(
    spark: SparkSession, layouts: Mapping[str, DataFrame], by: str = "size_bytes"
) -> DataFrame:
    """Size of each layout next to the smallest one, by bytes or by ``rows``. The rows
    of a segment layout are segments (or parts of them). Without layouts the report
    is empty."""
    if by not in ("size_bytes", "rows"):
        raise ValueError(f"unknown measure: {by!r}")
    if not layouts:
        return spark.createDataFrame([], PROFILE_SCHEMA)
    sizes = reduce(
        DataFrame.unionByName,
        [
            file_profile(layout)
            .agg(
                F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                F.count("path").alias("n_files"),
                F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"),
            )
            .select(F.lit(name).alias("name"), "rows", "n_files", "size_bytes")
            for name, layout in layouts.items()
        ],
    )
    # one row per layout: an unpartitioned window is fine
    smallest = F.min(by).over(Window.partitionBy())
    return sizes.withColumn("_smallest", smallest).select(
        "name",
        "rows",
        "n_files",
        "size_bytes",
        percent_above(F.col(by), F.col("_smallest")).alias(
            "percent_above_smallest"
        ),
        F.dense_rank().over(Window.orderBy(by)).alias("size_rank"),
    )
