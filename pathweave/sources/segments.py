"""Segments as Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.functions.arrays import decode_doubles, decode_timestamps
from pathweave.functions.predicates import bounds_overlap_box
from pathweave.operators.segmentation import recompute_bounds
from pathweave.operators.time_range import with_time_numbers
from pathweave.schemas import SEGMENTS, SEG_BY_TIME, BBox
from pathweave.sources.layout import clustered

# all that refining reads; only the time bounds stay behind
SCAN_COLUMNS = tuple(c for c in SEGMENTS.fieldNames() if c not in ("min_t", "max_t"))


def write_segments(
    segments: DataFrame,
    path: str,
    mode: str = "errorifexists",
    cluster: bool = True,
    partitions: int | None = None,
    slab_hours: float | None = None,
) -> None:
    """Segments Parquet, clustered by the middle of their bounds.

    With ``slab_hours`` by their start in slabs of so many hours first, and with the
    columns ``first_us, last_us``, so that scans by time skip files and row groups.
    """
    rows = segments if slab_hours is None else with_time_numbers(segments)
    if cluster:
        slab = [] if slab_hours is None else [F.floor(F.col("first_us") / F.lit(slab_hours * 3.6e9))]
        rows = clustered(
            rows,
            (F.col("min_x") + F.col("max_x")) / 2,
            (F.col("min_y") + F.col("max_y")) / 2,
            ["entity_id", "segment_id", "part"],
            partitions=partitions,
            first=slab,
        )
    rows.write.mode(mode).parquet(path)


def read_segments(
    spark: SparkSession,
    path: str,
    schema: T.StructType = SEGMENTS,
    recompute: bool = False,
) -> DataFrame:
    """Stored segments; ``recompute`` takes the bounds from the arrays."""
    segments = spark.read.schema(schema).parquet(path)
    return recompute_bounds(segments) if recompute else segments


def read_segments_by_time(spark: SparkSession, path: str) -> DataFrame:
    """Segments stored with ``slab_hours``."""
    return read_segments(spark, path, SEG_BY_TIME)


def read_foreign_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments Parquet written by other tools: arrays may be stored as text
    (``"{39.98,40.0}"``), times as ISO text, and ``part`` may be missing."""
    raw = spark.read.parquet(path)

    def column(field: T.StructField) -> Column:
        stored = raw.schema[field.name].dataType
        value = F.col(field.name)
        if isinstance(field.dataType, T.ArrayType) and isinstance(stored, T.StringType):
            times = isinstance(field.dataType.elementType, T.TimestampNTZType)
            return decode_timestamps(value) if times else decode_doubles(value)
        return value.cast(field.dataType)

    known = [f for f in SEGMENTS.fields if f.name in raw.columns]
    rest = [c for c in raw.columns if c not in SEGMENTS.fieldNames()]
    out = raw.select(*[column(f).alias(f.name) for f in known], *rest)
    if "part" not in raw.columns:
        out = out.withColumn("part", F.lit(0).cast("long"))
    ordered = [c for c in SEGMENTS.fieldNames() if c in out.columns]
    return out.select(*ordered, *rest)


def scan_segments(
    segments: DataFrame, box: BBox, columns: Sequence[str] | None = SCAN_COLUMNS
) -> DataFrame:
    """Segments whose bounds overlap the box, with only the named columns (None:
    all); predicates and columns both reach the scan."""
    kept = segments.where(bounds_overlap_box(box))
    return kept if columns is None else kept.select(*columns)
