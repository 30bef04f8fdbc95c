"""Extent of the data and grid cells of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.grid import Grid, cell_index, cell_label, grid_origin


def point_extent(points: DataFrame) -> DataFrame:
    """One row ``min_lat, max_lat, min_lon, max_lon`` over all points."""
    return points.agg(
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"),
    )


def segment_extent(segments: DataFrame) -> DataFrame:
    """The same row from segment bounds (x is latitude)."""
    return segments.agg(
        F.min("min_x").alias("min_lat"),
        F.max("max_x").alias("max_lat"),
        F.min("min_y").alias("min_lon"),
        F.max("max_y").alias("max_lon"),
    )


def with_cells(
    df: DataFrame,
    grid: Grid,
    cell_size: float | None = None,
    lat: str = "lat",
    lon: str = "lon",
    label: bool = True,
) -> DataFrame:
    """Add ``cell_i, cell_j`` and, unless ``label`` is off, ``grid_cell``.

    ``grid`` is a :class:`GridSpec` or a one-row extent DataFrame; with the
    latter ``cell_size`` defaults to 0.001 degrees.
    """
    if cell_size is None:
        cell_size = getattr(grid, "cell_size", 0.001)
    origin_lat, origin_lon = grid_origin(grid)
    out = df.withColumns(
        {
            "cell_i": cell_index(F.col(lat), origin_lat, cell_size),
            "cell_j": cell_index(F.col(lon), origin_lon, cell_size),
        }
    )
    if label:
        out = out.withColumn("grid_cell", cell_label(F.col("cell_i"), F.col("cell_j")))
    return out
