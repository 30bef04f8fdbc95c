"""k-NN indexes: columns added to stored segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.arrays import array_mean
from pathweave.functions.grid import Grid
from pathweave.operators.extent import segment_extent, with_cells
from pathweave.operators.segmentation import CELL_SIZE, recompute_bounds


def fixed_index(segments: DataFrame) -> DataFrame:
    """Bounds from the arrays, plus the mean position ``centroid_x/_y``.

    The carried-over point counts in the mean.
    """
    return recompute_bounds(segments).withColumns(
        {
            "centroid_x": array_mean(F.col("vals_x")),
            "centroid_y": array_mean(F.col("vals_y")),
        }
    )


def grid_index(
    segments: DataFrame,
    cell_size: float = CELL_SIZE,
    grid: Grid | None = None,
    anchor: str = "first_point",
) -> DataFrame:
    """Add ``cell_i, cell_j, grid_cell`` to grid segments.

    The grid spans the segment bounds unless one is given. With
    ``anchor="first_point"`` the cell is that of the first stored point, which
    for all but the first segment is the point carried over from the previous
    cell; ``anchor="own_cell"`` takes the cell the segment was cut for (its last
    point lies there).
    """
    if anchor not in ("first_point", "own_cell"):
        raise ValueError(f"unknown anchor: {anchor!r}")
    grid = segment_extent(segments) if grid is None else grid
    if anchor == "own_cell":
        anchored = _anchored(segments, -1)
    else:
        anchored = _anchored(segments.where(F.col("part") == 0), 1).unionByName(
            _later_parts(segments)
        )
    return with_cells(anchored, grid, cell_size, "_lat", "_lon").drop("_lat", "_lon")


def _anchored(segments: DataFrame, at: int) -> DataFrame:
    return segments.withColumns(
        {
            "_lat": F.try_element_at("vals_x", F.lit(at)),
            "_lon": F.try_element_at("vals_y", F.lit(at)),
        }
    )


def _later_parts(segments: DataFrame) -> DataFrame:
    """Rows with ``part`` > 0, anchored at the first point of part 0."""
    identity = ["entity_id", "segment_id"]
    later = segments.where(F.col("part") > 0)
    continued = segments.where(F.col("part") == 1).select(*identity)
    heads = _anchored(
        segments.where(F.col("part") == 0).select(*identity, "vals_x", "vals_y"), 1
    ).select(*identity, "_lat", "_lon")
    return later.join(heads.join(continued, identity, "left_semi"), identity).select(
        *segments.columns, "_lat", "_lon"
    )
