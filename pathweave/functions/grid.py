"""Grid cells: index, label, neighbour rings, floor bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.schemas import GridSpec

Grid = GridSpec | DataFrame


def grid_origin(grid: Grid) -> tuple[Column, Column]:
    """Origin of a grid given by literals or by a one-row extent DataFrame.

    An extent DataFrame (columns ``min_lat, min_lon``) travels as scalar
    subqueries, so nothing is collected and no join is planned.
    """
    if isinstance(grid, GridSpec):
        return F.lit(grid.min_lat), F.lit(grid.min_lon)
    return grid.select("min_lat").scalar(), grid.select("min_lon").scalar()


def cell_index(value: Column, origin: Column, cell_size: float) -> Column:
    """Cell number along one axis; the cast truncates toward zero, so a value
    less than one cell below the origin still falls in cell 0. Null where there is no
    such number."""
    return ((value - origin) / F.lit(float(cell_size))).try_cast("int")


def cell_label(cell_i: Column, cell_j: Column) -> Column:
    return F.concat_ws("_", cell_i.cast("string"), cell_j.cast("string"))


def in_ring(
    cell_i: Column, cell_j: Column, centre_i: Column, centre_j: Column, ring: int = 1
) -> Column:
    """Cell lies in the (2*ring+1)^2 block; integer ranges push down to a scan."""
    return cell_i.between(centre_i - ring, centre_i + ring) & cell_j.between(
        centre_j - ring, centre_j + ring
    )


def ring_cells(cell_i: Column, cell_j: Column, ring: int = 1) -> Column:
    """Array of the (i, j) structs of the block around a cell."""
    steps = F.sequence(F.lit(-ring), F.lit(ring))
    return F.flatten(
        F.transform(
            steps,
            lambda di: F.transform(
                steps,
                lambda dj: F.struct(
                    (cell_i + di).alias("cell_i"), (cell_j + dj).alias("cell_j")
                ),
            ),
        )
    )


def floor_bin(value: Column, resolution: float) -> Column:
    return F.floor(value / F.lit(float(resolution)))


def in_floor_bins(
    value: Column, centre: float, resolution: float, ring: int = 1
) -> Column:
    """``floor(value / resolution)`` within ``ring`` bins of the centre's bin.

    The bin test alone hides the column from the scan, so the raw range it
    implies (with one part in 10^9 of slack) goes next to it and is pushed down.
    """
    bin_of = math.floor(centre / resolution)
    slack = 1e-9 * (abs(centre) + resolution)
    return (
        (value >= F.lit((bin_of - ring) * resolution - slack))
        & (value <= F.lit((bin_of + ring + 1) * resolution + slack))
        & floor_bin(value, resolution).between(bin_of - ring, bin_of + ring)
    )
