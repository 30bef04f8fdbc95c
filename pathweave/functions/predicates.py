"""Box predicates on points and on segment bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathweave.schemas import BBox


def point_in_box(box: BBox, lat: str = "lat", lon: str = "lon") -> Column:
    """Closed on all four sides (a point geometry *intersects* the box)."""
    return F.col(lat).between(box.min_lat, box.max_lat) & F.col(lon).between(
        box.min_lon, box.max_lon
    )


def point_within_box(box: BBox, lat: str = "lat", lon: str = "lon") -> Column:
    """Open on all four sides (a point geometry lies *within* the box)."""
    return (
        (F.col(lat) > box.min_lat)
        & (F.col(lat) < box.max_lat)
        & (F.col(lon) > box.min_lon)
        & (F.col(lon) < box.max_lon)
    )


def bounds_overlap_box(box: BBox) -> Column:
    """Closed overlap of a segment's bounds (x is latitude) with the box."""
    return (
        (F.col("max_x") >= box.min_lat)
        & (F.col("min_x") <= box.max_lat)
        & (F.col("max_y") >= box.min_lon)
        & (F.col("min_y") <= box.max_lon)
    )


def bounds_contain_point(lat: float, lon: float) -> Column:
    return (
        (F.col("min_x") <= lat)
        & (F.col("max_x") >= lat)
        & (F.col("min_y") <= lon)
        & (F.col("max_y") >= lon)
    )


def any_point_in_box(box: BBox) -> Column:
    """Some stored point of the segment lies in the box; reads the arrays in
    place, without exploding them."""
    return F.exists(
        F.arrays_zip("vals_x", "vals_y"),
        lambda p: p["vals_x"].between(box.min_lat, box.max_lat)
        & p["vals_y"].between(box.min_lon, box.max_lon),
    )


def off_globe(lat: str = "lat", lon: str = "lon") -> Column:
    """Coordinates outside the usual degree ranges.

    Great-circle formulas are periodic, so such a position (a faulty latitude of
    400, a longitude counted to 360) can still be near; range pruning must let
    it through. Each side is a bare comparison, so row groups are still pruned.
    """
    return (
        (F.col(lat) > 90.0)
        | (F.col(lat) < -90.0)
        | (F.col(lon) > 180.0)
        | (F.col(lon) < -180.0)
    )


def bounds_off_globe() -> Column:
    return (
        (F.col("max_x") > 90.0)
        | (F.col("min_x") < -90.0)
        | (F.col("max_y") > 180.0)
        | (F.col("min_y") < -180.0)
    )
