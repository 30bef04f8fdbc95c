"""Bounding-box queries over points and over segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from pathweave.functions.predicates import (
    any_point_in_box,
    bounds_overlap_box,
    point_in_box,
    point_within_box,
)
from pathweave.operators.dedup import first_per_position, first_per_rounded_position
from pathweave.operators.segmentation import flatten_segments
from pathweave.schemas import BBox


def bbox_points(
    points: DataFrame,
    box: BBox,
    key: Sequence[str] = ("traj_id",),
    order: Sequence[str] = ("seq",),
    boundary: bool = True,
) -> DataFrame:
    """Points in the box, one row per trajectory and position.

    Works alike on Parquet, CSV and GeoParquet points; the range comparisons
    reach the scan. ``boundary=False`` leaves out points on the edge.
    """
    inside = point_in_box(box) if boundary else point_within_box(box)
    return first_per_position(points.where(inside), key, order)


def segments_overlapping(segments: DataFrame, box: BBox) -> DataFrame:
    """Coarse filter on the stored bounds alone; parts carry those of the segment."""
    return segments.where(bounds_overlap_box(box))


def segments_touching(segments: DataFrame, box: BBox) -> DataFrame:
    """Whole segments with at least one stored point in the box. Where segments have
    several parts, a hit in one of them brings the others along; whether there are
    such segments is asked first, which the column's statistics answer."""
    near = segments.where(bounds_overlap_box(box))
    hit = near.where(any_point_in_box(box))
    if segments.where("part > 0").isEmpty():
        return hit
    return near.join(
        hit.select("entity_id", "segment_id").distinct(),
        ["entity_id", "segment_id"],
        "left_semi",
    )


def refine_points(segments: DataFrame, box: BBox) -> DataFrame:
    """Points of the given segments that lie in the box, de-duplicated:
    ``entity_id, lat, lon, timestamp``."""
    inside = flatten_segments(segments).where(point_in_box(box))
    return first_per_rounded_position(inside)


def bbox_segments(segments: DataFrame, box: BBox, coarse: str = "bounds") -> DataFrame:
    """Filter and refine: bounds first, then the points.

    ``coarse="bounds"`` filters on metadata only, ``coarse="points"`` also drops
    segments without any point in the box before exploding them; the result is
    the same.
    """
    if coarse == "bounds":
        kept = segments_overlapping(segments, box)
    elif coarse == "points":
        kept = segments_touching(segments, box)
    else:
        raise ValueError(f"unknown coarse filter: {coarse!r}")
    return refine_points(kept, box)
