"""Segments by place and time: one question, or a table of (box, from, to)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions.predicates import bounds_overlap_box, point_in_box
from pathweave.functions.pyramid import shifted, spanning_level
from pathweave.functions.times import base_slab, micros, micros_of
from pathweave.operators.bbox_batch import BOX_COLUMNS
from pathweave.operators.dedup import first_per_rounded_position
from pathweave.operators.folding import stored_folds
from pathweave.operators.rectangle_join import (
    HOT_ROWS,
    SEGMENT_COLUMNS,
    SEGMENT_KEY,
    match_rectangles,
    members_in_boxes,
)
from pathweave.operators.segmentation import flatten_segments
from pathweave.schemas import BBox

#: Time bounds as numbers, which layouts by time store beside ``min_t, max_t``.
NUMBER_COLUMNS = ("first_us", "last_us")
TIME_COLUMNS = ("from_t", "to_t")


def with_time_numbers(segments: DataFrame) -> DataFrame:
    """``segments`` with ``first_us, last_us``, the microseconds of their time bounds."""
    first, last = NUMBER_COLUMNS
    return segments.withColumns({first: micros("min_t"), last: micros("max_t")})


def bounds_overlap_times(segments: DataFrame, start: datetime, end: datetime) -> Column:
    """Closed overlap of the stored time bounds with a range; on numbers where the
    layout has them, as only these let a scan skip row groups."""
    first, last = NUMBER_COLUMNS
    if first in segments.columns and last in segments.columns:
        return (F.col(last) >= micros_of(start)) & (F.col(first) <= micros_of(end))
    return (F.col("max_t") >= F.lit(start).cast("timestamp_ntz")) & (F.col("min_t") <= F.lit(end).cast("timestamp_ntz"))


def segments_between(segments: DataFrame, box: BBox, start: datetime, end: datetime) -> DataFrame:
    """Coarse filter on the stored bounds of place and time alone (all closed)."""
    return segments.where(bounds_overlap_box(box) & bounds_overlap_times(segments, start, end))


def bbox_segments_between(segments: DataFrame, box: BBox, start: datetime, end: datetime) -> DataFrame:
    """Points in the box from ``start`` to ``end`` (closed, without zone), one per entity
    and rounded position: ``entity_id, lat, lon, timestamp``. Of repeated positions the
    first within the range stays; points without a time lie in no range."""
    literal = [F.lit(t).cast("timestamp_ntz") for t in (start, end)]
    inside = point_in_box(box) & F.col("timestamp").between(*literal)
    return first_per_rounded_position(flatten_segments(segments_between(segments, box, start, end)).where(inside))


def match_segments_between(segments: DataFrame, boxes: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``box_id``, the box, ``from_t, to_t``, ``entity_id, segment_id, part`` of every
    segment whose bounds overlap a box in place and time. Only bounds and keys are read.

    Place and time meet in one join, so a crowded place with a long history costs a
    short range only what lies in its slabs. Segments with the same bounds whose times
    lie in one slab, of the size their own length asks for, meet the boxes as one row.
    """
    narrow = segments.select(*SEGMENT_KEY, *SEGMENT_COLUMNS, "min_t", "max_t").where("min_t <= max_t")
    numbered = narrow.withColumns({"_k0": base_slab("min_t"), "_k1": base_slab("max_t")}).withColumn("_slabs", spanning_level(F.col("_k0"), F.col("_k1")))
    slabs = numbered.withColumn("_slab", shifted("_k0", "_slabs")).drop("_k0", "_k1")
    places = stored_folds(slabs, [*SEGMENT_COLUMNS, "_slabs", "_slab"], "_held")
    whole = places.withColumns({"_from": F.array_min("_held.min_t"), "_to": F.array_max("_held.max_t")}).drop("_slabs", "_slab")
    asked = boxes.select("box_id", *BOX_COLUMNS, *(F.col(t).cast("timestamp_ntz").alias(t) for t in TIME_COLUMNS))
    found = match_rectangles(asked, whole, BOX_COLUMNS, SEGMENT_COLUMNS, hot_rows, TIME_COLUMNS, ("_from", "_to"))
    pairs = found.select("box_id", *BOX_COLUMNS, *TIME_COLUMNS, F.inline("_held"))
    met = (F.col("max_t") >= F.col("from_t")) & (F.col("min_t") <= F.col("to_t"))
    return pairs.where(met).select("box_id", *BOX_COLUMNS, *TIME_COLUMNS, *SEGMENT_KEY)


def bbox_batch_between(segments: DataFrame, boxes: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """``bbox_segments_between`` for every row ``box_id, min_lat, max_lat, min_lon,
    max_lon, from_t, to_t``, with ``box_id`` in front.

    No row of the result is shuffled (see ``members_in_boxes``).
    """
    asked = boxes.select("box_id", *BOX_COLUMNS, *(F.col(t).cast("timestamp_ntz").alias(t) for t in TIME_COLUMNS))
    return members_in_boxes(segments, asked, hot_rows, TIME_COLUMNS)
