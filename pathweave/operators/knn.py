"""k nearest positions to one query point, over every layout.

Distances are compared after rounding to a micrometre, ties by (lat, lon,
traj_id), so answers do not depend on partitioning or processor.

Exact answers without shuffling every position: any ``k`` distinct positions
bound the k-th distance from above. A first pass hashes positions into a fixed
number of buckets and keeps the nearest distance per bucket; positions of
different buckets differ, so the k-th smallest bucket value is such a bound. The
second pass reads only the degree range within that bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions.distance import (
    haversine,
    law_of_cosines,
    planar_degrees,
    search_box,
    to_micro,
)
from pathweave.functions.grid import cell_index, in_floor_bins, in_ring
from pathweave.functions.predicates import (
    bounds_contain_point,
    bounds_off_globe,
    bounds_overlap_box,
    off_globe,
    point_in_box,
)
from pathweave.operators.dedup import distinct_positions
from pathweave.operators.extent import segment_extent
from pathweave.operators.segmentation import CELL_SIZE
from pathweave.schemas import BBox, GridSpec
from pathweave.session import stored_table

Point = tuple[float, float]
Scan = Callable[[BBox | None], DataFrame]

GUESS_DEGREES = 0.01
KNN_COLUMNS = ("traj_id", "lat", "lon", "distance")


def _nearest(rows: DataFrame, distance: Column, k: int) -> DataFrame:
    """The k first rows by rounded distance, then position and trajectory."""
    return (
        rows.withColumn("distance", distance)
        .select(*KNN_COLUMNS)
        .orderBy(to_micro(F.col("distance")), "lat", "lon", "traj_id")
        .limit(k)
    )


def _bucket_bound(rows: DataFrame, point: Point, k: int) -> tuple[float, BBox] | None:
    """Upper bound of the k-th distance and the degree range it allows.

    None if the rows do not show k distinct positions. Runs one job that returns
    one row; its shuffle holds at most one row per bucket and task.
    """
    # adding 0.0 turns -0.0 into 0.0: equal positions must share a bucket
    bucket = F.pmod(
        F.xxhash64(F.col("lat") + 0.0, F.col("lon") + 0.0), F.lit(max(1024, 16 * k))
    )
    metres = to_micro(haversine(*point, F.col("lat"), F.col("lon")))
    kth = (
        rows.groupBy(bucket.alias("_bucket"))
        .agg(F.min(metres).alias("_metres"))
        .orderBy("_metres")
        .limit(k)
        .agg(F.count("_metres").alias("n"), F.max("_metres").alias("bound"))
    )
    ranges = search_box(*point, F.col("bound"))
    row = kth.select("n", "bound", F.array(*ranges).alias("ranges")).first()
    if row["n"] < k:
        return None
    return row["bound"], BBox(*row["ranges"])


def nearest_positions(
    scan: Scan, point: Point, k: int, guess_degrees: float | None = GUESS_DEGREES
) -> DataFrame:
    """Exact k nearest distinct positions of whatever ``scan`` yields.

    ``scan(box)`` gives ``traj_id, lat, lon`` rows covering at least the box,
    ``scan(None)`` all of them. The bound is first sought within
    ``guess_degrees`` around the point, which on a clustered layout reads a few
    row groups; only if fewer than k positions lie there is everything scanned.
    """
    if k <= 0:
        return _nearest(scan(None), haversine(*point, F.col("lat"), F.col("lon")), 0)
    found = None
    if guess_degrees is not None:
        lat, lon = point
        around = BBox(
            lat - guess_degrees,
            lat + guess_degrees,
            lon - guess_degrees,
            lon + guess_degrees,
        )
        found = _bucket_bound(scan(around), point, k)
    if found is None:
        found = _bucket_bound(scan(None), point, k)
    metres = haversine(*point, F.col("lat"), F.col("lon"))
    if found is None:
        # fewer than k bucket values: at most a few buckets' worth of positions,
        # or k close to the number of positions
        candidates = scan(None)
    else:
        bound, box = found
        candidates = scan(box).where(to_micro(metres) <= bound)
    return _nearest(distinct_positions(candidates), metres, k)


def knn_points(
    points: DataFrame,
    point: Point,
    k: int,
    guess_degrees: float | None = GUESS_DEGREES,
) -> DataFrame:
    """Exact k-NN over raw points; only ``traj_id, lat, lon`` are read."""
    rows = points.select("traj_id", "lat", "lon")

    def scan(box: BBox | None) -> DataFrame:
        return rows if box is None else rows.where(point_in_box(box) | off_globe())

    return nearest_positions(scan, point, k, guess_degrees)


def segment_positions(segments: DataFrame) -> DataFrame:
    """Every stored point of the segments as ``traj_id, lat, lon``."""
    return segments.select(
        F.col("entity_id").alias("traj_id"),
        F.inline(F.arrays_zip(F.col("vals_x").alias("lat"), F.col("vals_y").alias("lon"))),
    ).toDF("traj_id", "lat", "lon")


def knn_segment_points(segments: DataFrame, point: Point, k: int) -> DataFrame:
    """k nearest stored points without de-duplication: a carried-over point
    counts in both of its segments."""
    metres = haversine(*point, F.col("lat"), F.col("lon"))
    return _nearest(segment_positions(segments), metres, k)


def resolve_grid(segments: DataFrame, cell_size: float = CELL_SIZE) -> GridSpec:
    """Grid over the stored bounds, as literals (one job, one row)."""
    row = segment_extent(segments).select("min_lat", "min_lon").first()
    if row["min_lat"] is None:
        return GridSpec(0.0, 0.0, cell_size)
    return GridSpec(row["min_lat"], row["min_lon"], cell_size)


def ring_filter(
    segments: DataFrame, point: Point, grid: GridSpec, ring: int = 1
) -> DataFrame:
    """Segments whose index cell lies within ``ring`` cells of the point's cell.

    Reads ``cell_i, cell_j``; a file that only has the text label ``grid_cell``
    is split on the fly.
    """
    if "cell_i" in segments.columns:
        cell_i, cell_j = F.col("cell_i"), F.col("cell_j")
    else:
        label = F.split("grid_cell", "_")
        cell_i, cell_j = label[0].cast("int"), label[1].cast("int")
    lat, lon = point
    centre_i = int((lat - grid.min_lat) / grid.cell_size)
    centre_j = int((lon - grid.min_lon) / grid.cell_size)
    return segments.where(
        in_ring(cell_i, cell_j, F.lit(centre_i), F.lit(centre_j), ring)
    )


def knn_segments(
    segments: DataFrame,
    point: Point,
    k: int,
    ring: int | None = None,
    grid: GridSpec | None = None,
    cell_size: float = CELL_SIZE,
    guess_degrees: float | None = GUESS_DEGREES,
) -> DataFrame:
    """k-NN over segments, duplicates removed; exact unless ``ring`` is given.

    With ``ring`` only segments indexed within that many cells of the point's
    cell are searched.
    """
    if ring is not None:
        grid = grid or resolve_grid(segments, cell_size)
        segments = ring_filter(segments, point, grid, ring)

    def scan(box: BBox | None) -> DataFrame:
        if box is None:
            return segment_positions(segments)
        near = segments.where(bounds_overlap_box(box) | bounds_off_globe())
        return segment_positions(near)

    return nearest_positions(scan, point, k, guess_degrees)


def nearest_centroids(index: DataFrame, point: Point, n: int) -> DataFrame:
    """The n segments whose centroid is nearest in planar degrees."""
    lat, lon = point
    away = planar_degrees(F.col("centroid_x"), F.col("centroid_y"), lat, lon)
    return index.orderBy(away, "entity_id", "segment_id").limit(n)


def knn_fixed_index(
    index: DataFrame, point: Point, k: int, top_n_centroids: int = 300
) -> DataFrame:
    """Approximate k-NN on the fixed index.

    Searches only segments whose bounds contain the point, and of those the
    ``top_n_centroids`` by centroid. May return fewer than k rows, or none: a
    nearer position in a segment passing close by is missed.
    """
    kept = nearest_centroids(index.where(bounds_contain_point(*point)), point, n=top_n_centroids)
    positions = distinct_positions(segment_positions(kept))
    return _nearest(positions, haversine(*point, F.col("lat"), F.col("lon")), k)


def knn_grid_index(
    index: DataFrame,
    point: Point,
    k: int,
    ring: int = 1,
    grid: GridSpec | None = None,
    cell_size: float = CELL_SIZE,
) -> DataFrame:
    """Approximate k-NN on the grid index, in two phases.

    The index cells around the point name the entities; then all segments of
    those entities are searched. Empty if no cell matches. The entities are
    stored first: their true size decides whether the segments must be shuffled.
    """
    grid = grid or resolve_grid(index, cell_size)
    around = ring_filter(index, point, grid, ring).select("entity_id").distinct()
    entities = stored_table(around, "entities")
    return knn_segments(index.join(entities, "entity_id", "left_semi"), point, k)


def knn_geoparquet(
    points: DataFrame,
    point: Point,
    k: int = 5,
    grid_resolution: float = 0.01,
    grid_ring: int = 1,
) -> DataFrame:
    """Approximate k-NN by floor bins and the arc-cosine distance, duplicates
    kept; points outside the ring of bins are not considered."""
    lat, lon = point
    near = points.where(
        in_floor_bins(F.col("lat"), lat, grid_resolution, grid_ring)
        & in_floor_bins(F.col("lon"), lon, grid_resolution, grid_ring)
    )
    return _nearest(near, law_of_cosines(lat, lon, F.col("lat"), F.col("lon")), k)
