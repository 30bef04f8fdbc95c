"""Cutting trajectories into segments.

Points must carry a dense zero-based ``seq`` per entity (see
:mod:`pathweave.operators.ordering`). Every segment after the first starts with
the last point of the one before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.functions.grid import Grid
from pathweave.operators.extent import with_cells
from pathweave.session import stored_table

FIXED_SEGMENT_POINTS = 100
CELL_SIZE = 0.001
# A segment with more points is stored as several rows (``part``), each of which
# carries the bounds of the whole segment.
PART_POINTS = 100_000
_BOUNDS = ("min_x", "max_x", "min_y", "max_y", "min_t", "max_t")


def _entity(key: Sequence[str]) -> Column:
    """Entity id: the key column, or ``user/trajectory`` for a compound key."""
    if len(key) == 1:
        return F.col(key[0]).cast("string")
    return F.concat_ws("/", *key)


def build_segments(members: DataFrame, *extra: Column) -> DataFrame:
    """SEGMENTS rows from flat members.

    ``members`` has ``entity_id, segment_id, part, pos, lat, lon, timestamp``;
    the caller bounds the members of one ``part``. Bounds (and ``extra``
    aggregates) are taken in the same aggregation as the arrays.
    """
    point = F.struct("pos", "lat", "lon", "timestamp")
    return members.groupBy("entity_id", "segment_id", "part").agg(
        F.sort_array(F.collect_list(point)).alias("_points"),
        F.min("lat").alias("min_x"),
        F.max("lat").alias("max_x"),
        F.min("lon").alias("min_y"),
        F.max("lon").alias("max_y"),
        F.min("timestamp").alias("min_t"),
        F.max("timestamp").alias("max_t"),
        *extra,
    )


def _segment_columns() -> list[Column]:
    points = F.col("_points")
    return [
        F.col("entity_id"),
        F.col("segment_id"),
        F.col("part"),
        points["lat"].alias("vals_x"),
        points["lon"].alias("vals_y"),
        points["timestamp"].alias("vals_t"),
        *[F.col(c) for c in ("min_x", "max_x", "min_y", "max_y", "min_t", "max_t")],
    ]


def finish_segments(members: DataFrame) -> DataFrame:
    """SEGMENTS rows of flat members (see :func:`build_segments`), each part with the
    bounds of its own points."""
    return build_segments(members).select(*_segment_columns())


def with_segment_bounds(rows: DataFrame) -> DataFrame:
    """Give every part of a segment the bounds of all its parts.

    Writes ``rows`` once; only segments of several parts are looked at, by one small
    row each.
    """
    stored = stored_table(rows, "segment-parts")
    whole = (
        stored.groupBy("entity_id", "segment_id")
        .agg(
            F.max("part").alias("_parts"),
            *[getattr(F, c[:3])(c).alias(f"_{c}") for c in _BOUNDS],
        )
        .where("_parts > 0")
        .drop("_parts")
    )
    joined = stored.join(whole, ["entity_id", "segment_id"], "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in _BOUNDS}).select(
        *rows.columns
    )


def _longest(points: DataFrame, key: Sequence[str]) -> int:
    """Points of the longest trajectory; reads the key columns alone."""
    counts = points.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def fixed_members(
    points: DataFrame,
    max_segment_size: int = FIXED_SEGMENT_POINTS,
    key: Sequence[str] = ("traj_id",),
    part_points: int = PART_POINTS,
) -> DataFrame:
    """One row per stored point of the fixed-size segments.

    The block of a point follows from ``seq`` alone, so no window is needed and a
    huge trajectory spreads over all tasks. The last point of a block also goes
    to the next block (``pos`` -1 there). ``part`` counts pieces of ``part_points``.
    """
    size = int(max_segment_size)
    if size < 1:
        raise ValueError(f"segment size must be positive: {size}")
    block, offset = F.expr(f"seq div {size}"), F.expr(f"seq % {size}")
    homes = F.when(
        offset == size - 1,
        F.array(
            F.struct(block.alias("segment_id"), offset.alias("pos")),
            F.struct((block + 1).alias("segment_id"), F.lit(-1).cast("long").alias("pos")),
        ),
    ).otherwise(F.array(F.struct(block.alias("segment_id"), offset.alias("pos"))))
    flat = points.select(
        _entity(key).alias("entity_id"), F.inline(homes), "lat", "lon", "timestamp"
    )
    part = F.greatest(F.expr(f"pos div {int(part_points)}"), F.lit(0)).cast("long")
    return flat.withColumn("part", part)


def fixed_segments(
    points: DataFrame,
    max_segment_size: int = FIXED_SEGMENT_POINTS,
    key: Sequence[str] = ("traj_id",),
    part_points: int = PART_POINTS,
) -> DataFrame:
    """Segments of ``max_segment_size`` points, plus the carried-over one; rows as
    for :func:`grid_segments`."""
    members = fixed_members(points, max_segment_size, key, part_points)
    grouped = build_segments(members, F.max("pos").alias("_last"))
    # a block that received only a carried-over point does not exist
    rows = grouped.where(F.col("_last") >= 0).select(*_segment_columns())
    return with_segment_bounds(rows) if max_segment_size > part_points else rows


def grid_members(
    points: DataFrame,
    grid: Grid,
    cell_size: float = CELL_SIZE,
    key: Sequence[str] = ("traj_id",),
    part_points: int = PART_POINTS,
) -> DataFrame:
    """One row per stored point of the grid-transition segments.

    A new segment starts whenever the cell differs from the previous point's
    cell. To keep a huge trajectory out of a single task, transitions are found
    inside chunks of ``part_points`` consecutive points; one summary row per
    chunk then tells the next chunks how many segments lie before them, in which
    cell the previous chunk ended and where the segment still open there began.
    """
    size = int(part_points)
    keyed = with_cells(points, grid, cell_size, label=False).select(
        _entity(key).alias("entity_id"),
        F.expr(f"seq div {size}").alias("chunk"),
        "seq",
        "lat",
        "lon",
        "timestamp",
        F.struct("cell_i", "cell_j").alias("cell"),
    )
    in_order = Window.partitionBy("entity_id", "chunk").orderBy("seq")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = keyed.withColumns(
        {
            "_prev": F.lag("cell").over(in_order),
            "_next": F.lead("cell").over(in_order),
        }
    ).withColumn(
        "_starts", F.coalesce(F.col("_prev") != F.col("cell"), F.lit(False))
    )
    local = marked.withColumns(
        {
            "_local": F.sum(F.col("_starts").cast("long")).over(so_far),
            "_start": F.max(F.when(F.col("_starts"), F.col("seq"))).over(so_far),
        }
    )

    chunks = marked.groupBy("entity_id", "chunk").agg(
        F.sum(F.col("_starts").cast("long")).alias("_inner"),
        F.max(F.when(F.col("_starts"), F.col("seq"))).alias("_last_start"),
        F.min("seq").alias("_first_seq"),
        F.min_by("cell", "seq").alias("_first_cell"),
        F.max_by("cell", "seq").alias("_last_cell"),
    )
    by_chunk = Window.partitionBy("entity_id").orderBy("chunk")
    linked = chunks.withColumns(
        {
            "_before": F.lag("_last_cell").over(by_chunk),
            "_after": F.lead("_first_cell").over(by_chunk),
        }
    ).withColumn(
        # the chunk's first point opens a segment of its own
        "_opens",
        F.col("_before").isNull() | (F.col("_before") != F.col("_first_cell")),
    )
    # base counts the openings up to this chunk and the inner starts before it
    summary = linked.select(
        "entity_id",
        "chunk",
        (
            F.sum(F.col("_opens").cast("long") + F.col("_inner")).over(
                by_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            )
            - F.col("_inner")
            - 1
        ).alias("_base"),
        F.when(F.col("_opens"), F.col("_first_seq"))
        .otherwise(
            F.last(
                F.coalesce(
                    "_last_start", F.when(F.col("_opens"), F.col("_first_seq"))
                ),
                ignorenulls=True,
            ).over(by_chunk.rowsBetween(Window.unboundedPreceding, -1))
        )
        .alias("_open_start"),
        "_after",
    )

    segment = F.col("_base") + F.col("_local")
    start = F.coalesce("_start", "_open_start")
    pos = F.col("seq") - start
    own = F.struct(
        segment.alias("segment_id"),
        F.expr(f"_pos div {size}").alias("part"),
        F.col("_pos").alias("pos"),
    )
    carried = F.struct(
        (segment + 1).alias("segment_id"),
        F.lit(0).cast("long").alias("part"),
        F.lit(-1).cast("long").alias("pos"),
    )
    ends = F.coalesce(F.coalesce("_next", "_after") != F.col("cell"), F.lit(False))
    return (
        local.join(summary, ["entity_id", "chunk"])
        .withColumn("_pos", pos)
        .select(
            "entity_id",
            F.inline(F.when(ends, F.array(own, carried)).otherwise(F.array(own))),
            "lat",
            "lon",
            "timestamp",
        )
    )


def short_grid_members(
    points: DataFrame,
    grid: Grid,
    cell_size: float = CELL_SIZE,
    key: Sequence[str] = ("traj_id",),
    part_points: int = PART_POINTS,
) -> DataFrame:
    """``grid_members`` of trajectories that each fit a task: rows are shuffled by entity
    once, which also serves the grouping into segments and parts."""
    keyed = with_cells(points, grid, cell_size, label=False).select(
        _entity(key).alias("entity_id"),
        "seq",
        "lat",
        "lon",
        "timestamp",
        F.struct("cell_i", "cell_j").alias("cell"),
    )
    in_order = Window.partitionBy("entity_id").orderBy("seq")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = keyed.withColumns(
        {
            "_starts": F.coalesce(F.lag("cell").over(in_order) != F.col("cell"), F.lit(False)),
            "_ends": F.coalesce(F.lead("cell").over(in_order) != F.col("cell"), F.lit(False)),
        }
    )
    start = F.coalesce(F.max(F.when(F.col("_starts"), F.col("seq"))).over(so_far), F.min("seq").over(so_far))
    placed = marked.withColumns({"_segment": F.sum(F.col("_starts").cast("long")).over(so_far), "_pos": F.col("seq") - start})

    def at(segment: Column, part: Column, pos: Column) -> Column:
        return F.struct(segment.alias("segment_id"), part.cast("long").alias("part"), pos.cast("long").alias("pos"))

    own = at(F.col("_segment"), F.expr(f"_pos div {int(part_points)}"), F.col("_pos"))
    carried = at(F.col("_segment") + 1, F.lit(0), F.lit(-1))
    homes = F.when(F.col("_ends"), F.array(own, carried)).otherwise(F.array(own))
    return placed.select("entity_id", F.inline(homes), "lat", "lon", "timestamp")


def grid_segments(
    points: DataFrame,
    grid: Grid,
    cell_size: float = CELL_SIZE,
    key: Sequence[str] = ("traj_id",),
    part_points: int = PART_POINTS,
) -> DataFrame:
    """Segments cut at every grid-cell transition.

    A segment is one row unless it holds more than ``part_points`` points (an
    entity that does not move): then it continues in rows ``part`` = 1, 2, ...
    of the same ``segment_id``, each with the bounds of the whole segment. A first
    job finds out whether any trajectory is long enough for that, or too long for a task.
    """
    longest = _longest(points, key)
    if longest <= max(part_points, PART_POINTS):
        rows = finish_segments(short_grid_members(points, grid, cell_size, key, part_points))
        if longest <= part_points:
            return rows
        # the rows of an entity are in one task already
        whole = Window.partitionBy("entity_id", "segment_id")
        return rows.withColumns({c: getattr(F, c[:3])(c).over(whole) for c in _BOUNDS})
    members = grid_members(points, grid, cell_size, key, part_points)
    return with_segment_bounds(finish_segments(members))


def recompute_bounds(segments: DataFrame) -> DataFrame:
    """Replace the stored bounds by those of the stored arrays, over all parts."""
    own = segments.withColumns(
        {
            f"{edge}_{axis}": getattr(F, f"array_{edge}")(f"vals_{axis}")
            for axis in ("x", "y", "t")
            for edge in ("min", "max")
        }
    )
    if segments.where("part > 0").isEmpty():
        return own
    return with_segment_bounds(own)


def flatten_segments(segments: DataFrame) -> DataFrame:
    """Stored points of segments, one row each, with their position."""
    return segments.select(
        "entity_id",
        "segment_id",
        "part",
        F.posexplode(F.arrays_zip("vals_x", "vals_y", "vals_t")).alias("pos", "_p"),
    ).select(
        "entity_id",
        "segment_id",
        "part",
        "pos",
        F.col("_p.vals_x").alias("lat"),
        F.col("_p.vals_y").alias("lon"),
        F.col("_p.vals_t").alias("timestamp"),
    )
