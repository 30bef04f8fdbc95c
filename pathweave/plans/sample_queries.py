"""One query per operator over the sample views, each with its SQL twin.

Distances are compared after rounding (half-even) to six decimals, and rows are
ranked by the rounded distance, then by position and trajectory.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions.arrays import decode_doubles, encode_doubles
from pathweave.functions.distance import to_micro
from pathweave.functions.grid import ring_cells
from pathweave.functions.predicates import bounds_contain_point
from pathweave.functions.scalars import iso_text
from pathweave.operators import bbox, knn, segmentation, trajectories
from pathweave.operators.bbox_batch import bbox_batch
from pathweave.operators.certificate import proven_knn_fixed_index
from pathweave.operators.compare import compare_knn, layout_parity
from pathweave.operators.differences import as_positions, layout_agreement, layout_differences
from pathweave.operators.extent import point_extent, segment_extent, with_cells
from pathweave.operators.index import fixed_index, grid_index
from pathweave.operators.knn_batch import knn_batch
from pathweave.operators.knn_batch_segments import knn_batch_segments
from pathweave.operators.profile import layout_profile
from pathweave.operators.ordering import renumber
from pathweave.operators.rectangle_join import bbox_batch_segments, match_segments
from pathweave.operators.time_range import (
    bbox_batch_between,
    bbox_segments_between,
    match_segments_between,
    segments_between,
)
from pathweave.plans.evaluation import CATEGORIES, bbox_report, bbox_results
from pathweave.plans.stored import stored_layout, stored_layouts
from pathweave.plans.table_views import (
    LINEITEM_ORDER,
    customer_boxes,
    customer_boxes_in_time,
    event_points,
    event_rows,
    lineitem_points,
    lineitem_rows,
    supplier_queries,
)
from pathweave.schemas import SEGMENTS, BBox, GridSpec
from pathweave.session import shared_folder, stored_table
from pathweave.sources.geoparquet import (
    read_geoparquet,
    without_geometry,
    write_geoparquet,
)
from pathweave.sources.raw_logs import (
    is_complete,
    parse_lines,
    read_malformed_lines,
    read_raw_logs,
    write_log_lines,
)
from pathweave.sources.results import append_run, read_runs
from pathweave.sources.segments import (
    read_segments_by_time,
    scan_segments,
    write_segments,
)
from pathweave.streaming.live_logs import listing_in_few_tasks, stream_raw_logs
from pathweave.streaming.live_segments import (
    segments_of_members,
    stream_fixed_members,
    stream_grid_members,
)

Query = Callable[[SparkSession, str], DataFrame]

BOX = BBox(40.0, 40.005, 116.312, 116.3145)
HALF_BOX = BBox(40.0, 40.0025, 116.312, 116.3145)
OUTSIDE_BOX = BBox(39.9840, 39.9850, 116.3160, 116.3185)
POINT = (40.0035, 116.3133)
# off every symmetry line of the view, so arc-cosine noise cannot reorder rows
GEO_POINT = (40.003513, 116.313337)
FAR_POINT = (40.05, 116.35)
K = 10
CELL = segmentation.CELL_SIZE
EVENT_SEGMENT = 10

POINT_COLUMNS = ["traj_id", "lat", "lon", "altitude", "timestamp"]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its twin."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


# ---------------------------------------------------------------- SQL pieces

ROWS = """
raw AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS traj_id,
         39.98e0 + (datediff('day', TIMESTAMP '1992-01-01', l_shipdate) // 4)
           / 25000e0 AS lat,
         116.31e0 + (l_suppkey % 7) / 1000e0 + l_linenumber / 10000e0 AS lon,
         l_quantity AS altitude, l_shipdate AS "timestamp",
         l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM lineitem),
pts AS (
  SELECT traj_id,
         row_number() OVER (PARTITION BY traj_id ORDER BY "timestamp", l_orderkey,
           l_linenumber, l_partkey, l_extendedprice) - 1 AS seq,
         lat, lon, altitude, "timestamp"
  FROM raw)"""

EVENT_ROWS = """
pts AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 12, '0') AS traj_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
         40e0 + (event_id // 50) / 10000e0 AS lat,
         116.31e0 + (user_id % 7) / 1000e0 + (event_id % 5) / 20000e0 AS lon,
         "value" AS altitude, ts AS "timestamp"
  FROM events)"""

EXTENT = """
ext AS (SELECT min(lat) AS lat0, max(lat) AS lat1, min(lon) AS lon0,
               max(lon) AS lon1 FROM pts)"""

CELLS = f"""
cells AS (
  SELECT pts.*, CAST(trunc((lat - lat0) / {CELL}e0) AS INTEGER) AS cell_i,
         CAST(trunc((lon - lon0) / {CELL}e0) AS INTEGER) AS cell_j
  FROM pts, ext)"""


def fixed_sql(size: int) -> str:
    return f"""
blocks AS (
  SELECT *, max(seq) OVER (PARTITION BY traj_id) AS last_seq FROM pts),
members AS (
  SELECT traj_id AS entity_id, seq // {size} AS segment_id, seq % {size} AS place,
         lat, lon, "timestamp" FROM blocks
  UNION ALL
  SELECT traj_id, seq // {size} + 1, -1, lat, lon, "timestamp" FROM blocks
  WHERE seq % {size} = {size} - 1 AND seq < last_seq)"""


GRID = """
moves AS (
  SELECT *, lag(cell_i) OVER w AS prev_i, lag(cell_j) OVER w AS prev_j,
         lead(cell_i) OVER w AS next_i, lead(cell_j) OVER w AS next_j
  FROM cells WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
islands AS (
  SELECT *, sum(CASE WHEN prev_i <> cell_i OR prev_j <> cell_j THEN 1 ELSE 0 END)
           OVER (PARTITION BY traj_id ORDER BY seq) AS island
  FROM moves),
members AS (
  SELECT traj_id AS entity_id, CAST(island AS BIGINT) AS segment_id, seq AS place,
         lat, lon, "timestamp" FROM islands
  UNION ALL
  SELECT traj_id, CAST(island AS BIGINT) + 1, -1, lat, lon, "timestamp"
  FROM islands WHERE next_i <> cell_i OR next_j <> cell_j)"""

BOUNDS = """
segs AS (
  SELECT entity_id, segment_id, min(lat) AS min_x, max(lat) AS max_x,
         min(lon) AS min_y, max(lon) AS max_y, min("timestamp") AS min_t,
         max("timestamp") AS max_t, count(*) AS n_points,
         list(lat ORDER BY place) AS xs, list(lon ORDER BY place) AS ys
  FROM members GROUP BY entity_id, segment_id)"""

MEMBER_ROWS = """
SELECT entity_id, segment_id,
       CAST(row_number() OVER (PARTITION BY entity_id, segment_id
                               ORDER BY place) - 1 AS INTEGER) AS pos,
       lat, lon, "timestamp"
FROM members"""

FIXED = ROWS + "," + fixed_sql(segmentation.FIXED_SEGMENT_POINTS)
GRID_ALL = ROWS + "," + EXTENT + "," + CELLS + "," + GRID
SEGMENT_ROWS = (
    "SELECT entity_id, segment_id, min_x, max_x, min_y, max_y, min_t, max_t, n_points"
    " FROM segs"
)


def in_box_sql(box: BBox) -> str:
    return (
        f"lat >= {box.min_lat}e0 AND lat <= {box.max_lat}e0"
        f" AND lon >= {box.min_lon}e0 AND lon <= {box.max_lon}e0"
    )


def overlap_sql(box: BBox) -> str:
    return (
        f"max_x >= {box.min_lat}e0 AND min_x <= {box.max_lat}e0"
        f" AND max_y >= {box.min_lon}e0 AND min_y <= {box.max_lon}e0"
    )


def metres_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    half_phi = f"sin((radians({lat2}) - radians({lat1})) / 2)"
    half_lam = f"sin((radians({lon2}) - radians({lon1})) / 2)"
    a = (
        f"({half_phi} * {half_phi} + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * {half_lam} * {half_lam})"
    )
    return f"(2 * 6371000e0 * atan2(sqrt({a}), sqrt(1 - {a})))"


def micro_sql(value: str) -> str:
    return f"round_even({value} * 1e6, 0) / 1e6"


def from_point_sql(point: knn.Point = POINT) -> str:
    return micro_sql(metres_sql(f"{point[0]}e0", f"{point[1]}e0", "lat", "lon"))


def nearest_sql(
    positions: str, point: knn.Point = POINT, k: int = K, dedup: bool = True
) -> str:
    """Final SELECT: the k nearest of ``positions`` (traj_id, lat, lon)."""
    source = (
        f"(SELECT min(traj_id) AS traj_id, lat, lon FROM {positions} GROUP BY lat, lon)"
        if dedup
        else positions
    )
    return (
        f"SELECT traj_id, lat, lon, {from_point_sql(point)} AS distance FROM {source}"
        f" ORDER BY distance, lat, lon, traj_id LIMIT {k}"
    )


def refined_sql(box: BBox) -> str:
    return f"""
SELECT entity_id, lat, lon, "timestamp" FROM (
  SELECT *, row_number() OVER (
           PARTITION BY entity_id, round_even(lat * 1e6, 0), round_even(lon * 1e6, 0)
           ORDER BY segment_id, place) AS copy
  FROM members WHERE {in_box_sql(box)})
WHERE copy = 1"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts[:-1]) + "\n" + parts[-1]


def rounded(result: DataFrame) -> DataFrame:
    return result.withColumn("distance", to_micro(F.col("distance")))


def segment_rows(segments: DataFrame) -> DataFrame:
    return segments.select(
        "entity_id",
        "segment_id",
        "min_x",
        "max_x",
        "min_y",
        "max_y",
        "min_t",
        "max_t",
        F.size("vals_x").cast("long").alias("n_points"),
    )


def members(segments: DataFrame) -> DataFrame:
    return segmentation.flatten_segments(segments).drop("part")


def view_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of the supplier trajectories, from the two coordinates alone."""
    return point_extent(lineitem_rows(spark, sf_dir))


# ------------------------------------------------------- points, trajectories


@query(
    "points_view",
    with_(ROWS, 'SELECT traj_id, seq, lat, lon, altitude, "timestamp" FROM pts'),
)
def points_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_points(spark, sf_dir)


@query(
    "points_view_hot",
    with_(ROWS, 'SELECT traj_id, seq, lat, lon, altitude, "timestamp" FROM pts'),
)
def points_view_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trajectory numbered as one too long for a task."""
    return lineitem_points(spark, sf_dir, hot_points=50)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as lines of raw logs, one log per trajectory, with blank, malformed
    and infinite lines in between: ``path, line_no, line``."""
    points = lineitem_points(spark, sf_dir)
    path = F.concat(F.lit("/logs/007/Trajectory/"), F.col("traj_id"), F.lit(".plt"))
    line = F.concat_ws(
        ",",
        *[F.col(c).cast("string") for c in ("lat", "lon")],
        F.lit("0"),
        F.col("altitude").cast("string"),
        F.lit("39757.5"),
        F.date_format("timestamp", "yyyy-MM-dd"),
        F.date_format("timestamp", "HH:mm:ss"),
    )
    noise = F.when(F.col("seq") % 7 == 3, F.lit("39.9,oops")).when(
        F.col("seq") % 7 == 5, F.lit("NaN,116.3,0,1,1,2008-11-26,12:00:00")
    ).otherwise(F.lit(" "))
    both = F.array(
        F.struct((F.col("seq") * 2 + 6).alias("line_no"), line.alias("line")),
        F.struct((F.col("seq") * 2 + 7).alias("line_no"), noise.alias("line")),
    )
    logged = points.select(path.alias("path"), F.inline(both))
    first_lines = F.array(*[F.lit(n).cast("long") for n in range(6)])
    header = points.select(path.alias("path")).distinct().select(
        "path", F.explode(first_lines).alias("line_no")
    )
    return logged.unionByName(header.withColumn("line", F.lit("header")))


def logged_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_lines(log_lines(spark, sf_dir)).where(is_complete())
    # numbering asks twice for its rows
    return renumber(stored_table(parsed.drop("path", "line_no", "line"), "log-points"))


@query(
    "raw_logs_roundtrip",
    with_(
        ROWS,
        "SELECT '007' AS user_id, traj_id, seq, lat, lon, altitude, \"timestamp\" FROM pts",
    ),
)
def raw_logs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logged_points(spark, sf_dir)


LOGGED = with_(
    ROWS,
    "SELECT '007' AS user_id, traj_id, seq, lat, lon, altitude, \"timestamp\" FROM pts",
)


def log_folder(spark: SparkSession, sf_dir: str) -> str:
    """The view as files of raw logs below the shared folder."""
    root = shared_folder(spark, "raw-logs")
    write_log_lines(log_lines(spark, sf_dir), root)
    return root


@query("raw_logs_files", LOGGED)
def raw_logs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs from files that are read whole."""
    return read_raw_logs(spark, log_folder(spark, sf_dir))


@query("raw_logs_large_files", LOGGED)
def raw_logs_large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs from files of which nearly all are too large to be read whole."""
    return read_raw_logs(spark, log_folder(spark, sf_dir), whole_file_bytes=2000)


@query(
    "raw_logs_malformed_files",
    with_(
        ROWS,
        "SELECT traj_id, 2 * seq + 7 AS line_no FROM pts WHERE seq % 7 IN (3, 5)",
    ),
)
def raw_logs_malformed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = read_malformed_lines(spark, log_folder(spark, sf_dir))
    return bad.select(F.regexp_extract(F.substring_index("path", "/", -1), r"([^/]+)\.plt$", 1).alias("traj_id"), "line_no")


def arriving_members(spark: SparkSession, sf_dir: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Logs that arrive in two pieces, each met by a stream of its own that goes on
    where the one before stopped; a trajectory's second piece begins anew at line 0."""
    root, path = shared_folder(spark, "arriving"), shared_folder(spark, "live-members")
    lines = log_lines(spark, sf_dir)
    second = F.col("line_no") >= 46
    pieces = {
        "a": lines.where(~second),
        "b": lines.where(second | (F.col("line_no") < 6)).withColumn("line_no", F.when(second, F.col("line_no") - 40).otherwise(F.col("line_no"))),
    }
    for name, piece in pieces.items():
        write_log_lines(piece, f"{root}/{name}")
        points = stream_raw_logs(spark, root, "*/*/Trajectory/*.plt")
        stream = cut(points).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{root}/checkpoint")
        with listing_in_few_tasks(spark):
            stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query("live_fixed_segments", with_(FIXED, MEMBER_ROWS))
def live_fixed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = arriving_members(spark, sf_dir, lambda p: stream_fixed_members(p, key=("traj_id",)))
    return members(segments_of_members(found))


@query("live_grid_segments", with_(GRID_ALL, MEMBER_ROWS))
def live_grid_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = view_grid(spark, sf_dir).first()
    grid = GridSpec(corner["min_lat"], corner["min_lon"], CELL)
    found = arriving_members(spark, sf_dir, lambda p: stream_grid_members(p, grid, CELL, key=("traj_id",)))
    return members(segments_of_members(found))


@query("raw_logs_fixed_segments", with_(FIXED, MEMBER_ROWS))
def raw_logs_fixed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(segmentation.fixed_segments(logged_points(spark, sf_dir)))


@query(
    "raw_logs_malformed",
    with_(
        ROWS,
        "SELECT traj_id, 2 * seq + 7 AS line_no FROM pts WHERE seq % 7 IN (3, 5)",
    ),
)
def raw_logs_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_lines(log_lines(spark, sf_dir)).where(~is_complete())
    return parsed.select("traj_id", "line_no")


@query(
    "trajectory_length",
    with_(ROWS, "SELECT traj_id, count(*) AS n_points FROM pts GROUP BY traj_id"),
)
def trajectory_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.trajectory_lengths(lineitem_rows(spark, sf_dir))


@query(
    "trajectory_bbox",
    with_(
        ROWS,
        "SELECT traj_id, min(lat) AS min_lat, min(lon) AS min_lon,"
        " max(lat) AS max_lat, max(lon) AS max_lon FROM pts GROUP BY traj_id",
    ),
)
def trajectory_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories.trajectory_boxes(lineitem_rows(spark, sf_dir))


@query(
    "trajectory_assembly",
    with_(
        ROWS,
        "SELECT traj_id, CAST(seq AS INTEGER) AS pos, lat, lon, altitude,"
        ' "timestamp" FROM pts',
    ),
)
def trajectory_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = 250
    whole = trajectories.assemble(lineitem_points(spark, sf_dir), part_points=part)
    return whole.select(
        "traj_id", "part", F.posexplode("points").alias("at", "p")
    ).select(
        "traj_id",
        (F.col("part") * part + F.col("at")).cast("int").alias("pos"),
        "p.lat",
        "p.lon",
        "p.altitude",
        "p.timestamp",
    )


@query(
    "global_extent",
    with_(
        ROWS,
        "SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon,"
        " max(lon) AS max_lon FROM pts",
    ),
)
def global_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_grid(spark, sf_dir)


@query(
    "grid_cells",
    with_(
        ROWS,
        EXTENT,
        CELLS,
        "SELECT cell_i, cell_j, concat(cell_i, '_', cell_j) AS grid_cell,"
        " count(*) AS n_points FROM cells GROUP BY cell_i, cell_j",
    ),
)
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_cells(lineitem_rows(spark, sf_dir), view_grid(spark, sf_dir), CELL)
    return rows.groupBy("cell_i", "cell_j", "grid_cell").agg(
        F.count(F.lit(1)).alias("n_points")
    )


@query(
    "ring_neighbours",
    with_(
        ROWS,
        EXTENT,
        CELLS,
        "filled AS (SELECT cell_i, cell_j, count(*) AS n FROM cells"
        " GROUP BY cell_i, cell_j)",
        "SELECT a.cell_i, a.cell_j, CAST(sum(b.n) AS BIGINT) AS n_points"
        " FROM filled a JOIN filled b ON b.cell_i BETWEEN a.cell_i - 1 AND a.cell_i + 1"
        " AND b.cell_j BETWEEN a.cell_j - 1 AND a.cell_j + 1"
        " GROUP BY a.cell_i, a.cell_j",
    ),
)
def ring_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the 3x3 block around every occupied cell: each cell hands its
    count to its neighbours, so points are aggregated before anything spreads."""
    rows = with_cells(
        lineitem_rows(spark, sf_dir), view_grid(spark, sf_dir), CELL, label=False
    )
    filled = rows.groupBy("cell_i", "cell_j").agg(F.count(F.lit(1)).alias("n"))
    handed = filled.select(
        "n", F.inline(ring_cells(F.col("cell_i"), F.col("cell_j")))
    )
    return (
        handed.join(filled.drop("n"), ["cell_i", "cell_j"], "left_semi")
        .groupBy("cell_i", "cell_j")
        .agg(F.sum("n").alias("n_points"))
    )


@query(
    "iso_timestamps",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||"
    " CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE"
    " strftime(ts, '.%f') END AS iso FROM events",
)
def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).select(
        "event_id", iso_text(F.col("timestamp")).alias("iso")
    )


# ----------------------------------------------------------------- box queries


def first_in_box_sql(condition: str) -> str:
    return f"""
SELECT traj_id, lat, lon, altitude, "timestamp" FROM (
  SELECT *, row_number() OVER (PARTITION BY traj_id, lat, lon ORDER BY seq) AS copy
  FROM pts WHERE {condition})
WHERE copy = 1"""


@query("bbox_points", with_(ROWS, first_in_box_sql(in_box_sql(BOX))))
def bbox_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem_rows(spark, sf_dir)
    return bbox.bbox_points(rows, BOX, order=LINEITEM_ORDER).select(*POINT_COLUMNS)


@query("bbox_points_outside", with_(ROWS, first_in_box_sql(in_box_sql(OUTSIDE_BOX))))
def bbox_points_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem_rows(spark, sf_dir)
    found = bbox.bbox_points(rows, OUTSIDE_BOX, order=LINEITEM_ORDER)
    return found.select(*POINT_COLUMNS)


@query(
    "bbox_points_within",
    with_(
        ROWS,
        first_in_box_sql(
            f"lat > {BOX.min_lat}e0 AND lat < {BOX.max_lat}e0"
            f" AND lon > {BOX.min_lon}e0 AND lon < {BOX.max_lon}e0"
        ),
    ),
)
def bbox_points_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem_rows(spark, sf_dir)
    found = bbox.bbox_points(rows, BOX, order=LINEITEM_ORDER, boundary=False)
    return found.select(*POINT_COLUMNS)


@query("bbox_stored_points", with_(ROWS, first_in_box_sql(in_box_sql(BOX))))
def bbox_stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = stored_layout(spark, sf_dir, "Base Parquet")
    return bbox.bbox_points(points, BOX).select(*POINT_COLUMNS)


@query("bbox_csv", with_(ROWS, first_in_box_sql(in_box_sql(BOX))))
def bbox_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = stored_layout(spark, sf_dir, "CSV")
    return bbox.bbox_points(points, BOX).select(*POINT_COLUMNS)


@query("bbox_geo", with_(ROWS, first_in_box_sql(in_box_sql(BOX))))
def bbox_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = stored_layout(spark, sf_dir, "GeoParquet")
    return bbox.bbox_points(without_geometry(points), BOX).select(*POINT_COLUMNS)


@query("bbox_geo_files", with_(ROWS, first_in_box_sql(in_box_sql(BOX))))
def bbox_geo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of many GeoParquet files only those whose bounds meet the box."""
    path = shared_folder(spark, "geo-files")
    write_geoparquet(lineitem_points(spark, sf_dir), path, partitions=16)
    points = read_geoparquet(spark, path, BOX)
    return bbox.bbox_points(without_geometry(points), BOX).select(*POINT_COLUMNS)


@query(
    "geo_geometry",
    with_(
        ROWS,
        "SELECT traj_id, seq, lon AS x, lat AS y, '0101000000' AS head, 21 AS n_bytes"
        " FROM pts",
    ),
)
def geo_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coordinates of every stored geometry, taken from its bytes by arithmetic."""
    points = stored_layout(spark, sf_dir, "GeoParquet (small groups)")

    def double_at(place: int) -> Column:
        own = [F.substring(F.hex("geometry"), 2 * (place + k) + 1, 2) for k in range(7, -1, -1)]
        bits = F.conv(F.concat(*own), 16, 10).cast("long")
        power = F.shiftright(bits, 52) - 1023
        return (1 + bits.bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(2.0**52)) * F.pow(F.lit(2.0), power)

    return points.select(
        "traj_id",
        "seq",
        double_at(5).alias("x"),
        double_at(13).alias("y"),
        F.substring(F.hex("geometry"), 1, 10).alias("head"),
        F.length("geometry").alias("n_bytes"),
    )


@query("bbox_fixed_refine", with_(FIXED, refined_sql(BOX)))
def bbox_fixed_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbox.bbox_segments(stored_layout(spark, sf_dir, "Fixed Segments"), BOX)


@query("bbox_grid_refine", with_(GRID_ALL, refined_sql(BOX)))
def bbox_grid_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbox.bbox_segments(stored_layout(spark, sf_dir, "Grid Segments"), BOX, "points")


CUSTOMER_BOXES = """
boxes AS (
  SELECT c_custkey AS box_id, 39.985e0 + (c_custkey % 311) / 10000e0 AS min_lat,
         39.985e0 + (c_custkey % 311) / 10000e0 + (1 + c_custkey % 13) / 20000e0
           AS max_lat,
         116.31e0 + (c_custkey % 61) / 10000e0 AS min_lon,
         116.31e0 + (c_custkey % 61) / 10000e0 + (1 + c_custkey % 5) / 10000e0
           AS max_lon
  FROM customer)"""


@query(
    "bbox_batch",
    with_(
        ROWS,
        CUSTOMER_BOXES,
        """
SELECT box_id, traj_id, lat, lon, altitude, "timestamp" FROM (
  SELECT *, row_number() OVER (PARTITION BY box_id, traj_id, lat, lon
                               ORDER BY seq) AS copy
  FROM pts JOIN boxes ON lat BETWEEN min_lat AND max_lat
                     AND lon BETWEEN min_lon AND max_lon)
WHERE copy = 1""",
    ),
)
def batch_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bbox_batch(
        lineitem_rows(spark, sf_dir), customer_boxes(spark, sf_dir), order=LINEITEM_ORDER, columns=POINT_COLUMNS
    )
    return found.select("box_id", *POINT_COLUMNS)


SEGMENT_PAIRS = with_(
    GRID_ALL,
    BOUNDS,
    CUSTOMER_BOXES,
    """
SELECT box_id, entity_id, segment_id FROM boxes JOIN segs
ON max_x >= min_lat AND min_x <= max_lat AND max_y >= min_lon AND min_y <= max_lon""",
)


@query("segment_box_pairs", SEGMENT_PAIRS)
def segment_box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which segments' bounds overlap which boxes."""
    segments = stored_layout(spark, sf_dir, "Grid Segments")
    pairs = match_segments(segments, customer_boxes(spark, sf_dir))
    return pairs.select("box_id", "entity_id", "segment_id")


@query("segment_box_pairs_hot", SEGMENT_PAIRS)
def segment_box_pairs_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with crowded cells dealt out in pieces of a few rows."""
    segments = stored_layout(spark, sf_dir, "Grid Segments")
    pairs = match_segments(segments, customer_boxes(spark, sf_dir), hot_rows=25)
    return pairs.select("box_id", "entity_id", "segment_id")


@query(
    "bbox_batch_segments",
    with_(
        GRID_ALL,
        CUSTOMER_BOXES,
        """
SELECT box_id, entity_id, lat, lon, "timestamp" FROM (
  SELECT *, row_number() OVER (
           PARTITION BY box_id, entity_id, round_even(lat * 1e6, 0), round_even(lon * 1e6, 0)
           ORDER BY segment_id, place) AS copy
  FROM members JOIN boxes ON lat BETWEEN min_lat AND max_lat
                         AND lon BETWEEN min_lon AND max_lon)
WHERE copy = 1""",
    ),
)
def batch_boxes_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = stored_layout(spark, sf_dir, "Grid Segments")
    return bbox_batch_segments(segments, customer_boxes(spark, sf_dir))


# --------------------------------------------------------------- place and time

LONG_BOX = BBox(39.98, 40.01, 116.312, 116.3145)
FROM, TO = datetime(1994, 3, 1), datetime(1995, 2, 15)
IN_TIME = f"BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"


def segments_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid segments in slabs of 30 days."""
    path = shared_folder(spark, "segments-by-time")
    write_segments(stored_layout(spark, sf_dir, "Grid Segments").select(*SEGMENTS.fieldNames()), path, slab_hours=24 * 30)
    return read_segments_by_time(spark, path)


@query(
    "segments_between",
    with_(GRID_ALL, BOUNDS, SEGMENT_ROWS + f" WHERE {overlap_sql(LONG_BOX)} AND max_t >= TIMESTAMP '{FROM}' AND min_t <= TIMESTAMP '{TO}'"),
)
def segments_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_rows(segments_between(segments_by_time(spark, sf_dir), LONG_BOX, FROM, TO))


@query(
    "bbox_between",
    with_(
        GRID_ALL,
        f"""
SELECT entity_id, lat, lon, "timestamp" FROM (
  SELECT *, row_number() OVER (
           PARTITION BY entity_id, round_even(lat * 1e6, 0), round_even(lon * 1e6, 0)
           ORDER BY segment_id, place) AS copy
  FROM members WHERE {in_box_sql(LONG_BOX)} AND "timestamp" {IN_TIME})
WHERE copy = 1""",
    ),
)
def bbox_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbox_segments_between(segments_by_time(spark, sf_dir), LONG_BOX, FROM, TO)


TIMED_BOXES = """
timed AS (
  SELECT *, from_t + to_days(CAST(1 + box_id % 400 AS INTEGER)) AS to_t FROM (
    SELECT *, TIMESTAMP '1992-01-01' + to_days(CAST(350 + 10 * (box_id % 311) + box_id * 37 % 200 AS INTEGER)) AS from_t
    FROM boxes))"""

TIMED_PAIRS = with_(
    GRID_ALL,
    BOUNDS,
    CUSTOMER_BOXES,
    TIMED_BOXES,
    """
SELECT box_id, entity_id, segment_id FROM timed JOIN segs
ON max_x >= min_lat AND min_x <= max_lat AND max_y >= min_lon AND min_y <= max_lon
AND max_t >= from_t AND min_t <= to_t""",
)


@query("segment_box_pairs_between", TIMED_PAIRS)
def segment_box_pairs_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which segments' bounds overlap which boxes in place and time."""
    segments = stored_layout(spark, sf_dir, "Grid Segments")
    pairs = match_segments_between(segments, customer_boxes_in_time(spark, sf_dir))
    return pairs.select("box_id", "entity_id", "segment_id")


@query("segment_box_pairs_between_hot", TIMED_PAIRS)
def segment_box_pairs_between_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with crowded cells dealt out in pieces of a few rows."""
    segments = stored_layout(spark, sf_dir, "Grid Segments")
    pairs = match_segments_between(segments, customer_boxes_in_time(spark, sf_dir), hot_rows=5)
    return pairs.select("box_id", "entity_id", "segment_id")


@query(
    "bbox_batch_between",
    with_(
        GRID_ALL,
        CUSTOMER_BOXES,
        TIMED_BOXES,
        """
SELECT box_id, entity_id, lat, lon, "timestamp" FROM (
  SELECT *, row_number() OVER (
           PARTITION BY box_id, entity_id, round_even(lat * 1e6, 0), round_even(lon * 1e6, 0)
           ORDER BY segment_id, place) AS copy
  FROM members JOIN timed ON lat BETWEEN min_lat AND max_lat
                         AND lon BETWEEN min_lon AND max_lon
                         AND "timestamp" BETWEEN from_t AND to_t)
WHERE copy = 1""",
    ),
)
def batch_boxes_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = stored_layout(spark, sf_dir, "Grid Segments")
    return bbox_batch_between(segments, customer_boxes_in_time(spark, sf_dir))


# -------------------------------------------------------------------- segments


@query("fixed_segments", with_(FIXED, MEMBER_ROWS))
def fixed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(segmentation.fixed_segments(lineitem_points(spark, sf_dir)))


@query("fixed_segment_bounds", with_(FIXED, BOUNDS, SEGMENT_ROWS))
def fixed_segment_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_rows(segmentation.fixed_segments(lineitem_points(spark, sf_dir)))


@query("grid_segments", with_(GRID_ALL, MEMBER_ROWS))
def grid_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = lineitem_points(spark, sf_dir)
    return members(segmentation.grid_segments(points, view_grid(spark, sf_dir), CELL))


@query("grid_segments_chunked", with_(GRID_ALL, MEMBER_ROWS))
def grid_segments_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same segments found in chunks of a few points, as for a trajectory too
    long for one task."""
    points = lineitem_points(spark, sf_dir)
    flat = segmentation.grid_members(
        points, view_grid(spark, sf_dir), CELL, part_points=64
    )
    return members(
        segmentation.finish_segments(flat.withColumn("part", F.lit(0).cast("long")))
    )


@query("grid_segment_bounds", with_(GRID_ALL, BOUNDS, SEGMENT_ROWS))
def grid_segment_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = stored_layout(spark, sf_dir, "Grid Segments")
    return segment_rows(segmentation.recompute_bounds(segments))


@query(
    "segment_mbr_overlap",
    with_(GRID_ALL, BOUNDS, SEGMENT_ROWS + f" WHERE {overlap_sql(BOX)}"),
)
def segment_mbr_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = stored_layout(spark, sf_dir, "Grid Segments")
    return segment_rows(scan_segments(segments, BOX, None))


def whole_segments(parts: DataFrame) -> DataFrame:
    """One row a segment: bounds as stored in its first part, points of all parts."""
    bounds = [c for c in SEGMENTS.fieldNames() if c[:4] in ("min_", "max_")]
    return parts.groupBy("entity_id", "segment_id").agg(
        F.sum(F.size("vals_x")).alias("n_points"),
        *[F.min(F.when(F.col("part") == 0, F.col(c))).alias(c) for c in bounds],
    )


def view_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid segments in parts of four points."""
    points = lineitem_points(spark, sf_dir)
    return segmentation.grid_segments(points, view_grid(spark, sf_dir), CELL, part_points=4)


@query(
    "segment_mbr_overlap_parts",
    with_(GRID_ALL, BOUNDS, SEGMENT_ROWS + f" WHERE {overlap_sql(BOX)}"),
)
def segment_mbr_overlap_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_segments(bbox.segments_overlapping(view_parts(spark, sf_dir), BOX))


@query(
    "segment_any_point_parts",
    with_(
        GRID_ALL,
        BOUNDS,
        SEGMENT_ROWS
        + " WHERE (entity_id, segment_id) IN (SELECT (entity_id, segment_id)"
        + f" FROM members WHERE {in_box_sql(BOX)})",
    ),
)
def segment_any_point_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every part has the bounds of its segment, so the rest can go before it is stored
    near = bbox.segments_overlapping(view_parts(spark, sf_dir), BOX)
    return whole_segments(bbox.segments_touching(stored_table(near, "segment-parts"), BOX))


@query("segment_scan_refine", with_(GRID_ALL, refined_sql(BOX)))
def segment_scan_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default scan feeds the refining step."""
    segments = stored_layout(spark, sf_dir, "Grid Segments")
    return bbox.refine_points(scan_segments(segments, BOX), BOX)


@query(
    "results_roundtrip",
    with_(
        GRID_ALL,
        "found AS (SELECT * FROM (" + refined_sql(BOX) + "))",
        "SELECT *, CAST(1 AS INTEGER) AS run_id, 'grid_segments_points' AS method FROM found",
    ),
)
def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two kinds in one folder, read back as tables of their own."""
    points = bbox.bbox_points(lineitem_points(spark, sf_dir), BOX)
    refined = bbox.bbox_segments(stored_layout(spark, sf_dir, "Grid Segments"), BOX)
    root = shared_folder(spark, "results")
    append_run({"Base Parquet": points, "Grid Segments (points)": refined}, root)
    return read_runs(spark, root, refined)


@query(
    "segment_mbr_contains",
    with_(
        FIXED,
        BOUNDS,
        SEGMENT_ROWS
        + f" WHERE min_x <= {POINT[0]}e0 AND max_x >= {POINT[0]}e0"
        + f" AND min_y <= {POINT[1]}e0 AND max_y >= {POINT[1]}e0",
    ),
)
def segment_mbr_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = stored_layout(spark, sf_dir, "Fixed Segments")
    return segment_rows(segments.where(bounds_contain_point(*POINT)))


@query(
    "segment_any_point",
    with_(
        GRID_ALL,
        BOUNDS,
        SEGMENT_ROWS
        + " WHERE (entity_id, segment_id) IN (SELECT (entity_id, segment_id)"
        + f" FROM members WHERE {in_box_sql(BOX)})",
    ),
)
def segment_any_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = stored_layout(spark, sf_dir, "Grid Segments")
    return segment_rows(bbox.segments_touching(segments, BOX))


@query(
    "string_array_decode",
    with_(FIXED, MEMBER_ROWS.replace(', "timestamp"', "")),
)
def string_array_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays to text and back."""
    segments = stored_layout(spark, sf_dir, "Fixed Segments")
    as_text = segments.withColumns(
        {c: encode_doubles(F.col(c)) for c in ("vals_x", "vals_y")}
    )
    decoded = as_text.withColumns(
        {c: decode_doubles(F.col(c)) for c in ("vals_x", "vals_y")}
    )
    return members(decoded).drop("timestamp")


@query(
    "events_trajectory_bounds",
    with_(
        EVENT_ROWS,
        'SELECT traj_id, min("timestamp") AS min_t, max("timestamp") AS max_t,'
        " min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon,"
        " max(lon) AS max_lon, count(*) AS n_points FROM pts GROUP BY traj_id",
    ),
)
def events_trajectory_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    times = rows.groupBy("traj_id").agg(
        F.min("timestamp").alias("min_t"), F.max("timestamp").alias("max_t")
    )
    return (
        trajectories.trajectory_boxes(rows)
        .join(trajectories.trajectory_lengths(rows), "traj_id")
        .join(times, "traj_id")
    )


@query(
    "events_fixed_segments",
    with_(EVENT_ROWS, fixed_sql(EVENT_SEGMENT), BOUNDS, SEGMENT_ROWS),
)
def events_fixed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = event_points(spark, sf_dir)
    return segment_rows(segmentation.fixed_segments(points, EVENT_SEGMENT))


@query(
    "events_grid_segments",
    with_(EVENT_ROWS, EXTENT, CELLS, GRID, BOUNDS, SEGMENT_ROWS),
)
def events_grid_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = point_extent(event_rows(spark, sf_dir))
    points = event_points(spark, sf_dir)
    return segment_rows(segmentation.grid_segments(points, grid, CELL))


# --------------------------------------------------------------------- indexes

FIXED_INDEX = """
indexed AS (
  SELECT segs.*, list_sum(xs) / len(xs) AS centroid_x,
         list_sum(ys) / len(ys) AS centroid_y FROM segs)"""

GRID_INDEX = f"""
seg_ext AS (SELECT min(min_x) AS lat0, min(min_y) AS lon0 FROM segs),
indexed AS (
  SELECT segs.*, CAST(trunc((xs[1] - lat0) / {CELL}e0) AS INTEGER) AS cell_i,
         CAST(trunc((ys[1] - lon0) / {CELL}e0) AS INTEGER) AS cell_j,
         CAST(trunc((xs[-1] - lat0) / {CELL}e0) AS INTEGER) AS own_i,
         CAST(trunc((ys[-1] - lon0) / {CELL}e0) AS INTEGER) AS own_j
  FROM segs, seg_ext)"""


@query(
    "segment_extent",
    with_(
        GRID_ALL,
        BOUNDS,
        "SELECT min(min_x) AS min_lat, max(max_x) AS max_lat, min(min_y) AS min_lon,"
        " max(max_y) AS max_lon FROM segs",
    ),
)
def extent_of_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_extent(stored_layout(spark, sf_dir, "Grid Segments"))


@query(
    "fixed_index",
    with_(
        FIXED,
        BOUNDS,
        FIXED_INDEX,
        "SELECT entity_id, segment_id, min_x, max_x, min_y, max_y,"
        f" {micro_sql('centroid_x')} AS centroid_x,"
        f" {micro_sql('centroid_y')} AS centroid_y FROM indexed",
    ),
)
def index_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = fixed_index(stored_layout(spark, sf_dir, "Fixed Segments"))
    return indexed.select(
        "entity_id",
        "segment_id",
        "min_x",
        "max_x",
        "min_y",
        "max_y",
        to_micro(F.col("centroid_x")).alias("centroid_x"),
        to_micro(F.col("centroid_y")).alias("centroid_y"),
    )


@query(
    "grid_index",
    with_(
        GRID_ALL,
        BOUNDS,
        GRID_INDEX,
        "SELECT entity_id, segment_id, cell_i, cell_j,"
        " concat(cell_i, '_', cell_j) AS grid_cell FROM indexed",
    ),
)
def index_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = grid_index(stored_layout(spark, sf_dir, "Grid Segments"), CELL)
    return indexed.select("entity_id", "segment_id", "cell_i", "cell_j", "grid_cell")


@query(
    "grid_index_own_cell",
    with_(
        GRID_ALL,
        BOUNDS,
        GRID_INDEX,
        "SELECT entity_id, segment_id, own_i AS cell_i, own_j AS cell_j FROM indexed",
    ),
)
def index_grid_own_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = stored_layout(spark, sf_dir, "Grid Segments")
    indexed = grid_index(segments, CELL, anchor="own_cell")
    return indexed.select("entity_id", "segment_id", "cell_i", "cell_j")


# ------------------------------------------------------------------------ k-NN

AS_POSITIONS = "(SELECT entity_id AS traj_id, lat, lon FROM members)"
TOP_CENTROIDS = 6
CONTAINING = f"""
containing AS (
  SELECT *, sqrt((centroid_y - {POINT[1]}e0) * (centroid_y - {POINT[1]}e0)
               + (centroid_x - {POINT[0]}e0) * (centroid_x - {POINT[0]}e0)) AS away
  FROM indexed
  WHERE min_x <= {POINT[0]}e0 AND max_x >= {POINT[0]}e0
    AND min_y <= {POINT[1]}e0 AND max_y >= {POINT[1]}e0
  ORDER BY away, entity_id, segment_id LIMIT {TOP_CENTROIDS})"""
KEPT_POSITIONS = (
    "(SELECT m.entity_id AS traj_id, lat, lon FROM members m JOIN containing c"
    " ON m.entity_id = c.entity_id AND m.segment_id = c.segment_id)"
)
RING = f"""
around AS (
  SELECT indexed.* FROM indexed, seg_ext
  WHERE cell_i BETWEEN CAST(trunc(({POINT[0]}e0 - lat0) / {CELL}e0) AS INTEGER) - 1
                   AND CAST(trunc(({POINT[0]}e0 - lat0) / {CELL}e0) AS INTEGER) + 1
    AND cell_j BETWEEN CAST(trunc(({POINT[1]}e0 - lon0) / {CELL}e0) AS INTEGER) - 1
                   AND CAST(trunc(({POINT[1]}e0 - lon0) / {CELL}e0) AS INTEGER) + 1)"""


@query("knn_points", with_(ROWS, nearest_sql("pts")))
def knn_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.knn_points(lineitem_rows(spark, sf_dir), POINT, K))


@query("knn_points_far", with_(ROWS, nearest_sql("pts", FAR_POINT, 1500)))
def knn_points_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Far from every point and with a large k: the guess fails."""
    return rounded(knn.knn_points(lineitem_rows(spark, sf_dir), FAR_POINT, 1500))


@query("knn_stored_points", with_(ROWS, nearest_sql("pts")))
def knn_stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.knn_points(stored_layout(spark, sf_dir, "Base Parquet"), POINT, K))


@query("knn_fixed_nodedup", with_(FIXED, nearest_sql(AS_POSITIONS, dedup=False)))
def knn_fixed_nodedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = stored_layout(spark, sf_dir, "Fixed Segments")
    return rounded(knn.knn_segment_points(segments, POINT, K))


@query("knn_grid_dedup", with_(GRID_ALL, nearest_sql(AS_POSITIONS)))
def knn_grid_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.knn_segments(stored_layout(spark, sf_dir, "Grid Segments"), POINT, K))


@query(
    "knn_segments_ring",
    with_(
        GRID_ALL,
        BOUNDS,
        GRID_INDEX,
        RING,
        nearest_sql(
            "(SELECT m.entity_id AS traj_id, lat, lon FROM members m JOIN around a"
            " ON m.entity_id = a.entity_id AND m.segment_id = a.segment_id)"
        ),
    ),
)
def knn_segments_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored_layout(spark, sf_dir, "Grid Segments (index)")
    return rounded(knn.knn_segments(index, POINT, K, ring=1))


@query(
    "centroid_topn",
    with_(
        FIXED,
        BOUNDS,
        FIXED_INDEX,
        CONTAINING,
        "SELECT entity_id, segment_id FROM containing",
    ),
)
def centroid_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored_layout(spark, sf_dir, "Fixed Segments (index)")
    kept = index.where(bounds_contain_point(*POINT))
    return knn.nearest_centroids(kept, POINT, TOP_CENTROIDS).select(
        "entity_id", "segment_id"
    )


@query(
    "knn_fixed_index",
    with_(FIXED, BOUNDS, FIXED_INDEX, CONTAINING, nearest_sql(KEPT_POSITIONS)),
)
def knn_fixed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored_layout(spark, sf_dir, "Fixed Segments (index)")
    return rounded(knn.knn_fixed_index(index, POINT, K, TOP_CENTROIDS))


def least_sql(point: knn.Point) -> str:
    """Metres from a point beside, above or below bounds of less than half the globe."""
    lat, lon = (f"{c}e0" for c in point)

    def meridian(edge: str) -> str:
        turn = f"radians({edge} - {lon})"
        valley = f"degrees(atan2(sin(radians({lat})), cos(radians({lat})) * cos({turn})))"
        within = f"least(greatest({valley}, min_x), max_x)"
        return ", ".join(metres_sql(lat, lon, at, edge) for at in ("min_x", "max_x", within))

    straight = f"6371000e0 * radians(greatest(min_x - {lat}, {lat} - max_x, 0e0))"
    return f"CASE WHEN {lon} BETWEEN min_y AND max_y THEN {straight} ELSE least({meridian('min_y')}, {meridian('max_y')}) END"


INSIDE_BOUNDS = f"(min_x <= {POINT[0]}e0 AND max_x >= {POINT[0]}e0 AND min_y <= {POINT[1]}e0 AND max_y >= {POINT[1]}e0)"


@query(
    "knn_fixed_index_proven",
    with_(
        FIXED,
        BOUNDS,
        f"""
kept AS (
  SELECT m.entity_id AS traj_id, m.lat, m.lon FROM members m JOIN segs USING (entity_id, segment_id)
  WHERE {INSIDE_BOUNDS}),
skipped AS (SELECT min({least_sql(POINT)}) AS bound FROM segs WHERE NOT {INSIDE_BOUNDS})""",
        f"SELECT n.*, coalesce(distance < bound - 2e-6, true) AS proven FROM ({nearest_sql('kept')}) n, skipped",
    ),
)
def knn_fixed_index_proven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's answer from all segments around the point, with what is proven of it."""
    index = stored_layout(spark, sf_dir, "Fixed Segments (index)")
    return rounded(proven_knn_fixed_index(index, POINT, K, top_n_centroids=10_000_000))


@query(
    "knn_grid_index",
    with_(
        GRID_ALL,
        BOUNDS,
        GRID_INDEX,
        RING,
        nearest_sql(
            "(SELECT entity_id AS traj_id, lat, lon FROM members WHERE entity_id IN"
            " (SELECT entity_id FROM around))"
        ),
    ),
)
def knn_grid_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored_layout(spark, sf_dir, "Grid Segments (index)")
    return rounded(knn.knn_grid_index(index, POINT, K))


def cosine_sql(point: knn.Point) -> str:
    lat, lon = f"{point[0]}e0", f"{point[1]}e0"
    return (
        f"6371000e0 * acos(least(1e0, greatest(-1e0, cos(radians({lat})) *"
        f" cos(radians(lat)) * cos(radians(lon) - radians({lon}))"
        f" + sin(radians({lat})) * sin(radians(lat)))))"
    )


@query(
    "knn_geo",
    with_(
        ROWS,
        f"""
SELECT traj_id, lat, lon, round(distance, 1) AS distance FROM (
  SELECT traj_id, lat, lon, {cosine_sql(GEO_POINT)} AS distance FROM pts
  WHERE floor(lat / 0.001e0) BETWEEN floor({GEO_POINT[0]}e0 / 0.001e0) - 1
                                 AND floor({GEO_POINT[0]}e0 / 0.001e0) + 1
    AND floor(lon / 0.001e0) BETWEEN floor({GEO_POINT[1]}e0 / 0.001e0) - 1
                                 AND floor({GEO_POINT[1]}e0 / 0.001e0) + 1
  ORDER BY {micro_sql('distance')}, lat, lon, traj_id LIMIT {K})""",
    ),
)
def knn_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = stored_layout(spark, sf_dir, "GeoParquet (small groups)")
    found = knn.knn_geoparquet(points, GEO_POINT, K, grid_resolution=0.001)
    return found.withColumn("distance", F.round("distance", 1))


BATCH_KNN = with_(
    ROWS,
    """
asked AS (
  SELECT s_suppkey AS query_id, 39.98e0 + (s_suppkey % 97) / 2000e0 AS q_lat,
         116.305e0 + (s_suppkey % 53) / 3000e0 AS q_lon FROM supplier),
positions AS (SELECT min(traj_id) AS traj_id, lat, lon FROM pts GROUP BY lat, lon)""",
    f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, traj_id, lat, lon, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id
                               ORDER BY distance, lat, lon) AS rank
  FROM (SELECT *, {micro_sql(metres_sql('q_lat', 'q_lon', 'lat', 'lon'))} AS distance
        FROM asked, positions))
WHERE rank <= {K}""",
)


@query("knn_batch", BATCH_KNN)
def batch_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = lineitem_rows(spark, sf_dir), supplier_queries(spark, sf_dir)
    return rounded(knn_batch(rows, asked, K))


@query("knn_batch_segments", BATCH_KNN)
def batch_knn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers from segments, of which only those near a query are opened."""
    segments = stored_layout(spark, sf_dir, "Grid Segments")
    return rounded(knn_batch_segments(segments, supplier_queries(spark, sf_dir), K))


@query("knn_batch_fixed_segments", BATCH_KNN)
def batch_knn_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = stored_layout(spark, sf_dir, "Fixed Segments")
    return rounded(knn_batch_segments(segments, supplier_queries(spark, sf_dir), K))


# --------------------------------------------------------------------- reports


def ranked_sql(name: str, select: str) -> str:
    return (
        f"{name} AS (SELECT *, row_number() OVER (ORDER BY distance, lat, lon, traj_id)"
        f" AS rank FROM ({select}))"
    )


PAIR_METRES = metres_sql("a.lat", "a.lon", "b.lat", "b.lon")


@query(
    "knn_compare",
    with_(
        FIXED,
        BOUNDS,
        FIXED_INDEX,
        CONTAINING,
        ranked_sql("a", nearest_sql("pts")),
        ranked_sql("b", nearest_sql(KEPT_POSITIONS)),
        f"""
SELECT CAST(a.rank AS INTEGER) AS rank, a.traj_id AS traj_1, b.traj_id AS traj_2,
       {micro_sql('abs(a.lat - b.lat)')} AS lat_diff,
       {micro_sql('abs(a.lon - b.lon)')} AS lon_diff,
       {micro_sql(PAIR_METRES)} AS distance_m,
       CASE WHEN {PAIR_METRES} < 0.5 THEN 'same' WHEN {PAIR_METRES} < 1.0
            THEN 'small dif' ELSE 'big dif' END AS "match"
FROM a JOIN b ON a.rank = b.rank""",
    ),
)
def knn_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    layouts = stored_layouts(
        spark, sf_dir, "Base Parquet", "Fixed Segments (index)"
    )
    base = knn.knn_points(layouts["Base Parquet"], POINT, K)
    fixed = knn.knn_fixed_index(
        layouts["Fixed Segments (index)"], POINT, K, TOP_CENTROIDS
    )
    return compare_knn(base, fixed).withColumns(
        {c: to_micro(F.col(c)) for c in ("lat_diff", "lon_diff", "distance_m")}
    )


PARITY_NAMES = (
    ("Base Parquet", "Base Parquet"),
    ("CSV", "CSV"),
    ("Other", "GeoParquet"),
    ("Other", "GeoParquet (small groups)"),
    ("Fixed Segments", "Fixed Segments (bounds)"),
    ("Fixed Segments", "Fixed Segments (points)"),
    ("Grid Segments", "Grid Segments (bounds)"),
    ("Grid Segments", "Grid Segments (points)"),
)


@query(
    "layout_parity",
    with_(
        ROWS,
        f"""
found AS (SELECT count(*) AS n FROM (
  SELECT DISTINCT traj_id, lat, lon FROM pts WHERE {in_box_sql(BOX)}))""",
        "SELECT category, layout, n AS n_matches, CAST(0 AS BIGINT) AS diff,"
        " 0e0 AS rel_diff FROM found, (VALUES "
        + ", ".join(f"('{category}', '{name}')" for category, name in PARITY_NAMES)
        + ") names(category, layout)",
    ),
)
def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_parity(bbox_results(stored_layouts(spark, sf_dir), BOX), CATEGORIES)


@query(
    "bbox_report",
    with_(
        ROWS,
        f"""
found AS (SELECT count(*) AS n FROM (
  SELECT DISTINCT traj_id, lat, lon FROM pts WHERE {in_box_sql(BOX)}))""",
        "SELECT category, layout, n AS n_matches, CAST(0 AS BIGINT) AS diff,"
        " 0e0 AS rel_diff FROM found, (VALUES "
        + ", ".join(f"('{category}', '{name}')" for category, name in PARITY_NAMES)
        + ") names(category, layout) ORDER BY category, layout",
    ),
)
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbox_report(stored_layouts(spark, sf_dir), BOX)


@query(
    "layout_parity_differs",
    with_(
        ROWS,
        f"""
counts AS (SELECT
  (SELECT count(*) FROM (SELECT DISTINCT traj_id, lat, lon FROM pts
                         WHERE {in_box_sql(BOX)})) AS a,
  (SELECT count(*) FROM (SELECT DISTINCT traj_id, lat, lon FROM pts
                         WHERE {in_box_sql(HALF_BOX)})) AS b)""",
        "SELECT 'Other' AS category, 'whole' AS layout, a AS n_matches,"
        " CAST(0 AS BIGINT) AS diff, 0e0 AS rel_diff FROM counts UNION ALL"
        " SELECT 'Other', 'half', b, b - a, (b - a) / CAST(a AS DOUBLE) FROM counts",
    ),
)
def parity_differs(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = lineitem_points(spark, sf_dir)
    boxes = {"whole": BOX, "half": HALF_BOX}
    return layout_parity({n: bbox.bbox_points(points, b) for n, b in boxes.items()})


@query(
    "layout_agreement",
    with_(
        ROWS,
        f"""
counts AS (SELECT
  (SELECT count(*) FROM (SELECT DISTINCT traj_id, lat, lon FROM pts
                         WHERE {in_box_sql(BOX)})) AS a,
  (SELECT count(*) FROM (SELECT DISTINCT traj_id, lat, lon FROM pts
                         WHERE {in_box_sql(HALF_BOX)})) AS b)""",
        "SELECT name AS layout, a AS n_rows, true AS agrees FROM counts, (VALUES "
        + ", ".join(f"('{name}')" for _, name in PARITY_NAMES)
        + ") names(name) UNION ALL SELECT 'half', b, a = b FROM counts",
    ),
)
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which layouts give the same rows, and not just as many."""
    layouts = stored_layouts(spark, sf_dir)
    results = bbox_results(layouts, BOX) | {"half": bbox.bbox_points(layouts["Base Parquet"], HALF_BOX)}
    return layout_agreement({name: as_positions(r) for name, r in results.items()})


@query(
    "layout_differences",
    with_(
        ROWS,
        """
damaged AS (
  SELECT traj_id, lat + CASE WHEN altitude = 7 AND seq % 5 = 0 THEN 0.5e0 ELSE 0 END AS lat,
         lon, "timestamp" FROM pts WHERE NOT (altitude = 11 AND seq % 3 = 0)),
counts AS (
  SELECT traj_id, lat, lon, "timestamp", 1 AS a, 0 AS b FROM pts
  UNION ALL SELECT traj_id, lat, lon, "timestamp", 0, 1 FROM damaged)""",
        """
SELECT 'damaged' AS layout, traj_id, lat, lon, "timestamp",
       CAST(sum(a) AS BIGINT) AS n_first, CAST(sum(b) AS BIGINT) AS n_other
FROM counts GROUP BY traj_id, lat, lon, "timestamp" HAVING sum(a) <> sum(b)""",
    ),
)
def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points against another layout of them and against a copy in which some are
    moved and some are lost."""
    points = stored_layout(spark, sf_dir, "Base Parquet")
    moved, lost = (F.col("altitude") == 7) & (F.col("seq") % 5 == 0), (F.col("altitude") == 11) & (F.col("seq") % 3 == 0)
    broken = points.where(~lost).withColumn("lat", F.col("lat") + F.when(moved, 0.5).otherwise(0.0))
    results = {"Base Parquet": points, "CSV": stored_layout(spark, sf_dir, "CSV"), "damaged": broken}
    return layout_differences({name: as_positions(r) for name, r in results.items()})


def counted_sql(name: str, segments: str) -> str:
    inner = with_(segments, "SELECT count(*) FROM (SELECT DISTINCT entity_id, segment_id FROM members)")
    return f"{name} AS (SELECT n FROM ({inner}) c(n))"


PROFILE_SQL = with_(
    ROWS,
    "points AS (SELECT count(*) AS n FROM pts)",
    counted_sql("fixed", FIXED),
    counted_sql("grid", GRID_ALL),
    """
sizes AS (
  SELECT unnest(['Base Parquet', 'CSV', 'GeoParquet', 'GeoParquet (small groups)']) AS name,
         n AS "rows" FROM points
  UNION ALL SELECT unnest(['Fixed Segments', 'Fixed Segments (index)']), n FROM fixed
  UNION ALL SELECT unnest(['Grid Segments', 'Grid Segments (index)']), n FROM grid)""",
    f"""
SELECT name, "rows",
       {micro_sql('100e0 * ("rows" - min("rows") OVER ()) / min("rows") OVER ()')} AS percent,
       CAST(dense_rank() OVER (ORDER BY "rows") AS INTEGER) AS size_rank
FROM sizes""",
)


@query(
    "layout_profile",
    PROFILE_SQL,
)
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every layout, compared by rows: bytes depend on the writer."""
    found = layout_profile(spark, stored_layouts(spark, sf_dir), by="rows")
    return found.select("name", "rows", to_micro(F.col("percent_above_smallest")).alias("percent"), "size_rank")


@query(
    "csv_roundtrip",
    with_(ROWS, 'SELECT traj_id, seq, lat, lon, altitude, "timestamp" FROM pts'),
)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_layout(spark, sf_dir, "CSV")


@query(
    "layouts_built",
    with_(
        FIXED,
        "SELECT 'points' AS layout, count(*) AS n_rows FROM pts UNION ALL"
        " SELECT 'segments_fixed', count(DISTINCT (entity_id, segment_id))"
        " FROM members",
    ),
)
def layouts_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second build leaves what exists alone and ends with the same rows."""
    names = ("Base Parquet", "Fixed Segments")
    stored_layouts(spark, sf_dir, *names)
    layouts = stored_layouts(spark, sf_dir, *names)
    count = F.count(F.lit(1)).alias("n_rows")
    return (
        layouts["Base Parquet"]
        .agg(count)
        .select(F.lit("points").alias("layout"), "n_rows")
        .unionByName(
            layouts["Fixed Segments"]
            .agg(count)
            .select(F.lit("segments_fixed").alias("layout"), "n_rows")
        )
    )
