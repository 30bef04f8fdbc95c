import random

import pytest
from pyspark.sql import functions as F

from pathweave.operators.bbox import (
    bbox_points,
    bbox_segments,
    segments_overlapping,
    segments_touching,
)
from pathweave.operators.bbox_batch import bbox_batch, match_boxes
from pathweave.operators.extent import point_extent
from pathweave.operators.segmentation import fixed_segments, grid_segments
from pathweave.schemas import BBox
from pathweave.sources.segments import scan_segments
from tests.helpers import points

BOX = BBox(40.0, 41.0, 116.0, 117.0)
EDGE = [(40.0, 116.0), (40.0, 116.5), (41.0, 117.0), (40.5, 117.0)]
INSIDE = [(40.5, 116.5)]
OUTSIDE = [(39.999999, 116.5), (40.5, 117.000001), (42.0, 118.0)]


def test_box_orders_agree():
    assert BBox.from_lonlat(116.0, 40.0, 117.0, 41.0) == BOX
    assert BBox.from_corners(40.0, 116.0, 41.0, 117.0) == BOX


def test_closed_and_open_box(spark):
    rows = points(spark, {"t": EDGE + INSIDE + OUTSIDE})
    assert bbox_points(rows, BOX).count() == 5
    assert bbox_points(rows, BOX, boundary=False).count() == 1


def test_first_of_repeated_positions_survives(spark):
    spot = (40.5, 116.5)
    rows = points(spark, {"a": [spot, (40.6, 116.5), spot], "b": [spot]})
    got = bbox_points(rows.repartition(4), BOX).orderBy("traj_id", "seq").collect()
    assert [(r.traj_id, r.seq, r.altitude) for r in got] == [
        ("a", 0, 100.0),
        ("a", 1, 101.0),
        ("b", 0, 100.0),
    ]


def test_overlap_without_a_point_inside(spark):
    around = [(39.0, 115.0), (42.0, 115.0), (42.0, 118.0)]
    segments = fixed_segments(points(spark, {"t": around, "in": INSIDE}))
    assert segments_overlapping(segments, BOX).count() == 2
    assert [r.entity_id for r in segments_touching(segments, BOX).collect()] == ["in"]


def test_refine_merges_at_six_decimals(spark):
    near = [(40.5, 116.5), (40.5 + 1e-7, 116.5), (40.5 + 2e-6, 116.5)]
    segments = fixed_segments(points(spark, {"t": near}))
    got = bbox_segments(segments, BOX).orderBy("lat").collect()
    assert [r.lat for r in got] == [40.5, 40.5 + 2e-6]
    assert got[0].timestamp is not None


def test_layouts_agree(spark):
    rng = random.Random(11)
    track = {
        f"t{t}": [
            (round(39.9 + rng.random() * 1.2, 3), round(115.9 + rng.random() * 1.2, 3))
            for _ in range(120)
        ]
        for t in range(5)
    }
    rows = points(spark, track)
    expected = {
        (t, lat, lon)
        for t, ps in track.items()
        for lat, lon in ps
        if 40.0 <= lat <= 41.0 and 116.0 <= lon <= 117.0
    }
    plain = {(r.traj_id, r.lat, r.lon) for r in bbox_points(rows, BOX).collect()}
    assert plain == expected
    for segments in (
        fixed_segments(rows, 10),
        grid_segments(rows, point_extent(rows), 0.1),
        grid_segments(rows, point_extent(rows), 2.0, part_points=7),
    ):
        for coarse in ("bounds", "points"):
            got = bbox_segments(segments, BOX, coarse).collect()
            assert len(got) == len(expected)
            assert {(r.entity_id, r.lat, r.lon) for r in got} == expected
    with pytest.raises(ValueError):
        bbox_segments(segments, BOX, "guess")


def test_empty_inputs_keep_their_columns(spark):
    empty = points(spark, {})
    assert bbox_points(empty, BOX).columns == empty.columns
    segments = fixed_segments(empty)
    assert bbox_segments(segments, BOX).columns == [
        "entity_id",
        "lat",
        "lon",
        "timestamp",
    ]


def test_segment_scan_projects(spark):
    segments = fixed_segments(points(spark, {"t": INSIDE}))
    assert scan_segments(segments, BOX, ["entity_id"]).columns == ["entity_id"]
    assert "min_t" not in scan_segments(segments, BOX).columns


BOXES = "box_id int, min_lat double, max_lat double, min_lon double, max_lon double"


@pytest.mark.parametrize("salts", [1, 4])
def test_batch_boxes_of_every_size(spark, salts):
    rng = random.Random(5)
    track = {
        f"t{t}": [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
        + [(rng.uniform(39.99, 40.01), rng.uniform(115.99, 116.01)) for _ in range(60)]
        + [(40.0, 116.0), (-0.0, 0.0)]
        for t in range(3)
    }
    boxes = []
    for n in range(60):
        lat, lon = (40.0, 116.0) if n % 2 else (rng.uniform(-90, 90), rng.uniform(-180, 180))
        high, wide = 10 ** rng.uniform(-7, 2), 10 ** rng.uniform(-7, 2)
        boxes.append((n, lat, lat + high, lon, lon + wide))
    boxes.append((100, -90.0, 90.0, -180.0, 180.0))
    boxes.append((101, 40.0, 40.0, 116.0, 116.0))
    boxes.append((102, 41.0, 40.0, 116.0, 117.0))
    boxes.append((103, 0.0, 0.0, 0.0, 0.0))
    rows = points(spark, track)
    got = bbox_batch(rows, spark.createDataFrame(boxes, BOXES), salts=salts)
    expected = {
        (n, t, lat + 0.0, lon)
        for n, a, b, c, d in boxes
        for t, ps in track.items()
        for lat, lon in ps
        if a <= lat <= b and c <= lon <= d
    }
    assert {
        (r.box_id, r.traj_id, r.lat + 0.0, r.lon) for r in got.collect()
    } == expected
    assert got.count() == len(expected)


def test_batch_boxes_carry_the_columns_asked_for(spark):
    """The first of repeated positions by an order of several columns, of all columns or some."""
    rows = points(spark, {"t": [(40.0, 116.0)] * 3 + [(40.1, 116.0)]}).withColumn("altitude", F.col("seq").cast("double"))
    boxes = spark.createDataFrame([(1, 39.0, 41.0, 115.0, 117.0)], BOXES)
    found = bbox_batch(rows, boxes, order=("timestamp", "seq"), columns=["traj_id", "lat", "altitude"])
    assert found.columns == ["box_id", "traj_id", "lat", "altitude"]
    assert sorted(map(tuple, found.collect())) == [(1, "t", 40.0, 0.0), (1, "t", 40.1, 3.0)]
    whole = bbox_batch(rows, boxes, order=("timestamp", "seq"))
    assert whole.columns == ["box_id", *rows.columns] and whole.count() == 2


def test_no_boxes_no_rows(spark):
    rows = points(spark, {"t": INSIDE})
    assert match_boxes(rows, spark.createDataFrame([], BOXES)).count() == 0


def test_crowded_cell_is_split_by_the_planner(spark):
    """One cell with most rows: the shuffled join reads it in several pieces."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        rows = spark.range(200_000, numPartitions=8).select(
            F.lit("t").alias("traj_id"),
            F.col("id").alias("seq"),
            (40.0 + F.when(F.col("id") % 3 > 0, F.rand(1)).otherwise(0.0)).alias("lat"),
            F.lit(116.0).alias("lon"),
        )
        boxes = spark.createDataFrame(
            [(1, 40.0, 40.0, 116.0, 116.0), (2, 40.2, 40.2, 116.0, 116.0)], BOXES
        )
        matched = match_boxes(rows, boxes)
        assert matched.where("box_id = 1").count() >= 66_667
        matched.collect()
        plan = matched._jdf.queryExecution().executedPlan().toString()
        assert "isSkew=true" in plan or "skew=true" in plan
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
