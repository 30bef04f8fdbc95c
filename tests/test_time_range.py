"""Segments by place and time, by brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pathweave.functions.times import micros, micros_of
from pathweave.operators.rectangle_join import SEGMENT_COLUMNS, match_rectangles
from pathweave.operators.segmentation import fixed_segments
from pathweave.operators.time_range import bbox_batch_between, bbox_segments_between, segments_between
from pathweave.schemas import BBox
from pathweave.sources.segments import read_segments, read_segments_by_time, write_segments
from tests.helpers import START, line, plan_text, points

BOX = ("min_lat", "max_lat", "min_lon", "max_lon")
BOXES = "box_id long, min_lat double, max_lat double, min_lon double, max_lon double, from_t timestamp_ntz, to_t timestamp_ntz"
RECTS = "id long, min_x double, max_x double, min_y double, max_y double, min_t timestamp_ntz, max_t timestamp_ntz"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_micros_are_exact_in_any_zone(spark, zone):
    moments = [datetime(1970, 1, 1), datetime(1969, 12, 31, 23, 59, 59, 999_999), datetime(1816, 3, 29, 5, 56, 8, 66_000), datetime(2023, 3, 12, 2, 30), datetime(2023, 3, 12, 3, 0), datetime(2100, 2, 28, 12, 0, 0, 1)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(n, m) for n, m in enumerate([*moments, None])], "n long, t timestamp_ntz")
        got = [r.us for r in rows.orderBy("n").select(micros("t").alias("us")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [*map(micros_of, moments), None]


def ranges(rng, n):
    """Of every length from a moment to decades, before and after 1970."""
    at = datetime(1975, 1, 1) + timedelta(seconds=rng.choice([0, rng.uniform(-1e9, 1e9), rng.uniform(-100, 100)]))
    return at, at + timedelta(seconds=0 if n % 4 == 0 else 10 ** rng.uniform(-5, 9))


def places(rng, n):
    lat, lon = (40.0, 116.0) if n % 2 else (40 + rng.uniform(-1, 1), 116 + rng.uniform(-1, 1))
    return lat, lat + 10 ** rng.uniform(-6, 0), lon, lon + 10 ** rng.uniform(-6, 0)


@pytest.mark.parametrize("hot_rows", [None, 6])
def test_every_pair_once_in_place_and_time(spark, hot_rows):
    rng = random.Random(8)
    odd = [(40.0, 41.0, 116.0, 117.0, None, datetime(1980, 1, 1)), (40.0, 41.0, 116.0, 117.0, datetime(1980, 1, 1), datetime(1979, 1, 1)), (40.0, 41.0, 116.0, 117.0, datetime(1, 1, 1), datetime(9999, 12, 31))]
    left = [(n, *places(rng, n), *ranges(rng, n)) for n in range(90)] + [(900 + i, *r) for i, r in enumerate(odd)]
    right = [(n, *places(rng, n), *ranges(rng, n)) for n in range(110)] + [(900 + i, *r) for i, r in enumerate(odd)]
    valid = lambda r: None not in r and r[5] <= r[6]
    want = sorted(
        (a[0], b[0])
        for a in left
        for b in right
        if valid(a) and valid(b) and a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4] and a[5] <= b[6] and b[5] <= a[6]
    )
    a, b = spark.createDataFrame(left, BOXES), spark.createDataFrame(right, RECTS)
    found = match_rectangles(a, b, BOX, SEGMENT_COLUMNS, hot_rows, ("from_t", "to_t"), ("min_t", "max_t"))
    assert sorted((r.box_id, r.id) for r in found.collect()) == want and len(want) > 100
    with pytest.raises(ValueError, match="one side"):
        match_rectangles(a, b, BOX, SEGMENT_COLUMNS, left_times=("from_t", "to_t"))


def test_batch_is_the_single_queries(spark):
    tracks = {"a": line(400), "b": line(300, lon=116.0003), "parked": [(40.005, 116.0)] * 200}
    segments = fixed_segments(points(spark, tracks), 25).cache()
    rng = random.Random(2)
    boxes = []
    for n in range(12):
        lat, start = 40 + rng.uniform(0, 0.03), START + timedelta(seconds=rng.uniform(-20, 300))
        boxes.append((n, lat, lat + 10 ** rng.uniform(-4, -1), 115.9, 116.1, start, start + timedelta(seconds=10 ** rng.uniform(0, 3))))
    boxes.append((50, 40.0, 41.0, 116.0, 117.0, START + timedelta(seconds=9), START))
    boxes.append((51, 40.005, 40.005, 116.0, 116.0, START + timedelta(seconds=60), START + timedelta(seconds=70)))
    got = {}
    for r in bbox_batch_between(segments, spark.createDataFrame(boxes, BOXES), hot_rows=9).collect():
        got.setdefault(r.box_id, []).append((r.entity_id, r.lat, r.lon, r.timestamp))
    for n, a, b, c, d, start, end in boxes:
        single = [tuple(r) for r in bbox_segments_between(segments, BBox(a, b, c, d), start, end).collect()]
        seen, want = set(), []
        for traj, track in tracks.items():
            for seq, (lat, lon) in enumerate(track):
                if a <= lat <= b and c <= lon <= d and start <= START + timedelta(seconds=seq) <= end and (traj, lat, lon) not in seen:
                    seen.add((traj, lat, lon))
                    want.append((traj, lat, lon, START + timedelta(seconds=seq)))
        assert sorted(single) == sorted(got.get(n, [])) == sorted(want)
    # the parked one's first point within the range, not its first of all
    assert ("parked", 40.005, 116.0, START + timedelta(seconds=60)) in got[51]
    segments.unpersist()


def rows_scanned(df):
    """Rows that the scan hands on, which leaves out skipped row groups."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo = [plan]
    while todo:
        node = todo.pop()
        if "Scan parquet" in node.nodeName():
            total += node.metrics().get("numOutputRows").get().value()
        children = node.children().iterator()
        while children.hasNext():
            todo.append(children.next())
    return total


def test_a_range_of_time_reads_few_row_groups(spark, tmp_path):
    """All segments lie in one place, so only time tells their row groups apart."""
    rows = spark.range(0, 40_000, 1, 4).select(
        F.lit("000").alias("user_id"),
        (F.col("id") % 8).cast("string").alias("traj_id"),
        F.floor(F.col("id") / 8).alias("seq"),
        F.lit(40.0).alias("lat"),
        F.lit(116.0).alias("lon"),
        F.lit(0.0).alias("altitude"),
        F.expr("TIMESTAMP_NTZ'2008-01-01 00:00:00' + make_dt_interval(0, CAST(id div 8 AS INT))").alias("timestamp"),
    )
    segments = fixed_segments(rows, 5)
    write_segments(segments, str(tmp_path / "s"), partitions=8, slab_hours=240)
    stored = read_segments_by_time(spark, str(tmp_path / "s"))
    start, end = datetime(2008, 3, 1), datetime(2008, 3, 3)
    box = BBox(39.0, 41.0, 115.0, 117.0)
    asked = segments_between(stored, box, start, end)
    assert "first_us" in plan_text(asked).split("PushedFilters")[1].split("\n")[0]
    want = segments.where((F.col("max_t") >= F.lit(start)) & (F.col("min_t") <= F.lit(end)))
    keys = lambda df: sorted((r.entity_id, r.segment_id) for r in df.select("entity_id", "segment_id").collect())
    assert keys(asked) == keys(want) and len(keys(want)) > 0
    # the range touches two of eight files of about the same size
    assert rows_scanned(asked.select("entity_id", "segment_id")) <= stored.count() * 3 / 8
    write_segments(segments, str(tmp_path / "plain"), partitions=8)
    plain = segments_between(read_segments(spark, str(tmp_path / "plain")), box, start, end)
    assert keys(plain) == keys(want)
    assert rows_scanned(plain.select("entity_id", "segment_id")) == stored.count()
