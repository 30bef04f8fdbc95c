"""k-NN for a table of queries over segments, against a full sort."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pathweave.functions.bounds_distance import greatest_metres, least_metres
from pathweave.operators import knn_batch as module
from pathweave.operators import knn_batch_segments as segments_module
from pathweave.operators.extent import point_extent
from pathweave.operators.knn_batch import knn_batch
from pathweave.operators.knn_batch_segments import (
    build_bounds_pyramid,
    cells_in_play,
    knn_batch_segments,
    segments_needed,
)
from pathweave.operators.segmentation import fixed_segments, grid_segments
from pathweave.schemas import GridSpec
from tests.helpers import metres, nearest, points

QUERIES = "query_id long, lat double, lon double"


def test_bounds_of_the_distance_to_a_rectangle(spark):
    """Against a fine raster of each rectangle, poles and antimeridian included."""
    rng = random.Random(8)
    rows = []
    for n in range(120):
        a, b = sorted(rng.uniform(-90, 90) for _ in range(2))
        c, d = sorted(rng.uniform(-180, 180) for _ in range(2))
        if n % 3 == 0:
            b, d = min(90.0, a + rng.random()), min(180.0, c + rng.random())
        if n % 10 == 0:
            b = 90.0
        if n % 10 == 1:
            a, c, d = -90.0, -180.0, 180.0
        if n % 10 == 2:
            b, d = a, c
        q = (rng.uniform(-90, 90), rng.uniform(-180, 180))
        if n % 4 == 0:
            q = (min(90.0, b + rng.uniform(-1, 2)), max(-180.0, c - rng.uniform(-1, 2)))
        rows.append((n, *q, a, b, c, d))
    names = ("lat", "lon", "a", "b", "c", "d")
    df = spark.createDataFrame(rows, ["n", *names])
    args = [F.col(x) for x in names]
    for r in df.select("n", least_metres(*args).alias("near"), greatest_metres(*args).alias("far")).collect():
        _, lat, lon, a, b, c, d = rows[r.n]
        steps = [(a + (b - a) * i / 60, c + (d - c) * j / 60) for i in range(61) for j in range(61)]
        away = [metres(lat, lon, *p) for p in steps]
        assert r.near <= min(away) + 1e-3 and max(away) <= r.far + 1e-3
        # a raster point is never farther from the true ends than its own spacing
        spacing = math.radians(max(b - a, d - c) / 60) * 6371000.0
        assert min(away) - r.near <= spacing + 1e-3 and r.far - max(away) <= spacing + 1e-3


def spread(rng):
    tracks = {}
    for t in range(5):
        lat, lon, track = rng.choice([(40.0, 116.0), (89.9, 10.0), (-10.0, 179.99)]), None, []
        lat, lon = lat
        for _ in range(120):
            lat = max(-90.0, min(90.0, lat + rng.uniform(-8e-4, 8e-4)))
            lon = (lon + rng.uniform(-8e-4, 8e-4) + 180) % 360 - 180
            track += [(lat, lon)] * rng.choice([1, 1, 2])
        tracks[f"t{t}"] = track
    # one place with most of the points, and the same places in another trajectory
    tracks["parked"] = [(40.0, 116.0)] * 400
    tracks["again"] = tracks["t0"][::-1]
    tracks["far"] = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
    return tracks


def asked(rng):
    rows = [(n, 40 + rng.uniform(-0.02, 0.02), 116 + rng.uniform(-0.02, 0.02)) for n in range(8)]
    rows += [(20, 90.0, 0.0), (21, -90.0, 5.0), (22, -10.0, -179.99), (23, 40.0, 116.0), (24, 0.0, 0.0), (25, 40.0, 476.0)]
    return rows


@pytest.mark.parametrize("k, kind", [(7, "fixed"), (90, "parts")])
def test_answers_are_those_of_a_full_sort(spark, k, kind):
    tracks = spread(random.Random(2))
    rows = points(spark, tracks)
    if kind == "fixed":
        segments = fixed_segments(rows, 15)
    else:
        segments = grid_segments(rows, GridSpec(-90.0, -180.0), 0.001, part_points=10)
    queries = asked(random.Random(3))
    found = knn_batch_segments(segments, spark.createDataFrame(queries, QUERIES), k)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.traj_id, r.lat, r.lon))
    flat = [(t, lat, lon) for t, track in tracks.items() for lat, lon in track]
    for query_id, lat, lon in queries:
        assert got[query_id] == nearest(flat, (lat, lon), k), query_id


def test_same_as_over_points(spark):
    rows = points(spark, spread(random.Random(5)))
    queries = spark.createDataFrame(asked(random.Random(6)) + [(99, None, 1.0)], QUERIES)
    segments = grid_segments(rows, point_extent(rows), 0.001)
    ours = knn_batch_segments(segments, queries, 6).collect()
    assert sorted(map(tuple, ours)) == sorted(map(tuple, knn_batch(rows, queries, 6).collect()))


def test_odd_coordinates_and_few_positions(spark):
    tracks = {"a": [(400.0, 20.0), (40.0, 380.0)], "b": [(40.0, 20.0), (-0.0, 0.0), (0.0, -0.0)], "c": [(40.0, 20.0)] * 3}
    segments = fixed_segments(points(spark, tracks), 2)
    queries = spark.createDataFrame([(1, 40.0, 20.0), (2, 0.0, 0.0)], QUERIES)
    got = {}
    for r in knn_batch_segments(segments, queries, 50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.traj_id, r.lat, r.lon))
    flat = [(t, lat, lon) for t, track in tracks.items() for lat, lon in track]
    for query_id, point in ((1, (40.0, 20.0)), (2, (0.0, 0.0))):
        assert {p[1:] for p in got[query_id]} == {p[1:] for p in nearest(flat, point, 50)}
        assert len(got[query_id]) == len({(lat + 0.0, lon + 0.0) for _, lat, lon in flat})
    assert knn_batch_segments(segments.limit(0), queries, 3).count() == 0
    assert knn_batch_segments(segments, queries.limit(0), 3).count() == 0
    assert knn_batch_segments(segments, queries, 0).count() == 0


def test_most_segments_stay_closed(spark):
    """A few queries in a large area open a small part of the segments, and one pyramid
    serves smaller k, too."""
    rng = random.Random(9)
    tracks = {f"t{t}": [(39.5 + t / 25 + i * 1e-4, 116.0 + rng.uniform(0, 1e-3)) for i in range(200)] for t in range(25)}
    segments = fixed_segments(points(spark, tracks), 10).cache()
    pyramid = build_bounds_pyramid(segments, 20)
    queries = spark.createDataFrame([(n, 40.0 + n / 100, 116.0) for n in range(3)], QUERIES)
    cells = cells_in_play(pyramid, queries, 5).cache()
    needed = segments_needed(segments, cells)
    assert 0 < needed.count() < segments.count() / 25
    flat = [(t, lat, lon) for t, track in tracks.items() for lat, lon in track]
    got = knn_batch_segments(segments, queries, 5, pyramid).orderBy("query_id", "rank").collect()
    want = [p for n in range(3) for p in nearest(flat, (40.0 + n / 100, 116.0), 5)]
    assert [(r.traj_id, r.lat, r.lon) for r in got] == want
    segments.unpersist()
    cells.unpersist()


def test_queries_from_one_place_are_answered_once(spark, monkeypatch):
    """However many queries ask from a position, it meets the cells as one row; and
    without a stored pyramid no query looks for cells of segments at all."""
    asked = []
    original = module.candidate_cells
    monkeypatch.setattr(module, "candidate_cells", lambda pyramid, queries, k: asked.append(queries.count()) or original(pyramid, queries, k))
    monkeypatch.setattr(segments_module, "cells_in_play", None)
    tracks = {t: [(40.0 + i * 1e-3, 116.0 + int(t) * 1e-4) for i in range(30)] for t in "123"}
    rows = points(spark, tracks)
    places = [(40.0105, 116.0), (40.02, 116.1), (-40.0, 10.0)]
    queries = [(n, *places[n % 3]) for n in range(60)] + [(99, None, 116.0)]
    asking = spark.createDataFrame(queries, QUERIES)
    found = knn_batch_segments(fixed_segments(rows, 7), asking, 4)
    own = [(t, *p) for t, track in tracks.items() for p in track]
    got = found.orderBy("query_id", "rank").collect()
    assert asked == [3]
    for n in range(60):
        assert [(r.traj_id, r.lat, r.lon) for r in got if r.query_id == n] == [x[:3] for x in nearest(own, places[n % 3], 4)]
    assert len(got) == 240 and sorted(got) == sorted(knn_batch(rows, asking, 4).collect())
