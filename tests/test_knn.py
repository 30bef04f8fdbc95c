import random

import pytest
from pyspark.sql import functions as F

from pathweave.operators import knn
from pathweave.operators.compare import compare_knn, layout_parity
from pathweave.operators.extent import point_extent
from pathweave.operators.index import fixed_index, grid_index
from pathweave.operators.knn_batch import build_pyramid, candidate_cells, knn_batch
from pathweave.operators.segmentation import fixed_segments, grid_segments
from pathweave.schemas import GridSpec
from tests.helpers import line, metres, nearest, points


def random_tracks(seed, n_tracks=6, n=80, lat=40.0, lon=116.0, spread=0.05):
    rng = random.Random(seed)
    return {
        f"t{t}": [
            (
                round(lat + rng.gauss(0, spread), 3),
                round(lon + rng.gauss(0, spread), 3),
            )
            for _ in range(n)
        ]
        for t in range(n_tracks)
    }


def flat(tracks):
    return [(t, lat, lon) for t, ps in tracks.items() for lat, lon in ps]


def answer(result):
    return [(r.traj_id, r.lat, r.lon) for r in result.collect()]


@pytest.mark.parametrize("point", [(40.0, 116.0), (40.0123, 116.0456), (47.0, 100.0)])
@pytest.mark.parametrize("k", [1, 7, 100, 10_000])
def test_exact_on_every_layout(spark, point, k):
    tracks = random_tracks(1)
    expected = nearest(flat(tracks), point, k)
    rows = points(spark, tracks).repartition(6)
    assert answer(knn.knn_points(rows, point, k)) == expected
    if k == 7:
        assert answer(knn.knn_points(rows, point, k, guess_degrees=None)) == expected
        fixed = fixed_segments(rows, 10)
        assert answer(knn.knn_segments(fixed, point, k)) == expected
        grid = grid_segments(rows, point_extent(rows), 0.01)
        assert answer(knn.knn_segments(grid, point, k)) == expected


@pytest.mark.parametrize(
    "point", [(10.0, 179.99), (89.9, 20.0), (-90.0, 0.0), (0.0, -180.0)]
)
def test_exact_at_the_seams_of_the_globe(spark, point):
    rng = random.Random(2)
    lat, lon = point
    track = [
        (
            max(-90.0, min(90.0, lat + rng.gauss(0, 0.5))),
            (lon + rng.gauss(0, 30 if abs(lat) > 80 else 0.5) + 180) % 360 - 180,
        )
        for _ in range(300)
    ]
    # the same place written with a turn too many
    track += [(lat + 360.0, lon), (lat, lon + 359.9)]
    tracks = {"t": track}
    expected = nearest(flat(tracks), point, 9)
    rows = points(spark, tracks)
    assert answer(knn.knn_points(rows, point, 9)) == expected
    asked = spark.createDataFrame([(1, *point)], "query_id int, lat double, lon double")
    batch = knn_batch(rows, asked, 9).orderBy("rank")
    assert answer(batch) == expected


def test_no_k_and_no_points(spark):
    rows = points(spark, {"t": line(5)})
    assert knn.knn_points(rows, (40.0, 116.0), 0).count() == 0
    empty = points(spark, {})
    got = knn.knn_points(empty, (40.0, 116.0), 3)
    assert got.count() == 0 and got.columns == list(knn.KNN_COLUMNS)
    segments = fixed_index(fixed_segments(empty))
    assert knn.knn_fixed_index(segments, (40.0, 116.0), 3).count() == 0
    grid = grid_index(grid_segments(empty, point_extent(empty)))
    assert knn.knn_grid_index(grid, (40.0, 116.0), 3).count() == 0


def test_shared_position_counts_once(spark):
    rows = points(spark, {"b": [(40.0, 116.0)] * 50, "a": [(40.0, 116.0), (40.1, 116.0)]})
    got = knn.knn_points(rows, (40.0, 116.0), 3).collect()
    assert [(r.traj_id, r.lat) for r in got] == [("a", 40.0), ("a", 40.1)]
    assert got[0].distance == 0.0


def test_signed_zero_is_one_position(spark):
    rows = points(spark, {"a": [(0.0, 0.0), (-0.0, -0.0), (1.0, 0.0), (2.0, 0.0)]})
    got = knn.knn_points(rows, (0.0, 0.0), 2).collect()
    assert [r.lat + 0.0 for r in got] == [0.0, 1.0]


def test_carried_points_repeat_without_dedup(spark):
    segments = fixed_segments(points(spark, {"t": line(6)}), 2)
    got = knn.knn_segment_points(segments, (40.0001, 116.0), 3).collect()
    assert [r.lat for r in got] == [40.0001, 40.0001, 40.0]


def test_fixed_index_searches_containing_segments_only(spark):
    tracks = {"near": [(40.0, 116.0), (40.2, 116.2)], "close": [(40.1, 116.3)]}
    index = fixed_index(fixed_segments(points(spark, tracks)))
    got = knn.knn_fixed_index(index, (40.1, 116.15), 5).collect()
    assert {r.traj_id for r in got} == {"near"}
    assert knn.knn_fixed_index(index, (50.0, 116.15), 5).count() == 0
    exact = knn.knn_segments(index, (40.1, 116.15), 3).collect()
    for approximate, best in zip(got, exact):
        assert approximate.distance >= best.distance


def test_nearest_centroids(spark):
    tracks = {f"t{n}": [(40.0 + n, 116.0)] for n in range(5)}
    index = fixed_index(fixed_segments(points(spark, tracks)))
    got = knn.nearest_centroids(index, (42.1, 116.0), 2).collect()
    assert [r.entity_id for r in got] == ["t2", "t3"]


def test_grid_index_searches_all_segments_of_matching_entities(spark):
    there = [(40.0005, 116.0005), (40.0105, 116.0005), (40.0106, 116.0005)]
    tracks = {"in": there, "out": [(40.0106, 116.0005), (40.0107, 116.0005)]}
    rows = points(spark, tracks)
    spec = GridSpec(40.0, 116.0, 0.001)
    index = grid_index(grid_segments(rows, spec), 0.001, spec)
    got = knn.knn_grid_index(index, (40.0005, 116.0005), 9, grid=spec)
    assert answer(got) == [("in", lat, lon) for lat, lon in there]
    ring = knn.knn_segments(index, (40.0105, 116.0005), 9, ring=1, grid=spec)
    assert {r.traj_id for r in ring.collect()} == {"out"}
    far = knn.knn_grid_index(index, (41.0, 117.0), 9, grid=spec)
    assert far.count() == 0


def test_ring_reads_text_labels(spark):
    rows = points(spark, random_tracks(4, 2, 40, spread=0.002))
    index = grid_index(grid_segments(rows, point_extent(rows)))
    spec = knn.resolve_grid(index)
    point = (40.0, 116.0)
    a = knn.ring_filter(index, point, spec).count()
    b = knn.ring_filter(index.drop("cell_i", "cell_j"), point, spec).count()
    assert a == b > 0


def test_geo_bins_and_duplicates(spark):
    rows = points(spark, {"t": [(39.0, 116.0)] * 2 + [(39.015, 116.0), (39.05, 116.0)]})
    got = knn.knn_geoparquet(rows, (39.0, 116.0), 5).collect()
    # 39.0 falls in a bin of its own on both sides, so one more ring reaches 39.015
    assert [r.lat for r in got] == [39.0, 39.0, 39.015]
    assert got[0].distance == 0.0
    negative = points(spark, {"t": [(-0.005, -0.005), (0.005, 0.015), (0.005, 0.025)]})
    got = knn.knn_geoparquet(negative, (0.001, 0.001), 5)
    assert got.count() == 2


@pytest.mark.parametrize("k", [1, 5, 70])
def test_batch_equals_single_queries(spark, k):
    tracks = random_tracks(8, 4, 150)
    tracks["parked"] = [(40.0, 116.0)] * 400
    tracks["dense"] = random_tracks(9, 1, 300, 40.02, 116.02, 0.0005)["t0"]
    rows = points(spark, tracks)
    rng = random.Random(1)
    asked = [
        (n, 40.0 + rng.gauss(0, 0.05), 116.0 + rng.gauss(0, 0.05)) for n in range(25)
    ] + [(90, 40.0, 116.0), (91, 40.0, 116.0), (92, -33.0, 18.0), (93, 40.02, 116.02)]
    queries = spark.createDataFrame(asked, "query_id int, lat double, lon double")
    got = {}
    for r in knn_batch(rows, queries, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.traj_id, r.lat, r.lon))
    for n, lat, lon in asked:
        assert got[n] == nearest(flat(tracks), (lat, lon), k), n
    pyramid = build_pyramid(rows, 70)
    shared = knn_batch(rows, queries, k, pyramid).where("query_id = 3").orderBy("rank")
    assert answer(shared) == got[3]
    for r in candidate_cells(pyramid, queries, k).collect():
        kth = nearest(flat(tracks), (r.q_lat, r.q_lon), k)[-1]
        assert metres(r.q_lat, r.q_lon, kth[1], kth[2]) <= r["_bound"]


def test_batch_meets_few_points_beside_a_crowd(spark):
    """Queries outside a dense square only look at its rim."""
    rng = random.Random(6)
    crowd = [(40 + rng.random() / 50, 116 + rng.random() / 50) for _ in range(20_000)]
    rows = points(spark, {"t": crowd})
    queries = spark.createDataFrame(
        [(1, 40.05, 116.01), (2, 40.01, 116.1), (3, 40.01, 116.01), (4, 39.0, 115.0)],
        "query_id int, lat double, lon double",
    )
    cells = candidate_cells(build_pyramid(rows, 5), queries, 5)
    per_query = {r.query_id: r["count"] for r in cells.groupBy("query_id").count().collect()}
    assert max(per_query.values()) < 100
    got = knn_batch(rows, queries, 5).where("query_id = 2").orderBy("rank")
    assert answer(got) == nearest([("t", *p) for p in crowd], (40.01, 116.1), 5)


def test_batch_with_few_points(spark):
    rows = points(spark, {"t": line(3)})
    queries = spark.createDataFrame([(1, 0.0, 0.0)], "query_id int, lat double, lon double")
    assert knn_batch(rows, queries, 10).count() == 3
    assert knn_batch(rows, queries, 0).count() == 0
    assert knn_batch(rows.limit(0), queries, 5).count() == 0
    assert knn_batch(rows, queries.limit(0), 5).count() == 0


def test_comparison_pairs_ranks(spark):
    first = spark.createDataFrame(
        [("a", 40.0, 116.0, 1.0), ("b", 40.0, 116.000001, 2.0), ("c", 41.0, 116.0, 3.0)],
        "traj_id string, lat double, lon double, distance double",
    )
    second = spark.createDataFrame(
        [("x", 40.0, 116.0, 1.0), ("y", 40.0, 116.00001, 2.0)], first.schema
    )
    got = compare_knn(first, second).orderBy("rank").collect()
    assert [(r.rank, r.traj_1, r.traj_2, r.match) for r in got] == [
        (1, "a", "x", "same"),
        (2, "b", "y", "small dif"),
    ]
    assert compare_knn(first, second.limit(0)).count() == 0


def test_parity_against_the_first(spark):
    report = layout_parity(
        {"CSV": spark.range(4), "Fixed Segments (a)": spark.range(3)},
        {"Fixed Segments (a)": "Fixed Segments"},
    )
    got = {r.layout: r for r in report.collect()}
    assert got["CSV"].diff == 0 and got["CSV"].category == "Other"
    assert got["Fixed Segments (a)"].rel_diff == -0.25
    assert got["Fixed Segments (a)"].category == "Fixed Segments"
    with pytest.raises(ValueError):
        layout_parity({})


def test_distances_match_brute_force(spark):
    rows = points(spark, random_tracks(5, 1, 30, spread=20))
    got = knn.knn_points(rows, (40.0, 116.0), 30).collect()
    for r in got:
        assert abs(r.distance - metres(40.0, 116.0, r.lat, r.lon)) < 1e-4
    assert rows.select(F.max("seq")).first()[0] == 29
