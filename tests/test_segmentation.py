import math
import random

import pytest
from pyspark.sql import functions as F

from pathweave.operators.extent import point_extent, segment_extent, with_cells
from pathweave.operators.index import fixed_index, grid_index
from pathweave.operators.ordering import dense_position, merge_users, renumber
from pathweave.operators.segmentation import (
    finish_segments,
    fixed_segments,
    flatten_segments,
    grid_members,
    grid_segments,
    recompute_bounds,
    with_segment_bounds,
)
from pathweave.operators.trajectories import (
    assemble,
    trajectory_boxes,
    trajectory_lengths,
)
from pathweave.schemas import GridSpec
from tests.helpers import cut, line, plan_text, points, segment_lists


@pytest.mark.parametrize("n", [1, 99, 100, 101, 200, 201])
def test_fixed_segment_sizes(spark, n):
    track = line(n)
    got = segment_lists(fixed_segments(points(spark, {"t": track})))
    expected = cut(track, list(range(100, n, 100)))
    assert len(got) == math.ceil(n / 100)
    assert [got[("t", i)] for i in range(len(got))] == expected


def test_fixed_segments_of_nothing(spark):
    empty = points(spark, {})
    assert fixed_segments(empty).count() == 0
    assert grid_segments(empty, point_extent(empty)).count() == 0


def test_segment_size_is_checked(spark):
    with pytest.raises(ValueError):
        fixed_segments(points(spark, {"t": line(3)}), 0)


def test_segment_bounds_and_times(spark):
    segments = fixed_segments(points(spark, {"t": line(25)}), 10)
    again = recompute_bounds(segments)
    assert sorted(segments.collect()) == sorted(again.collect())
    second = segments.where("segment_id = 1").first()
    assert second.min_t == second.vals_t[0] and second.max_t == second.vals_t[-1]
    assert len(second.vals_x) == 11


CELLS = {
    "AABBA": [(0, 0), (0, 0), (1, 0), (1, 0), (0, 0)],
    "single": [(2, 2)],
    "always new": [(i, i % 2) for i in range(9)],
    "still": [(3, 3)] * 12,
}


def track_of(cells):
    return [
        (10 + i + 0.5 + n * 1e-3, 20 + j + 0.5) for n, (i, j) in enumerate(cells)
    ]


@pytest.mark.parametrize("part_points", [1, 2, 3, 5, 100])
def test_grid_segments_in_any_chunking(spark, part_points):
    rng = random.Random(7)
    cells = dict(CELLS)
    for t in range(6):
        cells[f"random {t}"] = [
            (rng.randrange(2), rng.randrange(2)) for _ in range(rng.randrange(1, 40))
        ]
    tracks = {name: track_of(c) for name, c in cells.items()}
    segments = grid_segments(
        points(spark, tracks), GridSpec(10.0, 20.0, 1.0), 1.0, part_points=part_points
    )
    got = segment_lists(segments)
    expected = {}
    for name, c in cells.items():
        breaks = [n for n in range(1, len(c)) if c[n] != c[n - 1]]
        for number, piece in enumerate(cut(tracks[name], breaks)):
            expected[(name, number)] = piece
    assert got == expected
    # no row holds more than a part, plus the carried-over point
    longest = segments.agg(F.max(F.size("vals_x"))).first()[0]
    assert longest <= part_points + 1


def test_grid_index_anchor_with_parts(spark):
    cells = [(0, 0), (1, 1), (1, 1), (1, 1), (1, 1), (2, 0)]
    spec = GridSpec(10.0, 20.0, 1.0)
    rows = points(spark, {"t": track_of(cells)})
    whole = grid_segments(rows, spec, 1.0)
    parted = grid_segments(rows, spec, 1.0, part_points=2)
    assert parted.where("part > 0").count() == 1

    def labels(segments, anchor):
        indexed = grid_index(segments, 1.0, spec, anchor)
        return {
            (r.segment_id, r.grid_cell)
            for r in indexed.select("segment_id", "grid_cell").collect()
        }

    assert labels(whole, "first_point") == {(0, "0_0"), (1, "0_0"), (2, "1_1")}
    assert labels(parted, "first_point") == labels(whole, "first_point")
    assert labels(whole, "own_cell") == {(0, "0_0"), (1, "1_1"), (2, "2_0")}
    assert labels(parted, "own_cell") == labels(whole, "own_cell")
    with pytest.raises(ValueError):
        grid_index(whole, 1.0, spec, "middle")


def test_cells_truncate_toward_zero(spark):
    rows = points(spark, {"t": [(9.5, 18.5), (10.0, 20.0), (11.5, 22.5)]})
    cells = with_cells(rows, GridSpec(10.0, 20.0, 1.0)).orderBy("seq").collect()
    assert [c.grid_cell for c in cells] == ["0_-1", "0_0", "1_2"]


def test_extents_agree(spark):
    rows = points(spark, {"a": line(150), "b": line(10, 41.0, 117.0)})
    a = point_extent(rows).first()
    b = segment_extent(fixed_segments(rows, 20)).first()
    assert a == b


def test_centroid_counts_the_carried_point(spark):
    index = fixed_index(fixed_segments(points(spark, {"t": line(4, step=1.0)}), 2))
    means = {r.segment_id: r.centroid_x for r in index.collect()}
    assert means == {0: 40.5, 1: 42.0}


def test_segments_hold_every_point(spark):
    rows = points(spark, {"a": line(57), "b": line(3)})
    flat = flatten_segments(fixed_segments(rows, 10))
    carried = flat.where("segment_id > 0 AND pos = 0")
    own = flat.select("entity_id", "lat", "lon").exceptAll(
        carried.select("entity_id", "lat", "lon")
    )
    assert own.exceptAll(rows.select("traj_id", "lat", "lon")).count() == 0
    assert own.count() == 60


def test_compound_key(spark):
    rows = points(spark, {"t": line(3)}, "u1").unionByName(
        points(spark, {"t": line(2)}, "u2")
    )
    segments = fixed_segments(rows, key=("user_id", "traj_id"))
    assert {r.entity_id for r in segments.collect()} == {"u1/t", "u2/t"}


@pytest.mark.parametrize("hot_points", [0, 5, 1000])
def test_dense_position_with_hot_keys(spark, hot_points):
    rng = random.Random(3)
    rows = [("hot", rng.random(), n) for n in range(300)]
    rows += [("cold", rng.random(), n) for n in range(3)]
    df = spark.createDataFrame(rows, "k string, v double, n int")
    got = dense_position(df, ["k"], ["v"], "pos", hot_points)
    for key in ("hot", "cold"):
        ordered = got.where(F.col("k") == key).orderBy("v").collect()
        assert [r.pos for r in ordered] == list(range(len(ordered)))


def test_renumber_closes_gaps(spark):
    rows = points(spark, {"t": line(20)}).where("seq % 3 <> 1")
    got = renumber(rows, hot_points=2).orderBy("lat").collect()
    assert [r.seq for r in got] == list(range(len(got)))


def test_merge_users_appends_by_user(spark):
    rows = points(spark, {"t": line(3, 50.0)}, "u2").unionByName(
        points(spark, {"t": line(4, 40.0)}, "u1")
    )
    got = merge_users(rows).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(7))
    assert [r.user_id for r in got] == ["u1"] * 4 + ["u2"] * 3


@pytest.mark.parametrize("hot_points", [2, 1000])
def test_positions_with_null_users(spark, hot_points):
    rows = points(spark, {"t": line(12), "u": line(3)}).withColumn(
        "user_id", F.lit(None).cast("string")
    )
    unnamed = points(spark, {"v": line(5)}).withColumn(
        "traj_id", F.lit(None).cast("string")
    )
    got = merge_users(rows.unionByName(unnamed), hot_points=hot_points)
    for key, n in (("t", 12), ("u", 3), (None, 5)):
        own = got.where(F.col("traj_id").eqNullSafe(F.lit(key))).orderBy("lat")
        assert [r.seq for r in own.collect()] == list(range(n))


def test_trajectory_summaries(spark):
    rows = points(spark, {"a": line(5), "b": [(1.0, 2.0)]})
    assert {r.traj_id: r.n_points for r in trajectory_lengths(rows).collect()} == {
        "a": 5,
        "b": 1,
    }
    box = trajectory_boxes(rows).where("traj_id = 'b'").first()
    assert (box.min_lat, box.min_lon, box.max_lat, box.max_lon) == (1.0, 2.0, 1.0, 2.0)


def test_assembly_in_parts_keeps_order(spark):
    rows = points(spark, {"a": line(25)}).repartition(5)
    parts = assemble(rows, part_points=10).orderBy("part").collect()
    assert [len(p.points) for p in parts] == [10, 10, 5]
    assert [q.seq for p in parts for q in p.points] == list(range(25))


def test_short_trajectories_are_shuffled_once(spark):
    """Cutting and grouping share one shuffle by entity; rows are those of the chunks."""
    rng = random.Random(11)
    tracks = {f"t{n}": [(40 + rng.gauss(0, 2e-3), 116 + rng.gauss(0, 2e-3)) for _ in range(60)] for n in range(4)}
    rows = points(spark, tracks | {"parked": [(40.0, 116.0)] * 30, "one": [(40.1, 116.1)]})
    grid = GridSpec(39.9, 115.9, 0.001)
    whole = grid_segments(rows, grid, 0.001)
    assert plan_text(whole).count("hashpartitioning(") == 1
    chunked = finish_segments(grid_members(rows, grid, 0.001, part_points=7).withColumn("part", F.lit(0).cast("long")))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, chunked.select(*whole.columns).collect()))


def test_parts_of_short_trajectories_need_no_further_shuffle(spark):
    """Parts smaller than a task's share: rows and bounds are those of the chunks."""
    rng = random.Random(12)
    tracks = {f"t{n}": [(40 + rng.gauss(0, 4e-4), 116 + rng.gauss(0, 4e-4)) for _ in range(70)] for n in range(3)}
    rows = points(spark, tracks | {"parked": [(40.0, 116.0)] * 30, "one": [(40.1, 116.1)]})
    grid = GridSpec(39.9, 115.9, 0.001)
    parts = grid_segments(rows, grid, 0.001, part_points=4)
    assert plan_text(parts).count("hashpartitioning(") == 1
    chunked = with_segment_bounds(finish_segments(grid_members(rows, grid, 0.001, part_points=4)))
    assert parts.where("part > 1").count() > 0
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, chunked.select(*parts.columns).collect()))
