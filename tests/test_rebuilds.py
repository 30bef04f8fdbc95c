"""Answers that must not depend on sizes, earlier runs or the session."""

import types

import pytest
from pyspark.sql import functions as F

from pathweave import session
from pathweave.operators.bbox import segments_overlapping, segments_touching
from pathweave.operators.knn_batch import build_pyramid, knn_batch
from pathweave.operators.segmentation import fixed_segments, grid_segments, recompute_bounds
from pathweave.operators.trajectories import assemble, regroup
from pathweave.plans.layouts import build_layouts, open_layouts
from pathweave.schemas import BBox, GridSpec
from tests.helpers import line, points

GRID = GridSpec(39.0, 115.0, 1.0)


def segments_of(rows):
    found = rows.groupBy("entity_id", "segment_id").agg(F.sum(F.size("vals_x")).alias("n"))
    return {(r.entity_id, r.segment_id): r.n for r in found.collect()}


@pytest.mark.parametrize("cut", ["grid", "fixed"])
def test_parts_answer_as_whole_segments(spark, cut):
    # an L: its bounds overlap a box that no part of it comes near
    corner = [(40.0 + n / 100, 116.0) for n in range(20)] + [(40.2, 116.0 + n / 100) for n in range(20)]
    rows = points(spark, {"t": corner, "u": line(5, 40.5, 116.5)})

    def build(part):
        if cut == "grid":
            return grid_segments(rows, GRID, 1.0, part_points=part)
        return fixed_segments(rows, 40, part_points=part)

    whole, parts = build(1000), build(8)
    assert parts.where("part > 0").count() > 0
    for box in (BBox(40.0, 40.05, 116.15, 116.3), BBox(40.0, 40.02, 115.9, 116.1), BBox(0, 1, 0, 1)):
        for ask in (segments_overlapping, segments_touching):
            assert segments_of(ask(parts, box)) == segments_of(ask(whole, box))
    bounds = ["entity_id", "segment_id", "part", "min_x", "max_x", "min_y", "max_y", "min_t", "max_t"]
    again = recompute_bounds(parts.withColumn("min_x", F.lit(0.0)))
    assert sorted(again.select(bounds).collect()) == sorted(parts.select(bounds).collect())


def test_a_segment_may_be_longer_than_a_part(spark):
    rows = points(spark, {"t": line(30)})
    segments = fixed_segments(rows, 2_000_000, part_points=7)
    assert segments_of(segments) == {("t", 0): 30}
    whole = regroup(assemble(rows, part_points=7)).first()
    assert [p.seq for p in whole.points] == list(range(30))


def test_rebuilt_pyramid_gives_the_same_answer(spark, tmp_path):
    rows = points(spark, {"t": line(400, step=1e-3), "u": line(300, 40.001)})
    queries = spark.createDataFrame([(1, 40.1, 116.0), (2, 40.0, 116.0)], "query_id int, lat double, lon double")
    path = str(tmp_path / "pyramid")
    first = build_pyramid(rows, 20, path)
    n, want = first.count(), knn_batch(rows, queries, 20, first).count()
    again = build_pyramid(rows, 20, path)
    assert again.count() == n
    assert knn_batch(rows, queries, 20, again).count() == want == 40


def test_layouts_of_other_parameters_are_built(spark, tmp_path):
    rows = points(spark, {"t": line(40, step=1e-3)})
    names = ["Grid Segments", "Fixed Segments"]
    counts = {}
    for size, cell in ((10, 0.001), (20, 0.01), (10, 0.001)):
        made = build_layouts(spark, str(tmp_path / "l"), rows, max_segment_size=size, cell_size=cell, names=names)
        found = open_layouts(spark, made)
        counts.setdefault((size, cell), []).append([found[n].count() for n in names])
    assert counts[10, 0.001][0] == counts[10, 0.001][1] != counts[20, 0.01][0]


def fake_session(master, checkpoint=None, conf=None):
    context = types.SimpleNamespace(master=master, applicationId="a", getCheckpointDir=lambda: checkpoint)
    return types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda key, other: conf or other))


def test_a_cluster_has_to_name_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_root(fake_session(master))
    assert session.shared_root(fake_session("yarn", "hdfs://x/c/")) == "hdfs://x/c"
    assert session.shared_root(fake_session("yarn", "hdfs://x/c", "s3a://b/d/")) == "s3a://b/d"
    local = session.shared_root(fake_session("local[4]"))
    assert local == session.shared_root(fake_session("local[*]"))


def test_lines_without_numbers_are_quarantined(spark, tmp_path):
    from pathweave.sources.raw_logs import read_malformed_lines, read_raw_logs

    folder = tmp_path / "000" / "Trajectory"
    folder.mkdir(parents=True)
    rows = [f"{lat},116.3,0,{alt},39757.5,2008-11-26,12:00:0{n}" for n, (lat, alt) in enumerate([(39.9, 1), ("NaN", 1), (39.8, "Infinity"), (39.7, 3)])]
    (folder / "t.plt").write_text("\n".join(["h"] * 6 + rows))
    got = read_raw_logs(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.lat) for r in got] == [(0, 39.9), (1, 39.7)]
    assert [r.line_no for r in read_malformed_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [7, 8]
    assert grid_segments(read_raw_logs(spark, str(tmp_path)), GRID, 1.0).count() == 1


def test_files_follow_the_planned_size(spark, tmp_path):
    from pathweave.sources.layout import partitions_for

    points(spark, {"t": line(5000)}).write.parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    assert partitions_for(rows) is None
    assert partitions_for(rows, file_bytes=1000) > 20
    assert partitions_for(spark.createDataFrame([(1,)], "a int"), 1) is None
