"""Segments over several micro-batches are those of one batch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathweave.operators.segmentation import (
    fixed_members,
    fixed_segments,
    grid_members,
    grid_segments,
)
from pathweave.schemas import POINTS, GridSpec
from pathweave.streaming.live_segments import (
    advance,
    segments_of_members,
    stream_fixed_members,
    stream_grid_members,
)
from tests.helpers import points

GRID = GridSpec(39.0, 115.0)
COLUMNS = ["entity_id", "segment_id", "part", "pos", "lat", "lon", "timestamp"]


def tracks():
    rng = random.Random(1)
    out = {"parked": [(40.0, 116.0)] * 90, "one": [(40.0, 116.0)], "odd": [(1e12, 0.0), (2e12, 0.0), (40.0, 116.0)]}
    for t in range(3):
        lat, lon, track = 40.0, 116.0, []
        for _ in range(130):
            lat, lon = lat + rng.uniform(-7e-4, 7e-4), lon + rng.uniform(-7e-4, 7e-4)
            track.append((lat, lon))
        out[f"t{t}"] = track
    return out


def feed(spark, folder, batches, cut, restart):
    """Each batch as a file of points; with ``restart`` a query of its own for each."""
    source, sink = f"{folder}/in", f"{folder}/out"
    for n, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(source)
        if restart or n == len(batches) - 1:
            stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(source)
            query = cut(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{folder}/cp")
            query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("kind, restart", [("fixed", True), ("grid", True), ("grid", False)])
def test_batches_make_the_segments_of_the_whole(spark, tmp_path, kind, restart):
    whole = points(spark, tracks())
    key = ("user_id", "traj_id")
    # uneven pieces, one of a single point, with line numbers that have gaps
    edges = [0, 1, 30, 31, 77, 1000]
    pieces = [
        whole.where(F.col("seq").between(a, b - 1)).withColumn("seq", F.col("seq") * 3 + 5).repartition(3)
        for a, b in zip(edges, edges[1:])
    ]
    if kind == "fixed":
        found = feed(spark, tmp_path, pieces, lambda p: stream_fixed_members(p, 10, part_points=4), restart)
        flat, segments = fixed_members(whole, 10, key, part_points=4), fixed_segments(whole, 10, key, part_points=4)
        last = flat.groupBy("entity_id", "segment_id").agg(F.max("pos").alias("last"))
        flat = flat.join(last.where("last >= 0"), ["entity_id", "segment_id"])
    else:
        found = feed(spark, tmp_path, pieces, lambda p: stream_grid_members(p, GRID, part_points=4), restart)
        flat, segments = grid_members(whole, GRID, key=key, part_points=4), grid_segments(whole, GRID, key=key, part_points=4)
    assert rows_of(found) == rows_of(flat)
    names = segments.columns
    got = segments_of_members(found).select(*names).collect()
    assert sorted(map(str, got)) == sorted(map(str, segments.collect()))


def test_any_split_of_a_trajectory_gives_the_same_rows():
    rng = np.random.default_rng(2)
    cells = rng.integers(0, 2, size=(2, 60)).repeat(2, axis=1)
    lat, lon, micros = rng.normal(size=120), rng.normal(size=120), np.arange(120)

    def run(cuts, cut):
        state, out = None, []
        for a, b in zip([0, *cuts], [*cuts, 120]):
            if a < b:
                state, rows = advance(state, lat[a:b], lon[a:b], micros[a:b], cells[0, a:b], cells[1, a:b], cut, 7)
                out += zip(*(rows[c].tolist() for c in ("segment_id", "part", "pos", "lat", "lon", "micros")))
        return sorted(out), state

    for cut in (lambda number, moved: moved, lambda number, moved: number % 9 == 0):
        want = run([], cut)
        for _ in range(40):
            assert run(sorted(rng.integers(0, 121, size=rng.integers(1, 9)).tolist()), cut) == want


def test_segment_size_must_be_positive(spark):
    with pytest.raises(ValueError, match="positive"):
        stream_fixed_members(points(spark, tracks()), 0)
