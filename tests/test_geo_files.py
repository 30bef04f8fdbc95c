"""GeoParquet folders: which files are opened, and what a crash leaves."""

import json
import shutil

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pathweave.functions.predicates import point_in_box
from pathweave.schemas import BBox
from pathweave.sources import geo_files
from pathweave.sources import geoparquet as module
from pathweave.sources.geoparquet import (
    GeoPointsWriter,
    read_geoparquet,
    write_geoparquet,
)
from tests.helpers import points

BOX = BBox(40.0, 40.5, 116.0, 117.0)


def areas(spark):
    """Points of one degree row each, so that clustered files cover separate areas."""
    return points(spark, {f"t{n}": [(38.0 + n + i / 1000, 116.0 + i / 1000) for i in range(200)] for n in range(6)})


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "geo")
    for n in range(6):
        write_geoparquet(areas(spark).where(F.col("traj_id") == f"t{n}"), path, cluster=False)
    return path


def opened(df):
    return {f.rsplit("/", 1)[1] for f in df.inputFiles()}


def holding(path, box):
    """Files with a row in the box, by reading all of them."""
    out = set()
    for name in geo_files.data_files(pafs.LocalFileSystem(), path):
        t = pq.read_table(f"{path}/{name}").to_pandas()
        if ((t.lat >= box.min_lat) & (t.lat <= box.max_lat) & (t.lon >= box.min_lon) & (t.lon <= box.max_lon)).any():
            out.add(name)
    return out


@pytest.mark.parametrize("foreign", [False, True])
def test_only_files_that_meet_the_box_are_opened(spark, folder, foreign, monkeypatch):
    if foreign:
        # as another tool leaves it: no entries, bounds in the footers alone
        shutil.rmtree(f"{folder}/{geo_files.ENTRIES}")
        monkeypatch.setattr(geo_files, "FEW_FILES", 2)
    whole = read_geoparquet(spark, folder)
    assert len(opened(whole)) == len(geo_files.data_files(pafs.LocalFileSystem(), folder)) >= 6
    near = read_geoparquet(spark, folder, BOX)
    assert opened(near) == holding(folder, BOX) and near.count() == whole.where(point_in_box(BOX)).count() == 200
    for box, n in ((BBox(0.0, 1.0, 0.0, 1.0), 0), (BBox(40.199, 41.0, 116.0, 116.5), 2)):
        assert read_geoparquet(spark, folder, box).count() == n
    assert read_geoparquet(spark, folder, BBox(0.0, 1.0, 0.0, 1.0)).columns == whole.columns


def test_nan_and_null_coordinates(spark, tmp_path):
    path, nan = str(tmp_path / "geo"), float("nan")
    rows = points(spark, {"a": [(40.0, 116.0), (nan, 116.0), (41.0, nan)], "b": [(nan, nan)]})
    rows = rows.unionByName(rows.limit(1).withColumn("lat", F.lit(None).cast("double")))
    write_geoparquet(rows, path, cluster=False)
    assert read_geoparquet(spark, path).count() == 5
    for box in (BOX, BBox(0.0, 1.0, 0.0, 1.0), BBox(40.0, float("inf"), 0.0, float("inf")), BBox(0.0, nan, 0.0, nan)):
        assert read_geoparquet(spark, path, box).count() == rows.where(point_in_box(box)).count(), box


def test_bounds_in_footers(tmp_path):
    fs = pafs.LocalFileSystem()

    def bounds(box, **more):
        path = str(tmp_path / "x.parquet")
        geo = {"primary_column": "geometry", "columns": {"geometry": {"bbox": box, **more}}}
        pq.write_table(pa.table({"lat": [1.0]}).replace_schema_metadata({b"geo": json.dumps(geo).encode()}), path)
        return geo_files.footer_bounds(fs, path)

    assert bounds([1, 2, 3, 4]) == (1.0, 2.0, 3.0, 4.0)
    assert bounds([1, 2, -9, 3, 4, 9]) == (1.0, 2.0, 3.0, 4.0)
    # across the antimeridian any longitude is possible
    assert bounds([170, 2, -170, 4]) == (-180.0, 2.0, 180.0, 4.0)
    for odd in (None, [], [1, 2, 3], [1, 5, 3, 4], ["a", 1, 2, 3], [float("nan"), 1, 2, 3]):
        assert bounds(odd) is None
    pq.write_table(pa.table({"lat": [1.0]}), str(tmp_path / "y.parquet"))
    assert geo_files.footer_bounds(fs, str(tmp_path / "y.parquet")) is None
    assert geo_files.meets(None, BOX)


@pytest.mark.parametrize("at", ["move", "add_entry", "delete_file"])
def test_a_crash_leaves_the_old_or_the_new_version(spark, tmp_path, monkeypatch, at):
    """The commit of an overwrite is broken off at its n-th step, for every n."""
    path = str(tmp_path / "geo")
    rows = areas(spark)
    old, new = {f"t{n}" for n in range(6)}, {"t0", "t1"}
    parts = [rows.where(F.col("traj_id").isin(*new) & (F.col("seq") % 3 == i)).toArrow() for i in range(3)]
    seen = set()
    for n in range(40):
        write_geoparquet(rows, path, "overwrite", partitions=4)
        writer = GeoPointsWriter({"path": path}, True)
        messages = [writer.write(iter(part.to_batches())) for part in parts]
        steps = 0

        def counted(real):
            def step(*args, **kw):
                nonlocal steps
                steps += 1
                if steps > n:
                    raise OSError("lost")
                return real(*args, **kw)

            return step

        with monkeypatch.context() as patch:
            if at == "add_entry":
                patch.setattr(module, "add_entry", counted(module.add_entry))
            else:
                local = pafs.LocalFileSystem()

                class Fs:
                    def __getattr__(self, name):
                        return counted(getattr(local, name)) if name == at else getattr(local, name)

                patch.setattr(module, "place", lambda p: (Fs(), p))
            try:
                writer.commit(messages)
                broken = False
            except OSError:
                broken = True
        found = {r.traj_id for r in read_geoparquet(spark, path).select("traj_id").distinct().collect()}
        count = read_geoparquet(spark, path).count()
        assert (found, count) in ((old, 1200), (new, 400)), n
        seen.add(count)
        if not broken:
            break
    assert count == 400 and not broken
    assert seen == ({400} if at == "delete_file" and 1200 not in seen else {400, 1200})
    # and the next overwrite clears what was left
    write_geoparquet(rows, path, "overwrite", partitions=2)
    assert len(geo_files.entries(pafs.LocalFileSystem(), path)) == 1
    assert set(geo_files.data_files(pafs.LocalFileSystem(), path)) == set(geo_files.current_files(pafs.LocalFileSystem(), path))
