import json
import struct
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pathweave.functions.wkb import point_geometry
from pathweave.operators.extent import point_extent
from pathweave.operators.index import grid_index
from pathweave.operators.profile import file_profile, layout_profile
from pathweave.operators.bbox import refine_points
from pathweave.operators.segmentation import fixed_segments, grid_segments
from pathweave.plans.evaluation import bbox_report, bbox_results, knn_results
from pathweave.plans.layouts import build_layouts, open_layouts
from pathweave.schemas import POINTS, SEG_GRID, SEGMENTS, BBox
from pathweave.sources import geoparquet as geoparquet_module
from pathweave.sources import points as points_module
from pathweave.sources.geoparquet import read_geoparquet, write_geoparquet
from pathweave.sources.points import (
    read_foreign_points,
    read_points,
    read_points_csv,
    scan_points,
    write_points,
    write_points_csv,
)
from pathweave.sources.raw_logs import (
    read_malformed_lines,
    read_raw_logs,
    write_log_lines,
)
from pathweave.sources.results import (
    append_run,
    claim_run_id,
    next_run_id,
    read_runs,
    write_result,
)
from pathweave.sources.segments import (
    read_foreign_segments,
    read_segments,
    scan_segments,
    write_segments,
)
from pathweave.streaming.live_logs import stream_raw_logs
from tests.helpers import line, plan_text, points

HEADER = ["h1", "h2", "h3", "h4", "0,2,255,track,0,0,2,8421376", "0"]


def log_row(n):
    return f"{39.9 + n / 1000},{116.3},0,{492 + n},39757.5,2008-11-26,12:{n // 60:02d}:{n % 60:02d}"


def write_log(root, user, stem, rows, newline="\n", tail=True, header=HEADER):
    folder = root / user / "Trajectory"
    folder.mkdir(parents=True, exist_ok=True)
    text = newline.join([*header, *rows]) + (newline if tail else "")
    (folder / f"{stem}.plt").write_bytes(text.encode())


@pytest.fixture
def logs(tmp_path):
    root = tmp_path / "raw"
    write_log(root, "000", "20081126", [log_row(n) for n in range(5)])
    write_log(root, "000", "crlf", [log_row(n) for n in range(3)], "\r\n")
    write_log(root, "001", "20081126", [log_row(n) for n in range(4)], tail=False)
    write_log(root, "001", "blank", [log_row(0), log_row(1), "", ""])
    write_log(root, "002", "header_only", [])
    write_log(root, "002", "bad", [log_row(0), "39.9,oops", log_row(2)])
    write_log(root, "003", "long", [log_row(n) for n in range(3000)])
    return str(root)


# 0 sends every file through the path for large files
@pytest.mark.parametrize("whole_file_bytes", [0, 1000, 10**9])
def test_raw_logs(spark, logs, whole_file_bytes):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        # several splits inside the long log
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16KB")
        rows = read_raw_logs(spark, logs, whole_file_bytes=whole_file_bytes)
        assert [f.name for f in rows.schema] == POINTS.fieldNames()
        got = rows.orderBy("user_id", "traj_id", "seq").collect()
        bad = read_malformed_lines(spark, logs, whole_file_bytes=whole_file_bytes)
        assert [(r.line_no, r.line) for r in bad.collect()] == [(7, "39.9,oops")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    tracks = {}
    for r in got:
        tracks.setdefault((r.user_id, r.traj_id), []).append(r)
    assert {k: len(v) for k, v in tracks.items()} == {
        ("000", "20081126"): 5,
        ("000", "crlf"): 3,
        ("001", "20081126"): 4,
        ("001", "blank"): 2,
        ("002", "bad"): 2,
        ("003", "long"): 3000,
    }
    assert [r.seq for r in tracks[("002", "bad")]] == [0, 1]  # no gap for the bad line
    long = tracks[("003", "long")]
    assert [r.seq for r in long] == list(range(3000))
    assert [r.lat for r in long] == [float(39.9 + n / 1000) for n in range(3000)]
    first = tracks[("000", "crlf")][0]
    assert first.altitude == 492.0
    assert first.timestamp == datetime(2008, 11, 26, 12, 0, 0)


def test_raw_log_times_are_naive(spark, tmp_path):
    """A local time that does not exist in the session's zone stays as written."""
    row = "39.9,116.3,0,1,0,2021-03-28,02:30:00"
    write_log(tmp_path, "000", "dst", [row])
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        text = read_raw_logs(spark, str(tmp_path)).select(
            F.col("timestamp").cast("string").alias("t")
        )
        assert text.first().t == "2021-03-28 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_small_files_are_pruned_by_size(spark, logs):
    """Each branch of the raw reader lists only its own files."""
    sized = spark.read.text(f"{logs}/*/Trajectory/*.plt").where(
        F.col("_metadata.file_size") > 1000
    )
    sized.collect()
    assert sized.select("_metadata.file_path").distinct().count() == 1
    assert "file_size" in plan_text(sized)


def test_stream_of_logs(spark, logs, tmp_path):
    query = (
        stream_raw_logs(spark, logs)
        .where("lat <= 39.901")
        .writeStream.format("memory")
        .queryName("live_points")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    batch = read_raw_logs(spark, logs).where("lat <= 39.901")
    assert spark.table("live_points").exceptAll(batch).count() == 0
    assert spark.table("live_points").count() == batch.count()


def test_points_parquet(spark, tmp_path):
    rows = points(spark, {"007": line(50), "b": line(20, 41.0)})
    write_points(rows, str(tmp_path / "p"))
    back = read_points(spark, str(tmp_path / "p"))
    assert back.exceptAll(rows).count() == 0 and back.count() == 70
    write_points(rows, str(tmp_path / "p"), "ignore")
    assert read_points(spark, str(tmp_path / "p")).count() == 70
    kept = scan_points(back, BBox(40.9, 42.0, 115.0, 117.0))
    kept.collect()
    plan = plan_text(kept)
    for pushed in ("GreaterThanOrEqual(lat,40.9)", "LessThanOrEqual(lon,117.0)"):
        assert pushed in plan


def test_points_csv_keeps_text_ids(spark, tmp_path):
    rows = points(spark, {"007": line(3)})
    write_points_csv(rows, str(tmp_path / "c"))
    back = read_points_csv(spark, str(tmp_path / "c"))
    assert sorted(back.collect()) == sorted(rows.collect())
    some = rows.select("traj_id", "lat", "lon", "altitude", "timestamp")
    write_points_csv(some, str(tmp_path / "d"))
    back = read_points_csv(spark, str(tmp_path / "d"), some.columns)
    assert sorted(back.collect()) == sorted(some.collect())


def test_foreign_points_with_nanoseconds(spark, tmp_path):
    frame = pd.DataFrame(
        {
            "traj_id": ["a", "a", "b", "a"],
            "lat": [40.0, 40.1, 41.0, 40.2],
            "lon": [116.0, 116.1, 117.0, 116.2],
            "altitude": [1.0, 2.0, 3.0, 4.0],
            "timestamp": pd.to_datetime(
                [
                    "2008-11-26 12:50:29",
                    "2008-11-26 12:50:30.25",
                    "1969-12-31 23:59:59",
                    "2008-11-27",
                ],
                format="ISO8601",
            ).astype("datetime64[ns]"),
        }
    )
    table = pa.Table.from_pandas(frame, preserve_index=False)
    (tmp_path / "f").mkdir()
    pq.write_table(table, tmp_path / "f" / "base.parquet", version="2.6")
    got = read_foreign_points(spark, str(tmp_path / "f"))
    assert got.columns == POINTS.fieldNames()
    rows = got.orderBy("traj_id", "seq").collect()
    assert [(r.traj_id, r.seq, r.lat) for r in rows] == [
        ("a", 0, 40.0),
        ("a", 1, 40.1),
        ("a", 2, 40.2),
        ("b", 0, 41.0),
    ]
    assert rows[1].timestamp == datetime(2008, 11, 26, 12, 50, 30, 250000)
    assert rows[3].timestamp == datetime(1969, 12, 31, 23, 59, 59)


def test_segments_parquet(spark, tmp_path):
    rows = points(spark, {"a": line(250), "b": line(20, 41.0)})
    write_segments(fixed_segments(rows), str(tmp_path / "s"))
    back = read_segments(spark, str(tmp_path / "s"))
    assert back.schema.fieldNames() == SEGMENTS.fieldNames()
    assert sorted(back.collect()) == sorted(fixed_segments(rows).collect())
    again = read_segments(spark, str(tmp_path / "s"), recompute=True)
    assert sorted(again.collect()) == sorted(back.collect())
    plan = scan_segments(back, BBox(40.0, 40.001, 115.0, 117.0))
    text = plan_text(plan)
    assert "GreaterThanOrEqual(max_x,40.0)" in text
    # all that refining reads, and no more
    assert "min_t" not in text.split("ReadSchema:")[1].split("\n")[0]
    refined = refine_points(plan, BBox(40.0, 40.001, 115.0, 117.0))
    assert sorted(refined.collect()) == sorted(
        refine_points(back, BBox(40.0, 40.001, 115.0, 117.0)).collect()
    )


def test_grid_index_ring_is_pushed_down(spark, tmp_path):
    rows = points(spark, {"a": line(250)})
    index = grid_index(grid_segments(rows, point_extent(rows)))
    write_segments(index, str(tmp_path / "g"))
    back = read_segments(spark, str(tmp_path / "g"), SEG_GRID)
    from pathweave.operators.knn import resolve_grid, ring_filter

    near = ring_filter(back, (40.01, 116.0), resolve_grid(back))
    text = plan_text(near)
    assert "GreaterThanOrEqual(cell_i,8)" in text


def test_foreign_segments_with_text_arrays(spark, tmp_path):
    frame = pd.DataFrame(
        {
            "entity_id": ["a", "b"],
            "segment_id": [0, 0],
            "vals_x": ["{39.98,40.0}", "{}"],
            "vals_y": ["{116.3, 116.4}", "{}"],
            "vals_t": ["{'2008-11-26T12:50:29','2008-11-26T12:50:30'}", "{}"],
            "min_x": [39.98, None],
            "grid_cell": ["0_0", "1_1"],
        }
    )
    (tmp_path / "f").mkdir()
    frame.to_parquet(tmp_path / "f" / "s.parquet")
    got = read_foreign_segments(spark, str(tmp_path / "f"))
    a, b = got.orderBy("entity_id").collect()
    assert a.vals_x == [39.98, 40.0] and a.vals_y == [116.3, 116.4]
    assert a.vals_t[1] == datetime(2008, 11, 26, 12, 50, 30)
    assert a.part == 0 and a.grid_cell == "0_0"
    assert b.vals_x == [] and b.vals_t == []


def test_geometry_bytes(spark):
    rows = spark.createDataFrame(
        [(116.3, 39.9), (-0.5, None)], "lon double, lat double"
    )
    a, b = rows.select(point_geometry().alias("g")).collect()
    assert struct.unpack("<BIdd", bytes(a.g)) == (1, 1, 116.3, 39.9)
    assert b.g is None


def test_geoparquet(spark, tmp_path):
    rows = points(spark, {"a": line(950), "b": line(50, 41.0)})
    path = str(tmp_path / "geo")
    write_geoparquet(rows, path, row_group_size=100, partitions=3)
    files = sorted((tmp_path / "geo").glob("*.parquet"))
    assert len(files) == 3
    total = 0
    for file in files:
        parquet = pq.ParquetFile(file)
        geo = json.loads(parquet.metadata.metadata[b"geo"])
        assert geo["primary_column"] == "geometry"
        assert geo["columns"]["geometry"]["crs"]["id"]["code"] == 4326
        sizes = [
            parquet.metadata.row_group(n).num_rows
            for n in range(parquet.num_row_groups)
        ]
        assert all(size == 100 for size in sizes[:-1]) and sizes[-1] <= 100
        column = parquet.metadata.row_group(0).column(0)
        assert column.compression == "SNAPPY"
        total += sum(sizes)
    assert total == 1000
    back = read_geoparquet(spark, path)
    assert back.drop("geometry").exceptAll(rows).count() == 0
    box = read_geoparquet(spark, path, BBox(40.9, 42.0, 115.0, 117.0))
    assert box.count() == 50
    assert "GreaterThanOrEqual(lat,40.9)" in plan_text(box)
    assert sorted(p.name for p in (tmp_path / "geo").iterdir() if p.name[0] == "_") == [
        "_SUCCESS",
        "_files",
    ]


def test_geoparquet_modes(spark, tmp_path):
    rows = points(spark, {"a": line(10)})
    path = str(tmp_path / "geo")
    write_geoparquet(rows, path, compression="zstd", cluster=False)
    write_geoparquet(rows, path)
    assert read_geoparquet(spark, path).count() == 20
    write_geoparquet(rows.limit(4), path, "overwrite")
    assert read_geoparquet(spark, path).count() == 4
    with pytest.raises(Exception, match="lack the columns"):
        write_geoparquet(rows.drop("lat"), str(tmp_path / "x"), cluster=False)


def test_failed_geoparquet_write_leaves_nothing(spark, tmp_path):
    rows = points(spark, {"a": line(10)}).withColumn(
        "altitude", F.raise_error(F.lit("no altitude")).cast("double")
    )
    path = tmp_path / "geo"
    with pytest.raises(Exception):
        write_geoparquet(rows, str(path), cluster=False)
    assert not path.exists() or list(path.iterdir()) == []


def test_results_and_runs(spark, tmp_path):
    result = spark.createDataFrame(
        [("a", 40.0, 116.0, b"\x01")], "traj_id string, lat double, lon double, geometry binary"
    )
    write_result(result, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == [
        "traj_id",
        "lat",
        "lon",
    ]
    write_result(result, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).first().lat == 40.0
    root = str(tmp_path / "runs")
    assert next_run_id(spark, root) == 1
    named = {"Base Parquet": result, "Fixed Segments (bounds)": result}
    assert append_run(named, root) == 1
    assert append_run(named, root) == 2
    other = spark.createDataFrame([("e", 1.0)], "entity_id string, lat double")
    assert append_run({"Grid Segments": other}, root) == 3
    stored = read_runs(spark, root, result)
    assert stored.count() == 4
    assert {r.traj_id for r in stored.collect()} == {"a"}
    assert [tuple(r) for r in read_runs(spark, root, other).collect()] == [
        ("e", 1.0, 3, "grid_segments")
    ]
    assert {r.method for r in stored.select("method").distinct().collect()} == {
        "base_parquet",
        "fixed_segments_bounds",
    }
    with pytest.raises(ValueError):
        write_result(result, str(tmp_path / "z"), "xml")


def test_layouts_from_raw_logs(spark, logs, tmp_path):
    rows = read_raw_logs(spark, logs)
    key = ("user_id", "traj_id")
    layouts = build_layouts(spark, str(tmp_path / "out"), rows, key, cell_size=0.01)
    frames = open_layouts(spark, layouts)
    assert len(frames) == 8
    stamp = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    build_layouts(spark, str(tmp_path / "out"), rows.limit(0), key, cell_size=0.01)
    assert stamp == {
        p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")
    }
    box = BBox(39.9, 39.95, 116.0, 117.0)
    report = bbox_report(frames, box).collect()
    assert len(report) == 8
    by_entity = {r.layout: r.n_matches for r in report}
    # compound keys keep the two logs of one stem apart in segment layouts
    assert by_entity["Fixed Segments (bounds)"] == by_entity["Grid Segments (points)"]
    assert list(bbox_results({}, box)) == []
    answers = knn_results(frames, (39.9, 116.3), 3)
    assert all(a.count() > 0 for a in answers.values())
    profile = layout_profile(spark, frames).collect()
    smallest = min(r.size_bytes for r in profile)
    for r in profile:
        assert r.n_files > 0
        assert r.percent_above_smallest == pytest.approx(
            100 * (r.size_bytes - smallest) / smallest
        )
    assert {r.name: r.rows for r in profile}["Base Parquet"] == rows.count()
    assert layout_profile(spark, {}).count() == 0
    files = file_profile(frames["Base Parquet"]).collect()
    assert sum(r.rows for r in files) == rows.count()


def test_unfinished_layout_is_written_anew(spark, tmp_path):
    rows = points(spark, {"a": line(5)})
    layouts = build_layouts(spark, str(tmp_path / "out"), rows)
    (tmp_path / "out" / "segments_fixed-100-by_traj_id" / "_SUCCESS").unlink()
    build_layouts(spark, str(tmp_path / "out"), rows)
    assert open_layouts(spark, layouts)["Fixed Segments"].count() == 1


def test_clustering_narrows_row_groups(spark, tmp_path):
    rng = np.random.default_rng(0)
    track = list(zip(rng.uniform(39, 41, 4000), rng.uniform(115, 117, 4000)))
    rows = points(spark, {"a": track}).repartition(8)
    write_points(rows, str(tmp_path / "p"), partitions=16)
    widths = []
    for file in (tmp_path / "p").glob("*.parquet"):
        frame = pq.read_table(file, columns=["lat", "lon"]).to_pandas()
        widths.append((np.ptp(frame.lat) * np.ptp(frame.lon)))
    assert len(widths) > 8 and np.mean(widths) < 4 / 4


def test_written_logs_are_read_back(spark, tmp_path):
    """Small and large files, blank lines and a log without points among them."""
    header = [(n, "header") for n in range(6)]
    logs = {
        "001/Trajectory/a.plt": [*header, (6, "39.9,116.3,0,100.0,39757.5,2008-11-26,12:00:00"), (7, ""), (8, "bad")],
        "001/Trajectory/empty.plt": header,
        "002/Trajectory/a.plt": [*header, *((6 + n, f"40.{n:04},116.3,0,{n}.0,39757.5,2008-11-26,12:00:00") for n in range(900))],
    }
    rows = [(f"x:/deep/{p}", n, line) for p, lines in logs.items() for n, line in reversed(lines)]
    df = spark.createDataFrame(rows, "path string, line_no long, line string").repartition(5)
    root = str(tmp_path / "logs")
    assert write_log_lines(df, root) == 3 == write_log_lines(df, root)
    for path, lines in logs.items():
        assert (tmp_path / "logs" / path).read_text() == "".join(f"{line}\n" for _, line in lines)
    assert len([p for p in (tmp_path / "logs").rglob("*") if p.is_file()]) == 3
    for limit in (10, 1000, 10**6):
        found = read_raw_logs(spark, root, whole_file_bytes=limit)
        assert sorted((r.user_id, r.traj_id, r.seq) for r in found.collect()) == [("001", "a", 0), *(("002", "a", n) for n in range(900))]


def test_two_runs_never_share_a_number(spark, tmp_path):
    root = str(tmp_path / "runs")
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda _: claim_run_id(spark, root), range(24)))
    assert sorted(numbers) == list(range(1, 25))
    result = spark.createDataFrame([("a", 1.0)], "traj_id string, lat double")
    with ThreadPoolExecutor(3) as pool:
        runs = list(pool.map(lambda _: append_run({"x": result}, root), range(3)))
    assert sorted(runs) == [25, 26, 27]
    assert read_runs(spark, root, result).count() == 3
    # a claim is enough, even if nothing was stored under it
    assert claim_run_id(spark, root) == 28


def test_layouts_over_stored_points_neither_shuffle_nor_swell(spark, tmp_path, monkeypatch):
    """CSV is compressed in files of bounded rows, GeoParquet keeps the clustering of the
    points it is written from."""
    monkeypatch.setattr(geoparquet_module, "clustered_points", None)
    monkeypatch.setattr(points_module, "CSV_FILE_ROWS", 100)
    rows = points(spark, {"a": line(250), "b": line(40, lat=41.0)})
    names = ("Base Parquet", "CSV", "GeoParquet", "GeoParquet (small groups)")
    layouts = build_layouts(spark, str(tmp_path / "out"), rows, names=names)
    at = open_layouts(spark, layouts)
    columns = ["traj_id", "seq", "lat", "lon", "timestamp"]
    want = sorted(map(tuple, rows.select(columns).collect()))
    for name in names:
        assert sorted(map(tuple, at[name].select(columns).collect())) == want
    parts = [p.name for p in (tmp_path / "out" / "points_csv").iterdir() if p.name.startswith("part-")]
    assert len(parts) >= 3 and all(p.endswith(".csv.gz") for p in parts)
