"""Logs by the thousand: listing, parsing and micro-batches do not grow with files alone."""

import re

from pathweave.sources.raw_logs import _small_file_lines, parse_lines, read_raw_logs
from pathweave.streaming.live_logs import stream_raw_logs
from tests.helpers import plan_text

LINE = "40.0,116.0,0,5.0,39757.5,2008-11-26,12:00:00"


def write(folder, n):
    folder.mkdir(parents=True)
    for i in range(n):
        (folder / f"{i:06d}.plt").write_text("header\n" * 6 + LINE + "\n")
    (folder / "notes.txt").write_text(LINE)


def test_folders_are_listed_and_not_files(spark, tmp_path):
    write(tmp_path / "007" / "Trajectory", 5)
    (tmp_path / "008").mkdir()
    lines = _small_file_lines(spark, str(tmp_path), "*/Trajectory/*.plt", 1 << 20)
    assert "(5 paths)" not in plan_text(lines)
    got = read_raw_logs(spark, str(tmp_path)).collect()
    assert sorted((r.user_id, r.traj_id, r.seq) for r in got) == [("007", f"{i:06d}", 0) for i in range(5)]


def test_many_small_logs_are_one_batch(spark, tmp_path):
    write(tmp_path / "in" / "007" / "Trajectory", 1001)
    stream = stream_raw_logs(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query = stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [1001]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1001


def test_names_and_numbers_as_before(spark):
    """Names by the last parts are those the patterns find in whole paths; text that is no
    number stays none."""
    paths = ["file:/a/b/007/Trajectory/x.plt", "007/Trajectory/a.b.plt", "Trajectory/x", "/Trajectory/x.plt", "/u/Trajectory/.plt", "/u/Other/x.", "/u/Trajectory/", "x"]
    found = parse_lines(spark.createDataFrame([(p, 6, LINE) for p in paths], "path string, line_no long, line string")).collect()
    for r in found:
        user, traj = re.search(r"([^/]+)/Trajectory/[^/]*$", r.path), re.search(r"([^/]+?)(\.[^./]*)?$", r.path)
        assert (r.user_id, r.traj_id) == (user.group(1) if user else "", traj.group(1) if traj else ""), r.path
    texts = {"oops": None, "1": 1.0, " +.5 ": 0.5, "-1e3": -1000.0, "Infinity": float("inf"), "-inf": float("-inf"), "\t7": 7.0, "1x": None, "e5": None, "": None}
    lines = spark.createDataFrame([("u/Trajectory/x", 6, f"{t},1,0,1,0,2008-11-26,12:00:00", t) for t in texts], "path string, line_no long, line string, t string")
    assert {r.line.split(",")[0]: r.lat for r in parse_lines(lines).collect()} == texts
