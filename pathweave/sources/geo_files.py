"""Which files belong to a GeoParquet folder, and which area each of them covers.

Every commit leaves one entry below ``_files``: the names of its files, the bounds of
each, and the commits whose files it replaces. An entry appears by a rename, so a reader
sees a commit whole or not at all, and a commit that overwrites takes the place of the
others at the moment its entry is there, whether or not their files are already gone.
Commits that only add don't disturb each other; an overwrite must run alone. A folder
without entries, as other tools write it, consists of all its Parquet files, and their
footers tell the bounds; after an overwrite only files with an entry count.
"""

from __future__ import annotations

import json
import math
import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from pathweave.schemas import BBox

ENTRIES = "_files"
#: Up to so many footers are read by the caller itself, more of them in tasks.
FEW_FILES = 16

#: (min_lon, min_lat, max_lon, max_lat)
Bounds = tuple[float, float, float, float]


def place(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def data_files(fs: pafs.FileSystem, base: str) -> list[str]:
    """Names of the Parquet files that lie in a folder, whoever put them there."""
    found = fs.get_file_info(pafs.FileSelector(base, recursive=False, allow_not_found=True))
    return sorted(x.base_name for x in found if x.is_file and x.base_name.endswith(".parquet") and x.base_name[0] not in "._")


def entries(fs: pafs.FileSystem, base: str) -> dict[str, dict]:
    """Commits by name, finished ones only."""
    folder = posixpath.join(base, ENTRIES)
    out = {}
    for info in fs.get_file_info(pafs.FileSelector(folder, recursive=False, allow_not_found=True)):
        name, end = posixpath.splitext(info.base_name)
        if end == ".json":
            with fs.open_input_stream(info.path) as stream:
                out[name] = json.loads(stream.read())
    return out


def add_entry(fs: pafs.FileSystem, base: str, job: str, files: dict[str, Bounds | None], replaces: list[str], other_files: bool) -> None:
    """``other_files``: whether files without an entry stay part of the folder."""
    folder = posixpath.join(base, ENTRIES)
    fs.create_dir(folder, recursive=True)
    waiting = posixpath.join(folder, f"{job}.writing")
    with fs.open_output_stream(waiting) as stream:
        stream.write(json.dumps({"files": files, "replaces": replaces, "other_files": other_files}).encode())
    fs.move(waiting, posixpath.join(folder, f"{job}.json"))


def current_files(fs: pafs.FileSystem, base: str) -> dict[str, Bounds | None]:
    """Files that make up the folder now; None where no entry knows the bounds."""
    known = entries(fs, base)
    gone = {job for e in known.values() for job in e["replaces"]}
    out: dict[str, Bounds | None] = {}
    if all(e["other_files"] for e in known.values()):
        listed = {name for e in known.values() for name in e["files"]}
        out |= dict.fromkeys(name for name in data_files(fs, base) if name not in listed)
    for job in sorted(known.keys() - gone):
        out |= {name: tuple(b) if b else None for name, b in known[job]["files"].items()}
    return out


def footer_bounds(fs: pafs.FileSystem, path: str) -> Bounds | None:
    """From the ``geo`` entry of a file's footer; None if there is no usable one."""
    try:
        with fs.open_input_file(path) as source:
            geo = json.loads((pq.ParquetFile(source).metadata.metadata or {})[b"geo"])
        box = [float(x) for x in geo["columns"][geo["primary_column"]]["bbox"]]
    except (KeyError, TypeError, ValueError, OSError):
        return None
    if len(box) not in (4, 6) or not all(map(math.isfinite, box)):
        return None
    half = len(box) // 2
    lon, lat = (box[0], box[half]), (box[1], box[half + 1])
    if lon[0] > lon[1]:
        # across the antimeridian
        lon = (-180.0, 180.0)
    return (lon[0], lat[0], lon[1], lat[1]) if lat[0] <= lat[1] else None


def meets(bounds: Bounds | None, box: BBox) -> bool:
    """Whether a file can hold a point of the box (closed); unknown bounds can."""
    if bounds is None or any(map(math.isnan, (box.min_lat, box.max_lat, box.min_lon, box.max_lon))):
        # Spark holds NaN for larger than all numbers, bounds don't tell of it
        return True
    return bounds[0] <= box.max_lon and bounds[2] >= box.min_lon and bounds[1] <= box.max_lat and bounds[3] >= box.min_lat


def files_meeting(spark: SparkSession, path: str, box: BBox | None) -> list[str] | None:
    """Paths of the folder's files that can hold a point of the box. Bounds come from
    the commits' entries; footers are read of the other files alone, in tasks if they
    are many. None for a store that only Spark can list."""
    try:
        fs, base = place(path)
    except (pa.ArrowInvalid, OSError):
        return None
    files = current_files(fs, base)
    if box is not None:
        unknown = [name for name, b in files.items() if b is None]
        files |= footers(spark, path, unknown) if len(unknown) > FEW_FILES else {n: footer_bounds(fs, posixpath.join(base, n)) for n in unknown}
    return [posixpath.join(path, name) for name, b in files.items() if box is None or meets(b, box)]


def footers(spark: SparkSession, path: str, names: list[str]) -> dict[str, Bounds | None]:
    """Footer bounds of many files, read by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(path)
        for batch in batches:
            found = [footer_bounds(fs, posixpath.join(base, n)) for n in batch.column("name").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(found, pa.list_(pa.float64()))], names=["name", "bounds"])

    listed: DataFrame = spark.createDataFrame([(n,) for n in names], "name string").repartition(min(len(names) // FEW_FILES + 1, 1000))
    rows = listed.mapInArrow(run, "name string, bounds array<double>").collect()
    return {r["name"]: tuple(r["bounds"]) if r["bounds"] else None for r in rows}
