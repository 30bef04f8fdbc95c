"""GeoParquet points: a Python data source for writing, plain Parquet for reading.

Spark's own Parquet writer cannot add the ``geo`` footer entry, so the sink
streams Arrow batches of each task through one Parquet writer. Reading by a box leaves
out files whose bounds miss it before any of them is opened.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    WriterCommitMessage,
)

from pathweave.functions.predicates import point_in_box
from pathweave.functions.wkb import encode_points
from pathweave.schemas import GEO, BBox
from pathweave.sources.geo_files import (
    ENTRIES,
    add_entry,
    data_files,
    entries,
    files_meeting,
    place,
)
from pathweave.sources.points import clustered_points

FORMAT = "geopoints"
# fixed values: layout version and CRS tag of the footer entry
GEO_VERSION = "1.0.0"
CRS = {"id": {"authority": "EPSG", "code": 4326}}


def _footer(bounds: list[float] | None) -> bytes:
    column: dict = {
        "encoding": "WKB",
        "geometry_types": ["Point"],
        "crs": {
            "type": "GeographicCRS",
            "name": "WGS 84",
            "datum": {
                "type": "GeodeticReferenceFrame",
                "name": "World Geodetic System 1984",
                "ellipsoid": {
                    "name": "WGS 84",
                    "semi_major_axis": 6378137,
                    "inverse_flattening": 298.257223563,
                },
            },
            "coordinate_system": {
                "subtype": "ellipsoidal",
                "axis": [
                    {
                        "name": "Geodetic latitude",
                        "abbreviation": "Lat",
                        "direction": "north",
                        "unit": "degree",
                    },
                    {
                        "name": "Geodetic longitude",
                        "abbreviation": "Lon",
                        "direction": "east",
                        "unit": "degree",
                    },
                ],
            },
            **CRS,
        },
    }
    if bounds is not None:
        column["bbox"] = bounds
    return json.dumps(
        {
            "version": GEO_VERSION,
            "primary_column": "geometry",
            "columns": {"geometry": column},
        }
    ).encode()


@dataclass
class _Written(WriterCommitMessage):
    parts: list[str] = field(default_factory=list)
    bounds: list[float] | None = None


class GeoPointsWriter(DataSourceArrowWriter):
    """Each task writes one file to a hidden folder; commit moves the files of
    successful tasks into place, so retried or lost tasks leave nothing behind.

    An overwrite counts from the moment its entry (see ``geo_files``) is there: a crash
    before leaves the old version, one after it the new, though files of the other may
    still lie around until the next overwrite. The marker of the old version goes
    first, so that readers that only know the marker don't take a mix for finished.
    """

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path = options["path"]
        self.compression = options.get("compression", "snappy")
        rows = options.get("row_group_size")
        self.row_group_size = int(rows) if rows else 1_000_000
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def _hidden(self, base: str) -> str:
        return posixpath.join(base, f"_writing-{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = place(self.path)
        name = f"part-{uuid.uuid4().hex}.{self.compression}.parquet"
        target = posixpath.join(self._hidden(base), name)
        writer: pq.ParquetWriter | None = None
        waiting: list[pa.RecordBatch] = []
        n_waiting = 0
        lo, hi = [float("inf")] * 2, [float("-inf")] * 2

        def flush(keep: int) -> None:
            # row groups of exactly row_group_size rows, the last one shorter
            nonlocal waiting, n_waiting
            table = pa.Table.from_batches(waiting)
            whole = table.num_rows - keep
            writer.write_table(table.slice(0, whole), row_group_size=self.row_group_size)
            waiting = table.slice(whole).to_batches()
            n_waiting = keep

        for batch in iterator:
            batch = self._with_geometry(batch)
            if batch.num_rows == 0:
                continue
            if writer is None:
                fs.create_dir(self._hidden(base), recursive=True)
                writer = pq.ParquetWriter(
                    target, batch.schema, filesystem=fs, compression=self.compression
                )
            for axis, name_ in enumerate(("lon", "lat")):
                edges = pc.min_max(batch.column(name_)).as_py()
                if edges["min"] is not None:
                    lo[axis] = min(lo[axis], edges["min"])
                    hi[axis] = max(hi[axis], edges["max"])
            waiting.append(batch)
            n_waiting += batch.num_rows
            if n_waiting >= self.row_group_size:
                flush(n_waiting % self.row_group_size)
        if writer is None:
            return _Written([])
        if n_waiting:
            flush(0)
        bounds = [*lo, *hi] if lo[0] <= hi[0] and lo[1] <= hi[1] else None
        writer.add_key_value_metadata({b"geo": _footer(bounds)})
        writer.close()
        return _Written([name], bounds)

    @staticmethod
    def _with_geometry(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "geometry" in batch.schema.names:
            return batch
        return batch.append_column(
            "geometry", encode_points(batch.column("lon"), batch.column("lat"))
        )

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = place(self.path)
        fs.create_dir(base, recursive=True)
        before, marker = entries(fs, base), posixpath.join(base, "_SUCCESS")
        files = {name: m.bounds for m in messages if m is not None for name in m.parts}
        old = data_files(fs, base) if self.overwrite else []
        if self.overwrite and fs.get_file_info(marker).type == pafs.FileType.File:
            fs.delete_file(marker)
        hidden = self._hidden(base)
        for name in files:
            fs.move(posixpath.join(hidden, name), posixpath.join(base, name))
        add_entry(fs, base, self.job, files, sorted(before) if self.overwrite else [], not self.overwrite)
        self._drop_hidden(fs, hidden)
        with fs.open_output_stream(marker):
            pass
        if self.overwrite:
            for name in old:
                fs.delete_file(posixpath.join(base, name))
            for job in before:
                fs.delete_file(posixpath.join(base, ENTRIES, f"{job}.json"))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = place(self.path)
        self._drop_hidden(fs, self._hidden(base))

    @staticmethod
    def _drop_hidden(fs: pafs.FileSystem, hidden: str) -> None:
        if fs.get_file_info(hidden).type == pafs.FileType.Directory:
            fs.delete_dir(hidden)


class GeoPoints(DataSource):
    """``df.write.format("geopoints").option("path", ...)``; options
    ``compression`` and ``row_group_size`` (rows).

    It only writes. A reader that takes the filters of a query was tried and left out:
    in Spark 4.1 a query whose filters can't be pushed missed rows when it ran on the
    same DataFrame after one whose could. ``read_geoparquet`` takes the box instead and
    leaves the scan to Spark's own Parquet reader.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return GEO

    def writer(self, schema: T.StructType, overwrite: bool) -> GeoPointsWriter:
        missing = {"lat", "lon"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"points lack the columns {sorted(missing)}")
        return GeoPointsWriter(dict(self.options), overwrite)


def write_geoparquet(
    points: DataFrame,
    path: str,
    mode: str = "append",
    compression: str = "snappy",
    row_group_size: int | None = None,
    cluster: bool = True,
    partitions: int | None = None,
) -> None:
    """GeoParquet of points: their columns plus ``geometry`` = POINT(lon lat).

    ``mode`` is ``append`` or ``overwrite``.
    """
    points.sparkSession.dataSource.register(GeoPoints)
    rows = clustered_points(points, partitions) if cluster else points
    writer = rows.write.format(FORMAT).mode(mode).option("compression", compression)
    if row_group_size is not None:
        writer = writer.option("row_group_size", row_group_size)
    writer.option("path", path).save()


def read_geoparquet(
    spark: SparkSession, path: str, box: BBox | None = None
) -> DataFrame:
    """GeoParquet points with ``geometry`` as WKB.

    With a box only files whose bounds meet it are listed at all, and the comparisons
    on the plain coordinates are pushed into the scan of these.
    """
    files = files_meeting(spark, path, box)
    if files is not None and not files:
        return spark.read.parquet(path).limit(0)
    points = spark.read.parquet(*([path] if files is None else files))
    return points if box is None else points.where(point_in_box(box))


def without_geometry(points: DataFrame) -> DataFrame:
    return points.drop(F.col("geometry"))
