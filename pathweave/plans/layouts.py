"""Build every stored layout that is not there yet."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pathweave.operators.extent import point_extent
from pathweave.operators.index import fixed_index, grid_index
from pathweave.operators.segmentation import (
    CELL_SIZE,
    FIXED_SEGMENT_POINTS,
    fixed_segments,
    grid_segments,
)
from pathweave.schemas import SEG_FIXED, SEG_GRID
from pathweave.session import shuffles_dropped, staged_table
from pathweave.sources.geoparquet import read_geoparquet, write_geoparquet
from pathweave.sources.points import (
    read_points,
    read_points_csv,
    write_points,
    write_points_csv,
)
from pathweave.sources.segments import read_segments, write_segments

# fixed value: rows per row group of the second GeoParquet layout
GEO_ROW_GROUP = 10_000

# display names
POINTS = "Base Parquet"
CSV = "CSV"
FIXED = "Fixed Segments"
FIXED_INDEX = "Fixed Segments (index)"
GRID = "Grid Segments"
GRID_INDEX = "Grid Segments (index)"
GEO = "GeoParquet"
GEO_SMALL_GROUPS = "GeoParquet (small groups)"
DISPLAY_NAMES = (
    POINTS,
    CSV,
    FIXED,
    FIXED_INDEX,
    GRID,
    GRID_INDEX,
    GEO,
    GEO_SMALL_GROUPS,
)
# the category under which reports list a layout
CATEGORY = {
    POINTS: POINTS,
    CSV: CSV,
    FIXED: FIXED,
    FIXED_INDEX: FIXED,
    GRID: GRID,
    GRID_INDEX: GRID,
    GEO: "Other",
    GEO_SMALL_GROUPS: "Other",
}


@dataclass(frozen=True)
class Layouts:
    """Where the layouts of one data set live below ``root``. What a layout was cut
    with is part of its folder's name, so a build with other parameters never takes
    it for its own."""

    root: str
    max_segment_size: int = FIXED_SEGMENT_POINTS
    cell_size: float = CELL_SIZE
    key: tuple[str, ...] = ("traj_id",)

    @property
    def _by(self) -> str:
        return "by_" + "_".join(self.key)

    def at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def points(self) -> str:
        return self.at("points")

    @property
    def csv(self) -> str:
        return self.at("points_csv")

    @property
    def fixed(self) -> str:
        return self.at(f"segments_fixed-{self.max_segment_size}-{self._by}")

    @property
    def fixed_index(self) -> str:
        return self.at(f"segments_fixed_knn-{self.max_segment_size}-{self._by}")

    @property
    def grid(self) -> str:
        return self.at(f"segments_grid-{self.cell_size!r}-{self._by}")

    @property
    def grid_index(self) -> str:
        return self.at(f"segments_grid_knn-{self.cell_size!r}-{self._by}")

    @property
    def geo(self) -> str:
        return self.at("geo_default")

    @property
    def geo_small_groups(self) -> str:
        return self.at("geo_small_groups")


def exists(spark: SparkSession, path: str) -> bool:
    """The layout was written to its end: every writer leaves a marker last."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(marker)


def build_layouts(
    spark: SparkSession,
    root: str,
    points: DataFrame,
    key: Sequence[str] = ("traj_id",),
    max_segment_size: int = FIXED_SEGMENT_POINTS,
    cell_size: float = CELL_SIZE,
    names: Sequence[str] | None = None,
) -> Layouts:
    """Write what is missing below ``root``; each step reads the stored result of
    the one before it, so a lost executor never repeats the whole chain. What an
    aborted run left unfinished is written anew. ``names`` limits the work to some
    layouts (by display name) and those they are computed from. The points of one
    ``root`` are those of the first build: other points need another ``root``.
    """
    out = Layouts(root, int(max_segment_size), float(cell_size), tuple(key))
    wanted = set(DISPLAY_NAMES if names is None else names)
    unknown = wanted - set(DISPLAY_NAMES)
    if unknown:
        raise ValueError(f"unknown layouts: {sorted(unknown)}")
    if FIXED_INDEX in wanted:
        wanted.add(FIXED)
    if GRID_INDEX in wanted:
        wanted.add(GRID)

    def missing(name: str, path: str) -> bool:
        return name in wanted and not exists(spark, path)

    with shuffles_dropped(spark):
        _build(spark, out, points, missing)
    return out


def _build(spark: SparkSession, out: Layouts, points: DataFrame, missing: Callable[[str, str], bool]) -> None:
    """Numbered points and grid segments are staged before they are clustered: finding
    the ranges of files would compute them a second time."""
    key, cell_size = out.key, out.cell_size
    if not exists(spark, out.points):
        with staged_table(points, "numbered-points") as numbered:
            write_points(numbered, out.points, "overwrite")
    stored = spark.read.parquet(out.points)
    if missing(CSV, out.csv):
        write_points_csv(stored, out.csv, "overwrite", compression="gzip")
    if missing(FIXED, out.fixed):
        fixed = fixed_segments(stored, out.max_segment_size, key)
        write_segments(fixed, out.fixed, "overwrite")
    if missing(FIXED_INDEX, out.fixed_index):
        # an index keeps the clustering of the files it is computed from
        index = fixed_index(read_segments(spark, out.fixed))
        write_segments(index, out.fixed_index, "overwrite", cluster=False)
    if missing(GRID, out.grid):
        grid = point_extent(stored)
        with staged_table(grid_segments(stored, grid, cell_size, key), "cut-segments") as cut:
            write_segments(cut, out.grid, "overwrite")
    if missing(GRID_INDEX, out.grid_index):
        index = grid_index(read_segments(spark, out.grid), cell_size)
        write_segments(index, out.grid_index, "overwrite", cluster=False)
    # these keep the clustering of the points' files, too
    if missing(GEO, out.geo):
        write_geoparquet(stored, out.geo, "overwrite", cluster=False)
    if missing(GEO_SMALL_GROUPS, out.geo_small_groups):
        write_geoparquet(
            stored,
            out.geo_small_groups,
            "overwrite",
            row_group_size=GEO_ROW_GROUP,
            cluster=False,
        )


def open_layouts(spark: SparkSession, layouts: Layouts) -> dict[str, DataFrame]:
    """DataFrames of the layouts that exist, by display name."""
    readers = {
        POINTS: (layouts.points, lambda p: read_points(spark, p)),
        CSV: (layouts.csv, lambda p: _read_csv(spark, p)),
        FIXED: (layouts.fixed, lambda p: read_segments(spark, p)),
        FIXED_INDEX: (layouts.fixed_index, lambda p: read_segments(spark, p, SEG_FIXED)),
        GRID: (layouts.grid, lambda p: read_segments(spark, p)),
        GRID_INDEX: (layouts.grid_index, lambda p: read_segments(spark, p, SEG_GRID)),
        GEO: (layouts.geo, lambda p: read_geoparquet(spark, p)),
        GEO_SMALL_GROUPS: (
            layouts.geo_small_groups,
            lambda p: read_geoparquet(spark, p),
        ),
    }
    return {
        name: read(path) for name, (path, read) in readers.items() if exists(spark, path)
    }


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    header = spark.read.option("header", True).csv(path).columns
    return read_points_csv(spark, path, header)
